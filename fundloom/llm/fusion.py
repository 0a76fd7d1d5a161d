"""The best representative of each group of duplicate records.

Sources claim values for an item. Accuracies and dependence are estimated together: a value's
probability follows from the accuracies of the sources that claim it, two sources that share values,
improbable ones above all, more often than chance are taken as copying, the less accurate one from the other, copied votes are discounted, and the row of maximum log posterior survives. Declared preferences
(trust, recency) are prior log odds, each with a weight; exact decimals hold weights of any size.
"""

from __future__ import annotations

from decimal import Decimal
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.session import materialize

#: Rounds of estimation, start accuracy, its range, assumed false values of an item, rate of copying, prior of dependence.
ROUNDS, ACCURACY, ACCURACIES, FALSE_VALUES, COPY_RATE, DEPENDENT = 2, 0.8, (0.05, 0.99), 10, 0.8, 0.1
#: Largest log odds that votes can give; a prior with a weight above twice that goes before all votes.
MOST = 500.0
#: Characters by which cut-off texts are grouped with the texts they may begin; sources of one value paired by one task.
HEAD, TOGETHER = 40, 200


def text_key(c: Column) -> Column:
    """Letters and digits of a text in lower case, without markup and a mark of omission; NULL if none is left."""
    bare = F.regexp_replace(c, r"(?i)&lt;|&gt;", "\u0001")
    bare = F.regexp_replace(bare, r"(?i)<[^<>]*>|\x01[^\x01]*\x01|&\w+;|andlt(?:(?!andlt|andgt)[^<>])*andgt|and(?:amp|nbsp|quot)\b", " ")
    bare = F.regexp_replace(bare, r"(?i)(?:<[^<>]*|&\w*|andlt(?:(?!andlt|andgt)[^<>])*|\x01[^\x01]*)?\s*(?:…|\.\.\.)?\s*$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def cut_off(rows: DataFrame, item: str, key: str, text: str) -> DataFrame:
    """Keys of rows whose text key is a proper beginning of another text of the same item.

    Texts that share their first HEAD characters are compared in sorted order, where a beginning
    stands directly before an extension of it. Shorter texts are looked up among the beginnings of
    the heads. No pairs are made, and an item of many rows is spread over its heads.
    """
    texts = rows.where(F.col(text).isNotNull()).select(item, F.col(text).alias("_t")).distinct().withColumn("_h", F.xxhash64(F.substring("_t", 1, HEAD)))
    by = Window.partitionBy(item, "_h").orderBy("_t")
    long = texts.where(F.length("_t") >= HEAD).withColumn("_next", F.lead("_t").over(by)).where(F.expr("startswith(_next, _t)")).select(item, "_t")
    short = texts.where(F.length("_t") < HEAD).select(item, "_t")
    heads = texts.join(short.select(item).distinct(), item, "left_semi").select(item, F.substring("_t", 1, HEAD).alias("_s"), (F.length("_t") > HEAD).alias("_more")).distinct()
    begins = heads.select(item, F.explode(F.expr(f"transform(sequence(1, least({HEAD - 1}, length(_s) - 1 + int(_more))), n -> substring(_s, 1, n))")).alias("_t")).where(F.length("_t") > 0).distinct()
    cut = long.unionByName(short.join(begins, [item, "_t"], "left_semi")).distinct()
    return rows.select(item, key, F.col(text).alias("_t")).join(cut, [item, "_t"], "left_semi").select(key)


def _voted(claims: DataFrame) -> DataFrame:
    """Values (item, value) with their votes and the probability `p` among the item's values; claims: item, value, source, acc, indep."""
    weight = F.log(F.lit(float(FALSE_VALUES)) * F.col("acc") / (1 - F.col("acc")))
    votes = F.greatest(F.lit(-MOST), F.least(F.sum(weight * F.col("indep")), F.lit(MOST)))
    score = claims.groupBy("item", "value").agg(votes.alias("score"))
    # the values of an item are summed up by a salted aggregation, so a hot item has no task of its own
    salted = score.groupBy("item", F.pmod(F.col("value"), F.lit(16)).alias("salt")).agg(F.sum(F.exp("score")).alias("z"))
    return score.join(salted.groupBy("item").agg(F.sum("z").alias("z")), "item").select("item", "value", "score", (F.exp("score") / F.col("z")).alias("p"))


def _together(claims: DataFrame, keys: list[str], sums: list[Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs a < b of distinct sources that share the keys, with sums over what they share.

    Summed before the shuffle, never of rows; a key with many sources is spread over salted parts, each
    of which meets the whole.
    """
    size = claims.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = claims.join(size, keys)
    one = told.withColumnRenamed("source", "a").withColumn("s", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    two = told.select(*keys, F.col("source").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    return one.join(two, [*keys, "s"]).where("a < b").groupBy("a", "b", *by).agg(*sums)


def _common(claims: DataFrame) -> DataFrame:
    """Pairs of sources with the number of items both claim, and of those for which they share a value."""
    items = _together(claims.select("item", "source").distinct(), ["item"], [F.count(F.lit(1)).alias("items")])
    return items.join(_together(claims, ["item", "value"], [F.count_distinct("item").alias("same")]), ["a", "b"])


def _copying(claims: DataFrame, common: DataFrame, values: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Pairs (original, copier, dependence) of sources, from how many true, false and different values they have in common.

    Values that both have and that are true tell a little of copying, false ones much, different ones speak
    against it. The source of higher accuracy is taken as the original.
    """
    acc = lambda c: accuracy.select(F.col("source").alias(c), F.col("acc").alias(f"acc_{c}"))
    told = claims.join(values.select("item", "value", "p"), ["item", "value"]).select("item", "value", "source", "p")
    # a value that may be true or false tells by the mixture of both; probabilities in steps of a twentieth, so that a pair keeps few sums
    told = told.withColumn("p", F.bround(F.col("p") * 20) / 20)
    shared = _together(told, ["item", "value"], [F.count(F.lit(1)).alias("n")], ["p"])
    pair = shared.join(acc("a"), "a").join(acc("b"), "b")
    best, c, p = F.greatest("acc_a", "acc_b"), COPY_RATE, F.col("p")
    both_true, both_false = F.col("acc_a") * F.col("acc_b"), (1 - F.col("acc_a")) * (1 - F.col("acc_b")) / FALSE_VALUES
    alone = p * both_true + (1 - p) * both_false
    pair = pair.groupBy("a", "b").agg(F.first("acc_a").alias("acc_a"), F.first("acc_b").alias("acc_b"), F.sum(F.col("n") * F.log(c * (p * best + (1 - p) * (1 - best)) / alone + 1 - c)).alias("told"))
    pair = pair.join(common, ["a", "b"])
    odds = log(DEPENDENT / (1 - DEPENDENT)) + F.col("told") + (F.col("items") - F.col("same")) * log(1 - c)
    first = F.struct((-F.col("acc_a")).alias("x"), "a") < F.struct((-F.col("acc_b")).alias("x"), F.col("b").alias("a"))
    return pair.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("original"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("copier"), (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(odds, F.lit(50.0)))))).alias("dependence"))


def _independent(claims: DataFrame, copying: DataFrame) -> DataFrame:
    """Claims with the share of each vote that isn't copied from an original of the same value."""
    from_ = claims.join(copying, claims["source"] == copying["copier"]).select("item", "value", F.col("source"), "original", "dependence")
    also = claims.select("item", "value", F.col("source").alias("original"))
    lost = from_.join(also, ["item", "value", "original"]).groupBy("item", "value", "source").agg(F.sum(F.log(1 - COPY_RATE * F.col("dependence"))).alias("lost"))
    return claims.join(lost, ["item", "value", "source"], "left").withColumn("indep", F.exp(F.coalesce("lost", F.lit(0.0)))).drop("lost")


def fuse(rows: DataFrame, item: str, key: str, source: str, value: str, priors: list[tuple[Column, int]]) -> DataFrame:
    """The surviving row of each item: item, key, posterior, votes.

    value: a comparable form of the claimed value; rows with a null item or value claim nothing.
    priors: whole-number columns with their weights; the sum of weight times column is the prior log
    odds of a row, a null counting as 0. posterior and votes
    are those of the row's value without priors. What is still equal goes to the smallest key. An item
    without a claim has no row. Any number of sources is told apart; a null source is one as well.
    """
    prior = F.lit(0).cast("decimal(38,6)")
    for column, weight in priors:
        prior = prior + (F.coalesce(column.cast("bigint"), F.lit(0)).cast("decimal(18,0)") * F.lit(Decimal(weight))).cast("decimal(38,6)")
    base = rows.where(F.col(item).isNotNull() & F.col(value).isNotNull()).select(
        F.col(item).alias("item"), F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(value).alias("value"), prior.cast("decimal(38,6)").alias("prior")
    )
    base = materialize(base, "claims")
    claims = materialize(base.select("item", "source", "value").distinct(), "votes")
    accuracy = claims.select("source").distinct().withColumn("acc", F.lit(ACCURACY))
    # at first all values of an item are as likely, lest copies of one another confirm themselves
    values = claims.select("item", "value").distinct()
    values = values.join(values.groupBy("item").agg((1 / F.count(F.lit(1))).alias("p")), "item")
    common = materialize(_common(claims), "common")
    for n in range(ROUNDS):
        told = _independent(claims, _copying(claims, common, values, accuracy))
        values = materialize(_voted(told.join(accuracy, "source")), "posterior")
        if n < ROUNDS - 1:
            judged = claims.join(values, ["item", "value"]).groupBy("source").agg(F.avg("p").alias("acc"))
            accuracy = materialize(judged.select("source", F.greatest(F.lit(ACCURACIES[0]), F.least("acc", F.lit(ACCURACIES[1]))).alias("acc")), "accuracy")  # one row for each source
    score = F.col("score").cast("decimal(38,6)")
    best = F.struct((F.col("prior") + score).alias("log_posterior"), (-F.col("key")).alias("neg"), "key", "p", "score")
    return base.join(values, ["item", "value"]).groupBy("item").agg(F.max(best).alias("b")).select(F.col("item").alias(item), F.col("b.key").alias(key), F.bround("b.p", 6).alias("posterior"), F.bround("b.score", 6).alias("votes"))
