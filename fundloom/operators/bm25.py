"""Phrase matching and field-weighted BM25 classification with a keyword taxonomy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.functions import text as tx
from fundloom.session import BROADCAST_ROWS, broadcast_if_small, materialize, spread

TIERS = ("exact", "collapsed", "stem")


@dataclass(frozen=True)
class Parameters:
    """Constants of the score and of the confidence tiers."""

    k1: float = 1.2
    b: float = 0.75
    alpha: float = 0.5
    title: float = 2.0
    high_margin: float = 0.5
    high_terms: int = 3
    medium_margin: float = 0.2


def surfaces(term: Column) -> Column:
    """The three forms of a phrase: its tokens, those without inner marks, and in the singular."""
    words = tx.tokens(term)
    join = lambda a: F.array_join(a, " ")
    return F.struct(F.size(words).alias("size"), join(words).alias("exact"), join(F.transform(words, tx.collapse)).alias("collapsed"), join(F.transform(words, tx.fold_plural)).alias("stem"))


def matches(docs: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """Occurrences of each term (column term): key, field, sentence, pos, term, how.

    A phrase is a window of tokens within one sentence; each start counts once, in its strongest
    form. Windows are exploded where the text lies and meet the terms by a hash join; terms grow with
    the taxonomy, so they are counted before they are broadcast.
    """
    t = terms.select("term").distinct().select("term", surfaces(F.col("term")).alias("s")).where("s.size > 0")
    n = t.count()
    sizes = [r[0] for r in t.select("s.size").distinct().collect()]  # lengths of phrases, a handful
    forms = t.select("term", "s.size", F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.col(f"s.{h}").alias("w")) for i, h in enumerate(TIERS)])).alias("f")).select("term", "size", "f.tier", "f.w")
    long = spread(docs.select(key, *fields)).select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in fields])).alias("f"))
    sent = long.select(key, "f.field", F.posexplode(tx.sentences(F.col("f.x"))).alias("sentence", "s"))
    words = sent.select(key, "field", "sentence", tx.tokens(F.col("s")).alias("w0")).withColumns({"w1": F.transform("w0", tx.collapse), "w2": F.transform("w0", tx.fold_plural)})
    kinds = [F.col("w0"), F.col("w1"), F.col("w2")]
    at = lambda a, i: F.transform(F.sequence(F.lit(1), F.size(a) - (i - 1)), lambda p: F.struct(p.alias("pos"), F.array_join(F.slice(a, p, i), " ").alias("w")))
    one = lambda i, tier: F.when(F.size("w0") >= i, F.transform(at(kinds[tier], i), lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"), F.lit(i).alias("size"), F.lit(tier).alias("tier")))).otherwise(F.array().cast("array<struct<pos:int,w:string,size:int,tier:int>>"))
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, field string, sentence int, pos int, term string, how string")
    windows = words.select(key, "field", "sentence", F.explode(F.concat(*[one(i, tier) for i in sorted(sizes) for tier in range(3)])).alias("x")).select(key, "field", "sentence", "x.*")
    hit = windows.join(broadcast_if_small(forms, 3 * n, BROADCAST_ROWS), ["size", "tier", "w"])
    best = hit.groupBy(key, "field", "sentence", "pos", "term").agg(F.min("tier").alias("tier"))
    return best.select(key, "field", "sentence", "pos", "term", F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("tier") + 1).alias("how"))


def term_counts(found: DataFrame, key: str, title: str) -> DataFrame:
    """Occurrences of each term of a document in the title and elsewhere, and its strongest form."""
    rank = F.when(F.col("how") == "exact", 0).when(F.col("how") == "collapsed", 1).otherwise(2)
    return found.groupBy(key, "term").agg(F.count_if(F.col("field") == title).alias("tf_title"), F.count_if(F.col("field") != title).alias("tf_rest"), F.min(rank).alias("tier"))


def idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency, not below 0."""
    x = 1 + (n_docs - df + 0.5) / (df + 0.5)
    return F.when(x > 0, F.greatest(F.log(x), F.lit(0.0))).otherwise(0.0)


def saturation(tf: Column, length: Column, mean: Column, p: Parameters) -> Column:
    d = tf + p.k1 * (1 - p.b + p.b * F.when(mean > 0, length / mean).otherwise(0.0))
    return F.when(tf > 0, tf * (p.k1 + 1) / d).otherwise(0.0)


def leaf_scores(docs: DataFrame, counts: DataFrame, key: str, title: str, rest: str, taxonomy: DataFrame, p: Parameters) -> DataFrame:
    """Score of each leaf that a term of a document speaks for or against: key, leaf, score, n_terms.

    taxonomy: leaf, term, weight (below 0 for terms that speak against). Leaves without a hit have
    the score 0 and no row; decide() counts them in.
    """
    length = p.title * F.size(tx.tokens(F.col(title))) + F.size(tx.tokens(F.col(rest)))
    lengths = docs.select(key, length.alias("len"))
    corpus = lengths.agg(F.avg("len").alias("mean"), F.count(F.lit(1)).cast("double").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = taxonomy.join(df, "term", "left").fillna(0, "df").join(F.broadcast(corpus), F.lit(True)).withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    norm = weighed.where("weight > 0").groupBy("leaf").agg(F.sum(F.col("weight") * F.col("idf")).alias("mass")).select("leaf", F.when(F.col("mass") > 0, F.pow("mass", F.lit(p.alpha))).otherwise(1.0).alias("norm"))
    terms = weighed.select("leaf", "term", "weight", "idf", "mean").join(norm, "leaf")
    tf = p.title * F.col("tf_title") + F.col("tf_rest")
    x = counts.join(terms, "term").join(lengths, key).withColumn("part", F.col("weight") * F.col("idf") * saturation(tf, F.col("len"), F.col("mean"), p))
    return x.groupBy(key, "leaf").agg((F.sum("part") / F.max("norm")).alias("score"), F.count_if(F.col("weight") > 0).alias("n_terms"))


def decide(docs: DataFrame, scores: DataFrame, key: str, title: str, rest: str, leaves: DataFrame, placeholders: list[str], p: Parameters) -> DataFrame:
    """Leaf, runner-up, margins, confidence tier or the reason for none of every document.

    leaves: leaf, n_leaf_terms. A leaf without a row has the score 0; ties go to the smaller leaf.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "leaf", "n_terms")))
    ids = leaves.agg(F.array_sort(F.collect_list("leaf")).alias("_ids"))  # a taxonomy's leaves
    top = scores.groupBy(key).agg(ranked.alias("_r"))
    bare = F.trim(F.lower(F.regexp_replace(tx.clean_title(F.col(title)), r"[.!]+$", "")))
    told = docs.select(key, (F.size(tx.tokens(F.col(title))) == 0).alias("_no_title"), (F.size(tx.tokens(F.col(rest))) == 0).alias("_no_rest"), bare.isin(placeholders).alias("_bare"))
    x = told.join(top, key, "left").join(F.broadcast(ids), F.lit(True))
    seen = F.coalesce(F.transform("_r", lambda r: r["leaf"]), F.array().cast("array<int>"))
    zero = F.transform(F.array_except("_ids", seen), lambda i: F.struct(F.lit(0.0).alias("s"), i.alias("leaf"), F.lit(0).cast("bigint").alias("n_terms")))
    all_ = F.array_sort(F.concat(F.coalesce("_r", F.array().cast("array<struct<s:double,leaf:int,n_terms:bigint>>")), zero))
    x = x.withColumn("_a", all_).withColumn("one", F.element_at("_a", 1)).withColumn("two", F.when(F.size("_a") > 1, F.element_at("_a", 2)).otherwise(F.element_at("_a", 1)))
    s1, s2 = -F.col("one.s"), -F.col("two.s")
    reason = F.when(F.col("_no_title") & F.col("_no_rest"), "no_usable_text").when(F.col("_no_rest") & F.col("_bare"), "placeholder_title_only").when(s1 <= 0, "no_keyword_evidence")
    x = x.withColumn("reason", reason).join(leaves.withColumnRenamed("leaf", "_l"), F.col("one.leaf") == F.col("_l"), "left")
    given = F.col("reason").isNull()
    margin = F.when(given, (s1 - s2) / s1).otherwise(0.0)
    n = F.when(given, F.col("one.n_terms")).otherwise(0)
    tier = F.when(~given, "none").when((margin >= p.high_margin) & (n >= p.high_terms), "high").when((margin >= p.medium_margin) & (n >= 1), "medium").otherwise("low")
    return x.select(
        key,
        F.when(given, F.col("one.leaf")).otherwise(-1).alias("leaf"),
        F.when(given, F.col("two.leaf")).alias("leaf2"),
        F.when(given, F.bround(s1, 6)).otherwise(0.0).alias("score1"),
        F.when(given, F.bround(s2, 6)).otherwise(0.0).alias("score2"),
        F.bround(margin, 6).alias("margin"),
        n.alias("n_terms"),
        F.when(given, F.bround(n / F.col("n_leaf_terms"), 6)).otherwise(0.0).alias("coverage"),
        tier.alias("tier"),
        "reason",
    )


_SETTING, _SWEPT_TIERS = ["k1", "b", "title", "high_terms"], ("none", "low", "medium", "high")


def _swept(docs: DataFrame, counts: DataFrame, key: str, title: str, rest: str, taxonomy: DataFrame, settings: list[tuple[float, float, float]], high_terms: list[int], p: Parameters) -> DataFrame:
    """One row for each document with a term: key, its leaf under each setting (_leaf), its tier under each setting and number of terms (_tier).

    Settings multiply nothing that is shuffled: the terms of a document meet once, and each batch of documents is
    scored under all settings on arrays.
    """
    size = lambda c: F.size(tx.tokens(F.col(c)))
    lengths = docs.select(key, size(title).alias("lt"), size(rest).alias("lr"))
    corpus = lengths.agg(F.avg("lt").alias("mt"), F.avg("lr").alias("mr"), F.count(F.lit(1)).cast("double").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = taxonomy.join(df, "term", "left").fillna(0, "df").join(F.broadcast(corpus), F.lit(True)).withColumn("idf", idf(F.col("n_docs"), F.col("df")))
    norm = weighed.where("weight > 0").groupBy("leaf").agg(F.sum(F.col("weight") * F.col("idf")).alias("mass")).select("leaf", F.when(F.col("mass") > 0, F.pow("mass", F.lit(p.alpha))).otherwise(1.0).alias("norm"))
    terms = weighed.select("leaf", "term", "weight", "idf", "mt", "mr").join(norm, "leaf")
    names = ("leaf", "weight", "idf", "norm", "tf_title", "tf_rest")
    told = F.array_sort(F.collect_list(F.struct("leaf", "term", *names[1:])))  # a taxonomy's terms at most
    met = counts.join(terms, "term").groupBy(key).agg(told.alias("_e"), F.max("mt").alias("mt"), F.max("mr").alias("mr"))
    met = met.join(lengths, key).select(key, "lt", "lr", "mt", "mr", *[F.col(f"_e.{c}").alias(c) for c in names])
    ids = np.array(sorted(r[0] for r in taxonomy.select("leaf").distinct().collect()))  # a taxonomy's leaves

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if x.empty:
                continue
            n = len(x)
            row = np.repeat(np.arange(n), x["leaf"].map(len))
            leaf, weight, own, mass, in_title, in_rest = (np.concatenate(x[c].to_numpy()) for c in names)
            cell = row * len(ids) + np.searchsorted(ids, leaf)
            grid = lambda v: np.bincount(cell, v, n * len(ids)).reshape(n, len(ids))
            hit, positive, divisor = grid(None) > 0, grid((weight > 0) * 1.0), np.ones(n * len(ids))
            divisor[cell] = mass
            divisor = divisor.reshape(n, len(ids))
            lt, lr, mt, mr = (x[c].to_numpy(float) for c in ("lt", "lr", "mt", "mr"))
            leaves, tiers, at, few = [], [], np.arange(n), hit.sum(1) < len(ids)
            for k1, b, w in settings:
                length, mean = w * lt + lr, w * mt + mr
                share = np.divide(length, mean, out=np.zeros(n), where=mean > 0)
                tf = w * in_title + in_rest
                part = weight * own * tf * (k1 + 1) / (tf + k1 * (1 - b + b * share[row]))
                score = np.where(hit, grid(part) / divisor, -np.inf)
                one = score.argmax(1)  # the smallest leaf on ties
                s1, terms_ = score[at, one], positive[at, one]
                score[at, one] = -np.inf
                s2 = score.max(1)
                s2 = np.where(few, np.maximum(s2, 0.0), s2)  # a leaf without a term has the score 0
                given = s1 > 0
                margin = np.divide(s1 - s2, s1, out=np.zeros(n), where=given)
                leaves.append(np.where(given, ids[one], -1))
                tiers += [np.select([~given, (margin >= p.high_margin) & (terms_ >= h), (margin >= p.medium_margin) & (terms_ >= 1)], [0, 3, 2], 1) for h in high_terms]
            yield pd.DataFrame({key: x[key], "_leaf": list(np.stack(leaves, 1).astype("int32")), "_tier": list(np.stack(tiers, 1).astype("int8"))})

    return met.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, _leaf array<int>, _tier array<tinyint>")


def _told(settings: list[tuple[float, float, float]], high_terms: list[int]) -> list[Column]:
    """The columns of a setting by its place (_i) in the tiers of _swept()."""
    own = F.floor(F.col("_i") / len(high_terms)).cast("int") + 1
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i)
    return [*(pick(v, own).alias(c) for c, v in zip(_SETTING, zip(*settings))), pick(high_terms, F.col("_i") % len(high_terms) + 1).alias("high_terms")]


def _exploded(swept: DataFrame, high_terms: list[int], *columns: str) -> DataFrame:
    """A row for each place in the tiers of _swept(): the columns, _i, leaf, tier (its place in _SWEPT_TIERS)."""
    x = swept.select(*columns, "_leaf", F.posexplode("_tier").alias("_i", "tier"))
    return x.select(*columns, "_i", F.element_at("_leaf", F.floor(F.col("_i") / len(high_terms)).cast("int") + 1).alias("leaf"), "tier")


def sweep(docs: DataFrame, counts: DataFrame, key: str, title: str, rest: str, taxonomy: DataFrame, settings: list[tuple[float, float, float]], high_terms: list[int], p: Parameters) -> DataFrame:
    """Decisions of every document under each setting (k1, b, title weight) and least number of terms of the high tier.

    Returns k1, b, title, high_terms, key, leaf (-1: none), tier. The matches are counted once; all settings are
    scored in one job. A document without a term has no row.
    """
    x = _exploded(_swept(docs, counts, key, title, rest, taxonomy, settings, high_terms, p), high_terms, key)
    return x.select(*_told(settings, high_terms), key, "leaf", F.element_at(F.array(*map(F.lit, _SWEPT_TIERS)), F.col("tier").cast("int") + 1).alias("tier"))


def sweep_adopted(docs: DataFrame, counts: DataFrame, key: str, title: str, rest: str, taxonomy: DataFrame, settings: list[tuple[float, float, float]], high_terms: list[int], p: Parameters, gold: DataFrame, answer: str) -> DataFrame:
    """adopt() of sweep() with the settings of p as baseline; the gold rows are joined before the settings are spread out, so those cross no shuffle."""
    swept = _swept(docs, counts, key, title, rest, taxonomy, settings, high_terms, p).join(gold.where(F.col(answer).isNotNull()), key, "left")
    x = materialize(_exploded(swept, high_terms, answer).groupBy("_i").agg(*_tally(answer, F.col("tier") == 3)), "tallies")  # used twice
    return _adopted(x.select(*_told(settings, high_terms), "assigned", "high", "hits"), gold, answer, (p.k1, p.b, p.title, p.high_terms))


def _tally(answer: str, high: Column) -> list[Column]:
    return [F.count_if(F.col("leaf") >= 0).alias("assigned"), F.count_if(high).alias("high"), F.count_if(F.col("leaf") == F.col(answer)).alias("hits")]


def _adopted(x: DataFrame, gold: DataFrame, answer: str, baseline: tuple[float, float, float, int]) -> DataFrame:
    x = x.withColumn("n", F.lit(gold.where(F.col(answer).isNotNull()).count()))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    base = x.where((F.col("k1") == baseline[0]) & (F.col("b") == baseline[1]) & (F.col("title") == baseline[2]) & (F.col("high_terms") == baseline[3])).select((F.col("hits") / F.col("n")).alias("base"), ((hi - lo) / 2).alias("half"))
    return x.join(F.broadcast(base), F.lit(True)).select(*_SETTING, "assigned", "high", F.bround(F.col("hits") / F.col("n"), 6).alias("accuracy"), (F.col("hits") / F.col("n") > F.col("base") + F.col("half")).alias("adopt"))


def adopt(found: DataFrame, gold: DataFrame, key: str, answer: str, baseline: tuple[float, float, float, int]) -> DataFrame:
    """Accuracy of each setting of sweep() on gold rows, and whether it beats the baseline's by half its Wilson interval."""
    hit = found.join(gold.where(F.col(answer).isNotNull()), key, "left")
    return _adopted(hit.groupBy(*_SETTING).agg(*_tally(answer, F.col("tier") == "high")), gold, answer, baseline)


def taxonomy_faults(taxonomy: DataFrame, leaves: DataFrame) -> DataFrame:
    """Errors and warnings of a taxonomy, one row each: level, rule, item."""
    rules = [
        ("error", "term in no known leaf", taxonomy.join(leaves, "leaf", "left_anti").select(F.col("term").alias("item"))),
        ("error", "leaf without terms", leaves.join(taxonomy.where("weight > 0"), "leaf", "left_anti").select(F.col("leaf").cast("string").alias("item"))),
        ("error", "term twice in a leaf", taxonomy.groupBy("leaf", "term").count().where("count > 1").select(F.col("term").alias("item"))),
        ("warning", "term in several leaves", taxonomy.where("weight > 0").groupBy("term").agg(F.count_distinct("leaf").alias("n")).where("n > 1").select(F.col("term").alias("item"))),
        ("warning", "term without text", taxonomy.where(F.trim("term") == "").select(F.col("leaf").cast("string").alias("item"))),
    ]
    out = None
    for level, rule, df in rules:
        x = df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), "item")
        out = x if out is None else out.unionByName(x)
    return out


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    n = n.cast("double")  # the square of a whole number overflows
    p = hits / n
    mid, half, d = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / d, (mid + half) / d


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, dimension by dimension in partial aggregates."""
    e = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def unit_vector(v: Column) -> Column:
    """v at length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def rank_over(group: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))
