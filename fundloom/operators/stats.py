"""Concentration, shares, cumulative and rolling measures, profiles and pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.session import materialize


def one() -> Column:
    return F.count(F.lit(1))


def whole() -> Window:
    """All rows of a frame as one window; for aggregated results of dimension size only."""
    return Window.partitionBy(F.lit(1))


def share(c: str, over: list[str] | None = None) -> Column:
    """c as a share of its sum within the partition."""
    return F.col(c) / F.sum(c).over(Window.partitionBy(*(over or [F.lit(1)])))


def value_steps(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their number, and numbers and sums below each (n, v, below_n, below_sum).

    Ranks of all rows follow from the distinct values, which a partial aggregation makes first;
    the values are ranked within range partitions, whose totals alone meet in one place. The number
    of each value's partition is written down, lest it change between the two reads.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(one().alias("n"))
    steps = materialize(steps.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("_p", F.spark_partition_id()), "steps")
    part = steps.groupBy("_p").agg(F.sum("n").alias("pn"), F.sum(F.col("n") * F.col("v")).alias("ps"))
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("_p", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("pn"), F.coalesce(F.sum("ps").over(before), F.lit(0.0)).alias("ps"))
    inner = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        steps.withColumn("bn", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .withColumn("bs", F.coalesce(F.sum(F.col("n") * F.col("v")).over(inner), F.lit(0.0)))
        .join(F.broadcast(part), "_p")
        .select("v", "n", (F.col("bn") + F.col("pn")).alias("below_n"), (F.col("bs") + F.col("ps")).alias("below_sum"))
    )


def gini(df: DataFrame, value: str, positive_only: bool = True) -> DataFrame:
    """Gini coefficient (one row: gini, n, total): closed form over the ordered values."""
    d = df.where(F.col(value) > 0) if positive_only else df.where(F.col(value) >= 0)
    s = value_steps(d, value)
    # the ranks of n equal values sum to n * below + n * (n + 1) / 2
    ranked = F.sum(F.col("v") * (F.col("n") * F.col("below_n") + F.col("n") * (F.col("n") + 1) / 2))
    agg = s.agg(ranked.alias("r"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("total"))
    return agg.select(F.when(F.col("total") > 0, F.bround(2 * F.col("r") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"), 6)).alias("gini"), "n", F.bround("total", 2).alias("total"))


def gini_trapezoid(df: DataFrame, value: str) -> DataFrame:
    """One less twice the area under the Lorenz curve by trapezoids, zeros included."""
    s = value_steps(df.where(F.col(value) >= 0), value)
    area = F.sum(F.col("n") * (2 * F.col("below_sum") + F.col("n") * F.col("v")) / 2)
    agg = s.agg(area.alias("a"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("t"))
    return agg.select(F.bround(1 - 2 * F.col("a") / (F.col("n") * F.col("t")), 6).alias("gini"))


def top_share(df: DataFrame, value: str, least: Column) -> DataFrame:
    """Share of the total that the largest rows hold, their number given by an expression of all_n (one row: k, share)."""
    s = value_steps(df, value)
    total = s.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("v")).alias("T")).select("T", "all_n", least.cast("bigint").alias("k"))
    above = F.col("all_n") - F.col("below_n") - F.col("n")  # rows of larger values
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - above))
    return s.join(F.broadcast(total), F.lit(True)).agg(F.max("k").alias("k"), F.bround(F.sum(taken * F.col("v")) / F.max("T"), 6).alias("share"))


def people_to_reach(df: DataFrame, value: str, part: float) -> DataFrame:
    """How many of the largest rows it takes to pass a part of the total: those within it and one more."""
    s = value_steps(df, value)
    total = s.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("v")).alias("T"))
    upto = F.col("T") - F.col("below_sum") - F.col("n") * F.col("v")  # sum of larger values
    fits = F.when(F.col("v") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((part * F.col("T") - upto) / F.col("v") + 1e-9)))).otherwise(0)
    return s.join(F.broadcast(total), F.lit(True)).agg((F.sum(fits) + 1).alias("people"))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls and distinct values of every column, in one pass: field, n_null, n_distinct, n_rows."""
    cols = df.columns
    wide = df.agg(one().alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__0") for c in cols], *[F.count_distinct(c).alias(f"{c}__1") for c in cols])
    return wide.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}__0").alias("n_null"), F.col(f"{c}__1").alias("n_distinct")) for c in cols])).alias("x")).select("x.*", F.col("_n").alias("n_rows"))


def stack_counts(df: DataFrame, groups: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each named field with its conditional counts, from one pass over df."""
    names = sorted({k for g in groups.values() for k in g})
    wide = df.agg(*[F.coalesce(c, F.lit(0)).alias(f"{f}__{k}") for f, g in groups.items() for k, c in g.items()])
    rows = [F.struct(F.lit(f).alias("field"), *[(F.col(f"{f}__{k}") if k in g else F.lit(0)).cast("bigint").alias(k) for k in names]) for f, g in groups.items()]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def year_series(df: DataFrame, key: str, year: str, first: int, last: int, keys: DataFrame) -> DataFrame:
    """Counts of each key and year from first to last, zeros included, and what lies before as year first - 1."""
    n = df.where(F.col(year).isNotNull() & (F.col(year) <= last)).groupBy(key, F.greatest(F.col(year), F.lit(first - 1)).alias("year")).agg(one().alias("n"))
    spine = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first - 1), F.lit(last))).alias("year"))
    return spine.join(n, [key, "year"], "left").select(key, "year", F.coalesce("n", F.lit(0)).alias("n"))


def pivot_cells(df: DataFrame, rows: str, columns: str, measure: str) -> DataFrame:
    """Cells, both margins and the total of two facets: level (cell, row, column, total), n and sum. Null facets count as their own level."""
    f = df.select(F.coalesce(F.col(rows).cast("string"), F.lit("(unknown)")).alias("r"), F.coalesce(F.col(columns).cast("string"), F.lit("(unknown)")).alias("c"), F.col(measure).alias("m"))
    g = f.cube("r", "c").agg(F.grouping_id().alias("g"), one().alias("n"), F.bround(F.sum("m"), 2).alias("amount"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "row").when(F.col("g") == 2, "column").otherwise("total")
    return g.select(level.alias("level"), F.coalesce("r", F.lit("(all)")).alias("r"), F.coalesce("c", F.lit("(all)")).alias("c"), "n", "amount")


def sum_columns(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) for n in names])
