"""References to records that do not exist at the time of the referring row.

A split-block Bloom filter of the parent keys, built by a map-side-combined aggregation, proves most
orphans; only references that pass it are joined with the parents' life times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.session import BROADCAST_ROWS, broadcast_if_small, materialize

#: Filter bits for a key and bits of a block (four 64-bit words, one bit set in each); most blocks, about 64 MB as a broadcast.
#: Up to 22 million keys about one missing key in 100 passes the filter; with more keys more do (at 130 million two in three), which only
#: leaves more references to the exact join.
BITS_PER_KEY, BLOCK_BITS, MOST_BLOCKS = 12, 256, 1 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int")) for i in range(4)]


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as a table (`b`, `w0`..`w3`) of at most n_keys * 12 / 256 rows, never more than MOST_BLOCKS, and its number of blocks."""
    blocks = min(MOST_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS)))
    bits = _bits(F.col(key))
    return keys.groupBy(_block(F.col(key), blocks).alias("b")).agg(*[F.bit_or(bits[i]).alias(f"w{i}") for i in range(4)]), blocks


def missing_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a live target.

    refs: target, key, at and any other columns; parents: target, key, since, until. A target row is
    live at `at` if since <= at and until is null or later. References with a null key refer to
    nothing and never come out; a null `at` or `since` compares as not live. Repeated rows of refs
    come out as often as they went in; without parents every reference is missing.
    """
    ref_key = F.concat_ws("\u0001", "target", "key")
    refs = refs.where(F.col("key").isNotNull()).withColumn("_k", ref_key)
    # an open-ended life time needs only its earliest start; the others one row for each end
    lives = (
        parents.where(F.col("key").isNotNull() & F.col("since").isNotNull())
        .groupBy(ref_key.alias("_k"), F.col("until").alias("_until"))
        .agg(F.min("since").alias("_since"))
    )
    lives = materialize(lives, "lives")
    n = lives.count()
    filter_table, blocks = bloom_blocks(lives.select("_k"), "_k", n)
    filter_table = F.broadcast(filter_table.withColumnRenamed("b", "_b"))  # at most MOST_BLOCKS rows
    bits = _bits(F.col("_k"))
    passes = F.lit(True)
    for i in range(4):
        passes = passes & (F.col(f"w{i}").bitwiseAND(bits[i]) != 0)
    probed = (
        refs.withColumn("_b", _block(F.col("_k"), blocks))
        .join(filter_table, "_b", "left")
        .withColumn("_maybe", F.coalesce(passes, F.lit(False)))
        .drop("_b", "w0", "w1", "w2", "w3")
    )
    # only the filter-positive references are verified; definite orphans get keys that meet nothing, spread over many
    nothing = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    lives = broadcast_if_small(lives.withColumnRenamed("_k", "_p"), n, BROADCAST_ROWS)
    live = (
        (F.col("_j") == F.col("_p"))
        & (F.col("_since") <= F.col("at"))
        & (F.col("_until").isNull() | (F.col("_until") > F.col("at")))
    )
    probed = probed.withColumn("_j", F.when(F.col("_maybe"), F.col("_k")).otherwise(nothing))
    return probed.join(lives, live, "left_anti").drop("_k", "_maybe", "_j")


def reference_rates(refs: DataFrame, missing: DataFrame, period: str = "month") -> DataFrame:
    """References and missing references per table, field and period of `at`, pre-aggregated before the shuffle."""
    when = F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period")
    both = refs.where(F.col("key").isNotNull()).select("ref_table", "ref_field", when, F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(
        missing.select("ref_table", "ref_field", when, F.lit(0).alias("n"), F.lit(1).alias("m"))
    )
    return both.groupBy("ref_table", "ref_field", "period").agg(F.sum("n").alias("n_refs"), F.sum("m").alias("n_missing"))
