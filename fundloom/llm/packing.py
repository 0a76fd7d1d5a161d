"""Filling containers of fixed capacity with token sequences by balanced attention cost.

Texts are dealt to shards of about SEQUENCES containers, however many these make; within a shard texts go in descending
length to the cheapest sequence (linear plus quadratic cost) that still has room. As many sequences
are opened at once as the tokens need at least; what finds no room opens further ones. A text is
split only if it alone exceeds the capacity: its full pieces fill containers of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers of a shard; cost of a token and of a pair of tokens of one text.
SEQUENCES, LINEAR, QUADRATIC = 256, 1.0, 1.0 / 1024
OUT = "container string, capacity int, doc_id bigint, piece int, tokens int, bin string"


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each size (all <= capacity), dealt in descending order; equal costs go to the first sequence."""
    order = np.argsort(-sizes, kind="stable")
    out = np.full(len(sizes), -1, dtype=np.int64)
    opened = 0
    while len(order):
        n = max(1, -(-int(sizes[order].sum()) // capacity))
        cost, room = np.zeros(n), np.full(n, capacity, dtype=np.int64)
        left = []
        for i in order:
            s = int(sizes[i])
            k = int(np.argmin(np.where(room >= s, cost, np.inf)))
            if room[k] < s:
                left.append(i)
                continue
            out[i] = opened + k
            room[k] -= s
            cost[k] += linear * s + quadratic * s * s
        opened += n
        order = np.array(left, dtype=np.int64)
    return out


def pack_documents(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Container of each text or piece.

    items: doc_id, tokens (null counts as 0); capacities: container, capacity (a small fixed table;
    rows with a null or non-positive capacity are passed over). A text without tokens takes no room
    and lies in the cheapest sequence. Repeated doc_ids are items of their own. Without items or
    capacities there are no rows.
    """
    kinds = [(r["container"], r["capacity"]) for r in capacities.select("container", "capacity").distinct().collect() if r["capacity"] and r["capacity"] > 0]
    total = items.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    spark = items.sparkSession
    if not kinds or not total["n"]:
        return spark.createDataFrame([], OUT)
    kind = [
        F.struct(F.lit(name).alias("container"), F.lit(c).alias("capacity"), F.lit(max(1, -(-int(total["t"] or 0) // (c * SEQUENCES)), -(-total["n"] // 50_000))).cast("bigint").alias("shards"))
        for name, c in kinds
    ]
    pieces = items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("n"), F.explode(F.array(*kind)).alias("k")).select(
        "doc_id",
        "k.container",
        "k.capacity",
        "k.shards",
        F.posexplode(F.expr("transform(sequence(0, greatest(0, (n - 1) div k.capacity)), i -> least(k.capacity, n - i * k.capacity))")).alias("piece", "tokens"),
    ).withColumn("tokens", F.col("tokens").cast("int"))
    full = pieces.where("tokens = capacity").select(
        "container", "capacity", "doc_id", "piece", "tokens", F.concat_ws("-", "container", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin")
    )
    # salted by the hash of the document, so that shards are alike in size whatever the documents' sources are
    rest = pieces.where("tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shards")))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        container, capacity, no = key
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        at = pack(pdf["tokens"].to_numpy(np.int64), capacity)
        return pdf.assign(bin=[f"{container}-{no}-{k}" for k in at])[["container", "capacity", "doc_id", "piece", "tokens", "bin"]]

    return full.unionByName(rest.groupBy("container", "capacity", "shard").applyInPandas(shard, OUT))


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of room used for each kind of container."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("q"))
    return bins.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"), F.bround(F.sum("t") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("fill"), F.bround(F.stddev_pop("q") / F.avg("q"), 4).alias("cost_spread")
    )
