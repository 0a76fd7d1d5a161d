"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.bpe import token_count, token_ids, vocabulary
from fundloom.llm.packing import fill_report, pack_documents
from fundloom.session import load, materialize, spread


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", token_ids(F.col("text"), vocabulary(spark)).alias("ids"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return materialize(docs.select("doc_id", token_count(F.col("text"), vocabulary(spark)).alias("tokens")), "tokens")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text or piece, for each capacity of context_sizes."""
    return pack_documents(_sizes(spark, sf_dir), load(spark, sf_dir, "context_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of room for each capacity."""
    return fill_report(p8_containers(spark, sf_dir))


QUERIES = {"p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
