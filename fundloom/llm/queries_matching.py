"""Queries of problem 2 over grant_orphaned_abstracts and grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.matching import match_records
from fundloom.session import load


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grant of each orphan record with score, gap and confidence."""
    orphans, grants = load(spark, sf_dir, "grant_orphaned_abstracts"), load(spark, sf_dir, "grants")
    return match_records(orphans, grants, ("id", "title", "start_date", "dollar_amount"), ("grant_id", "grantname", "startdate", "totaldollars"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each orphan with the grant of the same award."""
    return p2_matches(spark, sf_dir).select(F.col("left_key").alias("orphan_id"), F.col("right_key").alias("grant_id"))


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
SQL: dict[str, str] = {}
