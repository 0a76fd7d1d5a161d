"""Queries of problem 9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.abuse import ABUSIVE, plain_texts, score_abuse, train
from fundloom.session import load, spread


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and evidence of every document."""
    docs = plain_texts(spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), "doc_id", "text", ("source",))
    return score_abuse(docs, "doc_id", train(docs, "doc_id", load(spark, sf_dir, "doc_labels"), "abusive"), ("source",))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each abusive document."""
    return p9_scores(spark, sf_dir).where(F.col("score") >= ABUSIVE).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive ones and their rate per source."""
    bad = F.count_if(F.col("score") >= ABUSIVE)
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), bad.alias("n_abusive"), F.bround(bad / F.count(F.lit(1)), 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
