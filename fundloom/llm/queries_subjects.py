"""Queries of problem 5 over grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm import residue_examples as ex
from fundloom.llm.subjects import assign_subjects
from fundloom.session import load, spread


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every grants row with their scores."""
    areas = sorted(r[0] for r in load(spark, sf_dir, "subject_areas").select("subject_id").where("subject_id IS NOT NULL").collect())  # ten rows
    empty = [e for b in (ex.FILLER, ex.NOTICES, ex.FORMS) for e in ex.examples(b)]
    grants = spread(load(spark, sf_dir, "grants").select("record_id", "grantname", "abstract"))
    return assign_subjects(grants, "record_id", "grantname", "abstract", load(spark, sf_dir, "subject_labels"), "subject_id", areas, empty)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grants row with each subject area its work belongs to."""
    return p5_scores(spark, sf_dir).select("record_id", "subject_id").distinct()


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each subject area."""
    return p5_found(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores, "p5_composition": p5_composition}
SQL: dict[str, str] = {}
