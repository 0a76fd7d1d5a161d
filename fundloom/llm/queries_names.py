"""Queries of problem 6 over faculty_grants.personname."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.names import link_names, name_pairs
from fundloom.session import load, materialize


def p6_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person key of each distinct name string."""
    return link_names(load(spark, sf_dir, "faculty_grants").select("personname"), "personname")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of spellings of one person."""
    return name_pairs(materialize(p6_persons(spark, sf_dir), "persons"))


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by their number of spellings."""
    return p6_persons(spark, sf_dir).groupBy("person").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("persons"))


QUERIES = {"p6_found": p6_found, "p6_persons": p6_persons, "p6_spellings": p6_spellings}
SQL: dict[str, str] = {}
