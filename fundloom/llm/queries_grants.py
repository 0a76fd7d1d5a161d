"""Queries of problems 1 and 3 over grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.fusion import cut_off, fuse, text_key
from fundloom.llm.residue import find_residue, natural_counts
from fundloom.session import load, materialize, spread

#: Trust of the sources of an abstract, by the meaning of their spelling.
TIERS = {"internal": 4, "orphan_recovered": 3, "nih_reporter": 2, "nsf_api": 2, "nih_reporter_parent": 1}
#: Log odds of a tier and of a microsecond: any difference of dates goes before all votes (at most 500 either way), any of tiers before all dates.
TRUST, RECENCY = 1_000_000_000_000_000_000_000, 1_001


def source_name(c: Column) -> Column:
    """A source by its meaning: lower case, trimmed, blanks and hyphens as underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")


def p3_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field with residue, how much of it is residue and an example of it."""
    g = load(spark, sf_dir, "grants")
    return find_residue(spread(g.select("record_id", "grantname", "abstract")), "record_id", ["grantname"], ["abstract"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grants row and field that shows residue."""
    return p3_residue(spark, sf_dir).select("record_id", "field").distinct()


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a usable abstract, of grants of several rows: no residue, and not the beginning of another row's abstract."""
    g = load(spark, sf_dir, "grants")
    several = g.where(F.col("grant_id").isNotNull()).groupBy("grant_id").count().where("count > 1").select("grant_id")
    rows = g.select("grant_id", "record_id", "abstract", "abstract_source", "updateddate").join(several, "grant_id", "left_semi").where(F.col("abstract").isNotNull())
    rows = materialize(rows.withColumn("value", text_key(F.col("abstract"))).where(F.col("value").isNotNull()), "texts")
    # the same models as of problem 3, but only these abstracts are judged
    residue = find_residue(spread(rows.select("record_id", "abstract")), "record_id", [], ["abstract"], natural_counts(spread(g.select("grantname", "abstract")), ["grantname"], ["abstract"])).select("record_id")
    gone = residue.unionByName(cut_off(rows, "grant_id", "record_id", "value")).distinct()
    return rows.join(gone, "record_id", "left_anti").withColumn("source", source_name(F.col("abstract_source")))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.coalesce(*[F.when(F.col("source") == s, t) for s, t in TIERS.items()], F.lit(0))
    updated = F.unix_micros(F.concat(F.col("updateddate").cast("string"), F.lit("Z")).cast("timestamp"))  # without zone, whatever the session's is
    return fuse(_usable(spark, sf_dir), "grant_id", "record_id", "source", "value", [(tier, TRUST), (F.coalesce(updated, F.lit(-(10**17))), RECENCY)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row whose abstract and source are kept, for each grant of several rows."""
    return _survivors(spark, sf_dir).select("grant_id", "record_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving pair of each such grant with the posterior of its text."""
    kept = _survivors(spark, sf_dir)
    pair = load(spark, sf_dir, "grants").select("record_id", "abstract", source_name(F.col("abstract_source")).alias("abstract_source"))
    return kept.join(pair, "record_id")


def p1_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each such grant that the sources' votes alone would keep."""
    return fuse(_usable(spark, sf_dir), "grant_id", "record_id", "source", "value", [])


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_votes": p1_votes, "p3_found": p3_found, "p3_residue": p3_residue}
SQL: dict[str, str] = {}
