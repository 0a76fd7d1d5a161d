"""Queries of problem 4 over faculty_grants and extra_neu_abstracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.functions.identifiers import canonical_id, orphan_key
from fundloom.operators.references import missing_references, reference_rates
from fundloom.session import load


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "faculty_grants").select(
        F.lit("faculty_grants").alias("ref_table"),
        F.col("link_id").cast("string").alias("ref_row"),
        F.col("createddate").alias("at"),
        F.explode(
            F.array(
                F.struct(F.lit("faculty_id").alias("ref_field"), F.lit("faculty").alias("target"), canonical_id(F.col("faculty_id")).alias("key")),
                F.struct(F.lit("grant_id").alias("ref_field"), F.lit("grants").alias("target"), canonical_id(F.col("grant_id")).alias("key")),
            )
        ).alias("r"),
    )
    extra = load(spark, sf_dir, "extra_neu_abstracts").select(
        F.lit("extra_neu_abstracts").alias("ref_table"), F.col("doc_id").alias("ref_row"), F.col("createddate").alias("at"), F.lit("doc_id").alias("ref_field"), F.lit("orphans").alias("target"), orphan_key(F.col("doc_id")).alias("key")
    )
    return links.select("ref_table", "ref_row", "at", "r.*").unionByName(extra)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for target, name, key in (("faculty", "faculty", "faculty_id"), ("grants", "grants", "grant_id"), ("orphans", "grant_orphaned_abstracts", "id")):
        t = load(spark, sf_dir, name).select(F.lit(target).alias("target"), canonical_id(F.col(key)).alias("key"), F.col("createddate").alias("since"), F.col("deprecateddate").alias("until"))
        out = t if out is None else out.unionByName(t)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference without a live target, once."""
    return missing_references(_refs(spark, sf_dir), _parents(spark, sf_dir)).select("ref_table", "ref_field", "ref_row").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month; a repeated referring row counts once."""
    refs = _refs(spark, sf_dir).distinct()
    return reference_rates(refs, missing_references(refs, _parents(spark, sf_dir)))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}

_CANON = "CASE WHEN regexp_matches({b}, '^[0-9]+(\\.0+)?$') THEN nullif(regexp_replace(regexp_replace({b}, '\\.0+$', ''), '^0+', ''), '') ELSE nullif(lower({b}), '') END"
_BARE = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _canon(c: str) -> str:
    return _CANON.format(b=_BARE.format(c=c))


_ORPHAN = _CANON.format(b="regexp_replace(lower(" + _BARE.format(c="doc_id") + "), '^orphan[\\s_-]*', '')")
_CTE = f"""WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'faculty_grants' AS ref_table, 'faculty_id' AS ref_field, CAST(link_id AS VARCHAR) AS ref_row, 'faculty' AS target, {_canon("faculty_id")} AS key, createddate AS seen FROM faculty_grants
    UNION ALL SELECT 'faculty_grants', 'grant_id', CAST(link_id AS VARCHAR), 'grants', {_canon("grant_id")}, createddate FROM faculty_grants
    UNION ALL SELECT 'extra_neu_abstracts', 'doc_id', doc_id, 'orphans', {_ORPHAN}, createddate FROM extra_neu_abstracts) WHERE key IS NOT NULL),
parents AS (
  SELECT 'faculty' AS target, {_canon("faculty_id")} AS key, createddate AS since, deprecateddate AS until FROM faculty
  UNION ALL SELECT 'grants', {_canon("grant_id")}, createddate, deprecateddate FROM grants
  UNION ALL SELECT 'orphans', {_canon("id")}, createddate, deprecateddate FROM grant_orphaned_abstracts),
missing AS (
  SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.key = r.key AND p.since <= r.seen AND (p.until IS NULL OR p.until > r.seen)))
"""
SQL = {
    "p4_found": _CTE + "SELECT DISTINCT ref_table, ref_field, ref_row FROM missing",
    "p4_rates": _CTE
    + """SELECT ref_table, ref_field, strftime(date_trunc('month', seen), '%Y-%m-%d') AS period, CAST(sum(n) AS BIGINT) AS n_refs, CAST(sum(m) AS BIGINT) AS n_missing
FROM (SELECT ref_table, ref_field, seen, 1 AS n, 0 AS m FROM refs UNION ALL SELECT ref_table, ref_field, seen, 0, 1 FROM missing) GROUP BY 1, 2, 3""",
}
