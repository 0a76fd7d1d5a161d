"""Markdown reports over aggregates, and the table of answers of an outside reviewer."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.sources.files import last_records

#: Most rows of a table of a report.
ROWS = 1_000
ANSWER = "id string, at bigint, leaf_id string, confidence string, abstain boolean, rationale string, terms_considered string"


def table(df: DataFrame, most: int = ROWS) -> str:
    """An aggregate as a Markdown table; what lies beyond `most` rows is told, not shown."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most])]
    return "\n".join(lines + (["", f"More than {most} rows."] if len(rows) > most else []))


def report(path: str, title: str, parts: list[tuple[str, str, DataFrame | None]]) -> None:
    """A report of headed parts (heading, sentence, aggregate)."""
    out = [f"# {title}"]
    for heading, said, df in parts:
        out += [f"## {heading}", *([said] if said else []), *([table(df)] if df is not None else [])]
    Path(path).write_text("\n\n".join(out) + "\n", encoding="utf-8")


def recovery_report(path: str, decisions: DataFrame, grants: DataFrame) -> None:
    """What became of orphaned texts. decisions: id, outcome, score; grants: abstract, abstract_source."""
    outcome = decisions.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"), F.bround(F.avg("score"), 2).alias("mean_score")).orderBy(F.desc("records"), "outcome")
    filled = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    source = grants.groupBy("abstract_source").agg(F.count(F.lit(1)).alias("grants"), F.count_if(filled).alias("with_text")).orderBy(F.desc("grants"), "abstract_source")
    report(path, "Recovery of orphaned texts", [("Outcomes", "", outcome), ("Sources of text", "", source)])


def backfill_report(path: str, service: str, grants: DataFrame, near: DataFrame) -> None:
    """What a service filled in. grants: agencycode, filled, how; near: candidates short of a match."""
    total = grants.agg(F.count(F.lit(1)).alias("asked"), F.count_if("filled").alias("filled"), F.bround(F.avg(F.col("filled").cast("int")), 4).alias("share"))
    how = grants.where("filled").groupBy("how").agg(F.count(F.lit(1)).alias("grants")).orderBy(F.desc("grants"), "how")
    agency = grants.groupBy("agencycode").agg(F.count(F.lit(1)).alias("asked"), F.count_if("filled").alias("filled")).orderBy(F.desc("asked"), "agencycode")
    report(path, f"Texts from {service}", [("Totals", "", total), ("How they matched", "", how), ("By agency", "", agency), ("Near misses", "For a reader to decide.", near)])


def review_sheet(path: str, vocabulary: DataFrame, groups: DataFrame, taxonomy: DataFrame, leaves: DataFrame) -> None:
    """Terms for review. vocabulary: term, df; groups: grp, term, flagged; taxonomy: leaf, term, weight; leaves: leaf, label, parent."""
    size = vocabulary.agg(F.count(F.lit(1)).alias("terms"), F.min("df").alias("least_df"), F.max("df").alias("most_df"))
    group = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("terms"), F.count_if("flagged").alias("flagged")).orderBy("grp")
    flagged = groups.where("flagged").select("grp", "term").orderBy("grp", "term")
    leaf = leaves.join(taxonomy.groupBy("leaf").agg(F.count_if(F.col("weight") > 0).alias("speak_for"), F.count_if(F.col("weight") < 0).alias("speak_against")), "leaf", "left").orderBy("leaf")
    report(path, "Review of terms", [("Vocabulary", "", size), ("Groups", "", group), ("Terms in doubt", "", flagged), ("Leaves", "", leaf)])


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The last answer for each id in a log of JSON lines: leaf_id, confidence, abstain, rationale, terms (a list), valid.

    An answer without a leaf that doesn't abstain is not valid; terms come as a list or as text with commas.
    """
    a = last_records(spark, path, ANSWER, "id", "at")
    terms = F.coalesce(F.from_json("terms_considered", "array<string>"), F.filter(F.transform(F.split(F.coalesce("terms_considered", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != ""))
    leaf, abstain = F.col("leaf_id").try_cast("int"), F.coalesce("abstain", F.lit(False))
    return a.select("id", leaf.alias("leaf_id"), F.lower("confidence").alias("confidence"), abstain.alias("abstain"), "rationale", terms.alias("terms"), (abstain | leaf.isNotNull()).alias("valid"))
