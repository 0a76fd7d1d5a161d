"""Column normalisation, safe parsing, banding and labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names without outer blanks, in lower case, with underscores for blanks."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def keep_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in order, each cast to its type; absent ones are NULL."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def leading_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The same columns with `first` in front; those absent are passed over."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def blank_to(c: Column, default: str) -> Column:
    """Trimmed text, `default` for null and blank."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def safe_date(c: Column) -> Column:
    """Timestamp, NULL where the text is none."""
    return F.try_to_timestamp(c)


def safe_double(c: Column, default: float | None = None) -> Column:
    """Number, `default` where the text is none."""
    d = c.try_cast("double")
    return d if default is None else F.coalesce(d, F.lit(default))


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds; a NULL condition doesn't."""
    return reduce(lambda acc, r: F.when(F.coalesce(r[0], F.lit(False)), F.lit(r[1])).otherwise(acc), reversed(rules), F.lit(default))


def band_left_closed(x: Column, edges: list[float]) -> Column:
    """Index of the band [edge, next edge) of x; 0 below the first edge, NULL for NULL."""
    return F.when(x.isNull(), None).otherwise(reduce(lambda a, b: a + b, [F.when(x >= e, 1).otherwise(0) for e in edges]))


def bin_right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (edge, next edge] of x; NULL outside of all and on the lowest edge."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(label)).otherwise(out)
    return out


def academic_rank(c: Column) -> Column:
    """Rank as one of eleven labels, by the words it contains."""
    r = F.lower(F.trim(c))
    has = r.contains
    teaching = first_match([(has("assoc"), "Associate Teaching Professor"), (has("assistant"), "Assistant Teaching Professor")], "Teaching Professor")
    professor = first_match([(has("associate"), "Associate Professor"), (has("assistant"), "Assistant Professor")], "Professor")
    return (
        F.when(c.isNull(), "Unknown")
        .when(has("teaching"), teaching)
        .when(has("research") & has("professor"), "Research Professor")
        .when(has("professor"), professor)
        .when(has("lecturer"), "Lecturer")
        .when(has("visiting") | has("adjunct"), "Visiting / Adjunct")
        .otherwise("Other")
    )


def agency_name(c: Column) -> Column:
    """Agency name for joins: lower case, dept. written out, single blanks; '' for NULL."""
    s = F.replace(F.replace(F.lower(F.trim(c)), F.lit("dept."), F.lit("department")), F.lit("dept "), F.lit("department "))
    return F.coalesce(F.regexp_replace(s, r"\s+", " "), F.lit(""))
