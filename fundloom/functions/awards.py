"""Award numbers, person and organisation names as agencies write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AWARD = r"^([3-9])?([A-Z][A-Z0-9][0-9])([A-Z]{2})([0-9]{5,6})(?:-([0-9]+))?$"


def health_award(c: Column) -> Column:
    """Struct (core, suffix, suffix_kind, valid) of a health-agency award number; a suffix of four digits or more is a sub-project."""
    s = F.upper(F.regexp_replace(c, r"\s+", ""))
    valid = F.coalesce(s.rlike(_AWARD), F.lit(False))
    part = lambda i: F.regexp_extract(s, _AWARD, i)
    suffix = F.when(valid, F.nullif(part(5), F.lit("")))
    return F.struct(
        F.when(valid, F.concat(part(2), part(3), part(4))).alias("core"),
        suffix.alias("suffix"),
        F.when(suffix.isNull(), None).when(F.length(suffix) >= 4, "subproject").otherwise("support_year").alias("suffix_kind"),
        valid.alias("valid"),
    )


def core_key(core: Column) -> Column:
    """Struct (activity, institute, serial) of a core number, equal for any padding of the serial; NULL if it is none.

    Activity codes whose second sign is a letter have a key too.
    """
    pattern = r"^([A-Z][A-Z0-9][0-9])([A-Z]{2})([0-9]+)$"
    key = F.struct(F.regexp_extract(core, pattern, 1).alias("activity"), F.regexp_extract(core, pattern, 2).alias("institute"), F.regexp_extract(core, pattern, 3).try_cast("bigint").alias("serial"))
    return F.when(core.rlike(pattern), key)


def science_award(c: Column) -> Column:
    """Struct (award_id, confidence): digits padded to seven, and how sure the padding is."""
    s = F.regexp_replace(F.trim(c), r"\.0$", "")
    n = F.when(F.coalesce(s.rlike("^[0-9]+$"), F.lit(False)), F.length(s)).otherwise(0)
    return F.struct(
        F.when(n.isin(5, 6, 7), F.lpad(s, 7, "0")).alias("award_id"),
        F.when(n == 7, "exact").when(n == 6, "padded_high").when(n == 5, "padded_low").otherwise("invalid").alias("confidence"),
    )


def person_name(c: Column) -> Column:
    """Name without mail address, remarks in brackets and a suffix behind a comma; '' for NULL."""
    s = F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), r"\S+@\S+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"(?i),\s*(?:Jr\.?|Sr\.?|I{1,3}|IV)\s*$", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def organisation_name(c: Column) -> Column:
    """Name in capitals with single blanks; '' for NULL."""
    return F.coalesce(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
