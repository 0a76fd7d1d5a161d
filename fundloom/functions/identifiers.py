"""Canonical forms of identifiers that are written in more than one way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column) -> Column:
    """Identifier without outer white space, leading zeros and a decimal tail; NULL for null, blank and all-zero ids.

    An identifier that is not a number keeps its text in lower case.
    """
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    number = F.regexp_replace(F.regexp_replace(bare, r"\.0+$", ""), r"^0+", "")
    out = F.when(bare.rlike(r"^[0-9]+(\.0+)?$"), number).otherwise(F.lower(bare))
    return F.nullif(out, F.lit(""))


def orphan_key(c: Column) -> Column:
    """The record id within a pseudo document id (the word orphan, a separator, the id)."""
    bare = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return canonical_id(F.regexp_replace(bare, r"^orphan[\s_-]*", ""))
