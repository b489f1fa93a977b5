"""Spelling rules for source names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_source(col: Column) -> Column:
    """Outer white space removed, lower case, each run of blanks, hyphens and underscores as one underscore; null stays null."""
    trimmed = F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"(?U)[\s_\-]+", "_")
