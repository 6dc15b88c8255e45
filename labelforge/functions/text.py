"""Text column helpers (B1–B3); whole texts, JVM-side string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(col) -> Column:
    """B1: drop ``<br />`` markers and newlines."""
    return F.replace(F.replace(_c(col), F.lit("<br />"), F.lit("")), F.lit("\n"), F.lit(""))


def tail_chars(col, n: int = 1024) -> Column:
    """B2: the last n characters."""
    return F.right(_c(col), F.lit(n))


def drop_lead_words(col, n: int = 100) -> Column:
    """Text after the n-th space; with fewer spaces only the last word survives."""
    w = F.split(_c(col), " ")
    return F.array_join(F.slice(w, F.least(F.lit(n + 1), F.size(w)), F.size(w)), " ")
