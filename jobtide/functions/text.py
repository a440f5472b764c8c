"""Text cleaning and the simple closed-phrase flag."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobtide.functions.phrases import CLOSED_FLAG_PATTERNS, SPACE, SPACE_CHARACTERS


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row.

    Without it the optimizer may copy a costly expression to each place that uses it, above all when a filter
    is pushed down.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def spaced(pattern: str) -> str:
    r"""Widen every ``\s`` of a pattern to all Unicode white space."""
    return pattern.replace(r"\s", SPACE)


def strip_space(value) -> Column:
    return F.btrim(as_column(value), F.lit(SPACE_CHARACTERS))


def clean_text(value) -> Column:
    """Collapse white space runs to one blank and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(value), F.lit("")), f"{SPACE}+", " "))


def closed_flag(value) -> Column:
    """True where any closed phrase occurs, ignoring case; null and '' give false."""
    pattern = "(?i)" + "|".join(CLOSED_FLAG_PATTERNS)
    return F.coalesce(as_column(value).rlike(pattern), F.lit(False))
