"""Posting dates from ISO attributes and from phrases such as '3 days ago'."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobtide.functions.text import as_column, bound, spaced, strip_space
from jobtide.schemas import instant

# Month names in calendar order.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Units of "N <unit> ago" in the order they are looked for, with their length in hours.
_AGES = (("day", 24), ("hour", 1), ("week", 7 * 24), ("month", 30 * 24))
# Past this many hours the date would fall before year 1.
_OLDEST_HOURS = 24 * 365 * 1900

# Date, then optionally any separator, time, fraction and zone (a blank may precede it); dashes and colons are used throughout or not at all.
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?"
    r"(?: ?(?:(Z)|([+-]\d{2})(?::?(\d{2}))?))?)?\z"
)
_ISO_PARTS = "$1-$3-$4|$5|$7|$8|$9|$10$11|$12"


def parse_iso(value) -> Column:
    """Instant of an ISO date or date-time with optional zone; null for anything else."""
    text = as_column(value)

    def stamp(parts: Column) -> Column:
        two = lambda i: F.rpad(parts[i], 2, "0")
        zone = F.when(parts[5].isin("", "Z"), parts[5]).otherwise(F.concat(parts[5], F.lit(":"), two(6)))
        fraction = F.rpad(F.substring(parts[4], 1, 6), 6, "0")
        return F.concat(parts[0], F.lit("T"), F.concat_ws(":", two(1), two(2), two(3)), F.lit("."), fraction, zone)

    parts = F.split(F.regexp_replace(text, _ISO, _ISO_PARTS), r"\|")
    return F.when(text.rlike(_ISO), bound(parts, stamp).try_cast("timestamp"))


def _age_in_hours(text: Column) -> Column:
    def hours(unit, length):
        digits = F.regexp_extract(text, spaced(rf"([0-9]+)\s*{unit}s?\s*ago"), 1)
        return digits.try_cast("double") * length

    return F.coalesce(*[hours(unit, length) for unit, length in _AGES])


def _calendar_date(phrase: Column, as_of: Column) -> Column:
    """Month and day of this year, Y-m-d or m/d/Y; 1900 stands for "no year given"."""
    numbers = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])}
    months = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    this_year = F.year(as_of).cast("string")
    named = spaced(r"^([a-z]+)\s+([0-9]{1,2})$")
    iso, american = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    month = F.try_element_at(months, F.regexp_extract(phrase, named, 1)).cast("string")
    ymd = (
        F.when(phrase.rlike(named), F.concat_ws("-", this_year, F.coalesce(month, F.lit("0")), F.regexp_extract(phrase, named, 2)))
        .when(phrase.rlike(iso), phrase)
        .when(phrase.rlike(american), F.regexp_replace(phrase, american, "$3-$1-$2"))
    )
    dated = F.when(ymd.startswith("1900-"), F.concat(this_year, F.substring(ymd, 5, 6))).otherwise(ymd)
    return F.try_to_timestamp(dated, F.lit("yyyy-M-d"))


def parse_date_text(value, as_of) -> Column:
    """Instant named by free text relative to ``as_of``, or null."""
    now = instant(as_of)

    def ago(hours: Column) -> Column:
        return now - F.make_dt_interval(F.lit(0), F.when(hours < _OLDEST_HOURS, hours).cast("int"))

    def read(text: Column) -> Column:
        phrase = strip_space(F.regexp_extract(text, spaced(r"posted\s+([^\n]+)"), 1))
        told = bound(phrase, lambda p: _calendar_date(p, now))
        return bound(_age_in_hours(text), lambda hours: F.when(hours.isNotNull(), ago(hours)).otherwise(told))

    return bound(F.lower(strip_space(value)), read)


def parse_posted(attribute, text, as_of) -> Column:
    """Machine-readable attribute first, free text second."""
    return F.coalesce(parse_iso(attribute), parse_date_text(text, as_of))
