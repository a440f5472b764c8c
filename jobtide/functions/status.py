"""Open/closed verdicts from text, model answers and page checks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from jobtide.functions import phrases as P
from jobtide.functions.text import as_column, bound, spaced, strip_space

VERDICT_TYPE = "struct<status:string,confidence:double,method:string,reason:string>"

# A phrase that already contains an explicit pattern can never be the one that decides.
_UNDECIDED_CLOSED = tuple(
    phrase for phrase in P.CLOSED_PHRASES if not any(re.search(p, phrase) for p in P.EXPLICIT_CLOSED_PATTERNS)
)

# Text that must occur (any of it) where the pattern of the same place matches. Looking for it first spares most
# texts the regex.
_NEEDED = (
    ("no longer ",),
    ("position",),
    ("expired",),
    ("closed", "filled"),
    ("role",),
    ("application",),
    ("we've",),
    ("we have",),
    ("completed",),
)
_EXPLICIT = tuple(zip(P.EXPLICIT_CLOSED_PATTERNS, _NEEDED, strict=True))


def _explicit_hit(text: Column, pattern: str, needed: tuple[str, ...]) -> Column:
    possible = reduce(lambda a, b: a | b, [text.contains(n) for n in needed])
    return possible & text.rlike(spaced(pattern))


def verdict(status, confidence, method, reason=None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    number = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        text(status).alias("status"),
        number.cast("double").alias("confidence"),
        text(method).alias("method"),
        text(reason).alias("reason"),
    )


def _hits(tests) -> Column:
    total = F.lit(0)
    for test in tests:
        total = total + test.cast("int")
    return total


def keyword_status(value) -> Column:
    """Verdict from phrases: any explicit pattern means closed, else the side with more phrases wins."""

    def found(n, kind):
        return F.concat(F.lit("Found "), n.cast("string"), F.lit(f" {kind} indicators"))

    def sure(n, step, top):
        return F.least(F.lit(0.5) + n * F.lit(step), F.lit(top))

    def by_phrases(closed: Column, opened: Column) -> Column:
        return (
            F.when(closed > opened, verdict("closed", sure(closed - opened, 0.1, 0.9), P.KEYWORD_METHOD, found(closed, "closed")))
            .when(opened > closed, verdict("open", sure(opened - closed, 0.1, 0.9), P.KEYWORD_METHOD, found(opened, "open")))
            .otherwise(verdict("unknown", 0.3, P.KEYWORD_METHOD, P.REASON_NONE))
        )

    def judge(text: Column) -> Column:
        explicit = _hits(_explicit_hit(text, *rule) for rule in _EXPLICIT)
        closed = _hits(text.contains(p) for p in _UNDECIDED_CLOSED)
        opened = _hits(text.contains(p) for p in P.OPEN_PHRASES)
        # phrases are only counted where no explicit pattern decides
        counted = bound(closed, lambda c: bound(opened, lambda o: by_phrases(c, o)))
        return bound(
            explicit,
            lambda e: F.when(e > 0, verdict("closed", sure(e, 0.2, 0.95), P.KEYWORD_METHOD, found(e, "explicit closed"))).otherwise(counted),
        )

    return bound(F.lower(F.coalesce(as_column(value), F.lit(""))), judge)


def text_gate(value) -> Column:
    """Verdict for texts too short to judge; null means the text may be judged."""
    text = as_column(value)
    short = text.isNull() | (F.length(strip_space(text)) < 50)
    return F.when(short, verdict("unknown", 0.0, P.SHORT_TEXT_METHOD))


def parse_response(value, method) -> Column:
    """Verdict from the answer of a model; a null answer has no verdict."""

    def read(answer: Column) -> Column:
        has = answer.contains
        closed = has("closed") & ~has("open") & ~has("not closed") & ~has("isn't closed")
        return (
            F.when(answer.isNull(), F.lit(None).cast(VERDICT_TYPE))
            .when(closed, verdict("closed", 0.85, method))
            .when(has("open"), verdict("open", 0.85, method))
            .otherwise(verdict("unknown", 0.0, P.PARSE_FAILED_METHOD))
        )

    return bound(F.lower(strip_space(value)), read)


def build_prompt(value) -> Column:
    return F.concat(F.lit(P.PROMPT_HEAD), F.substring(as_column(value), 1, P.PROMPT_TEXT_LIMIT), F.lit(P.PROMPT_TAIL))


def page_alive(http_status, text) -> Column:
    """False for gone pages, gone wording, or a page that could not be fetched (null text)."""
    code, body = as_column(http_status), as_column(text)
    pattern = "(?i)" + "|".join(spaced(p) for p in P.GONE_PATTERNS)
    gone = F.coalesce(code.isin(*P.GONE_HTTP_STATUS), F.lit(False)) | body.isNull() | body.rlike(pattern)
    return ~gone
