"""What the operators share: rows without surprises, words as Column expressions, Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from jobtide.sources.shared import ship_package

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_TEXT_BATCH = 4 << 20


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Columns ``doc_id``, ``text`` and ``more`` alone, whatever else the input has; a null text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def row_key(rows: DataFrame) -> list[Column]:
    """Two columns that name a row of doc_id and text: equal only for rows that repeat each other in both. The first is the id itself where that is a whole number, so that
    rows can be put in its order, and else a hash of it."""
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    else:
        doc = F.xxhash64("doc_id")
    return [doc.alias("doc"), F.xxhash64("text", "doc_id").alias("sig")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, even when lambdas inside ``use`` read it often."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text: the longest runs without one of SPACES."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(column: pa.Array, most: int = _TEXT_BATCH) -> Iterator[tuple[int, list[str]]]:
    """Runs of a text column as Python strings, each of about ``most`` characters or one longer text, with their starts."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if held and size + len(text) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def documents(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/documents.parquet")
