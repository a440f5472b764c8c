"""Small tables of questions (benchmark items) in blocks that may be broadcast, and the words that both sides are compared by."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_WORD = bytes(range(ord("0"), ord("9") + 1)) + _LOWER + bytes(range(128, 256))
_TABLE = bytes(b if b in _WORD else ord(" ") for b in bytes(range(256)).translate(bytes.maketrans(_UPPER, _LOWER)))


def plain_words(text: str) -> list[bytes]:
    """Words of a text in UTF-8: the longest runs of ASCII letters, digits and characters beyond ASCII, with A-Z in small letters."""
    return text.encode().translate(_TABLE).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[Row]]:
    """Rows (item_id, text) of items whose text is not null, in blocks of some ``most_bytes`` of text, or of one longer item.

    Items are measured before any of them comes to the driver, and one block is there at a time.
    """
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 if total <= most_bytes else -(-2 * total // most_bytes)  # twice as many, as hashing does not share out evenly
    for block in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == block)
        yield part.collect()
