"""Document fingerprints by one-permutation MinHash. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtide.llm.common import let, row_key, texts_of, words_of
from jobtide.sources.shared import written

#: Bins of a fingerprint and low-order bits kept of each.
BINS, BITS = 128, 8
_DRAWS = 6


def fingerprint(text: Column, shingle: int = 5, bins: int = BINS) -> Column:
    """Hex fingerprint of a text, two digits a bin; that of a text without words is empty.

    The hash of each run of ``shingle`` words (of all words, if there are fewer) falls into one bin by its high bits, and
    each bin keeps its smallest. An empty bin draws other bins by a hash of its number and the draw's, the same in all texts,
    until one has a value to lend (optimal densification); after ``_DRAWS`` draws it ranks those with a value by such a hash.
    """

    def hashes(each: Column) -> Column:
        n = F.greatest(F.size(each) - shingle + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(each, i, shingle)))

    def smallest(ordered: Column) -> Column:
        # sorted by value, so the first of a bin is its smallest
        return F.filter(ordered, lambda h, i: (i == 0) | (_bin(h, bins) != _bin(F.get(ordered, i - 1), bins)))

    def filled(found: Column, at: Column) -> Column:
        def value(b: Column) -> Column:
            draws = [b, *(F.pmod(F.hash(b, F.lit(t)), F.lit(bins)).cast("long") for t in range(_DRAWS))]
            drawn = [F.get(found, (F.array_position(at, d) - 1).cast("int")) for d in draws]
            ranks = F.transform(at, lambda other, i: F.hash(other, b).cast("long") * bins + i)
            return F.coalesce(*drawn, F.get(found, F.pmod(F.array_min(ranks), F.lit(bins)).cast("int")))

        # in the order that sorted values have their bins in: those of negative values come first
        places = F.lit([*range(bins // 2, bins), *range(bins // 2)]).cast("array<long>")
        return F.when(F.size(found) == bins, found).otherwise(F.transform(places, value))

    def of(words: Column) -> Column:
        ordered = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.sort_array(hashes(w)))
        values = let(let(ordered, smallest), lambda f: let(F.transform(f, lambda h: _bin(h, bins)), lambda at: filled(f, at)))
        low = F.transform(values, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1)))), BITS // 4, "0"))
        return F.when(F.size(words) == 0, "").otherwise(F.array_join(low, ""))

    return let(words_of(text), of)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal bins, less what chance makes equal in ``BITS`` bits.

    Equal fingerprints have 1, also two empty ones; an empty and another one have 0.
    """
    chance, width = 2.0**-BITS, BITS // 4
    at = F.sequence(F.lit(1), F.lit(width * bins), F.lit(width))
    equal = F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(width)) == F.substr(b, i, F.lit(width)))) / bins
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def _bin(h: Column, bins: int) -> Column:
    return F.shiftrightunsigned(h, 65 - bins.bit_length()).cast("long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and fingerprint of each row; a null text is empty. Equal texts have equal fingerprints. No shuffle."""
    return texts_of(docs, id_col, text_col).withColumn("fingerprint", fingerprint(F.col("text")))


def spliced_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of texts and of the same texts with their second half replaced by the start of the next document.

    The last floor(n / 2) of n characters give way to the first as many (or all) of the next row by id, then by a hash of
    the text; after the last comes the first, and the next of a single row is itself. Rows that repeat each other follow each other.
    Null ids come first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, by range of ids (``ranges`` of them, four for each shuffle partition unless given), and each looks at the
    next in its range; a copy of the first row of the next range ends each range.
    """
    spark = docs.sparkSession
    ranges = ranges or min(4_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts_of(docs, id_col, text_col)
    rows = rows.withColumns(dict(zip(("doc", "sig"), row_key(rows))))
    cuts = rows.agg(F.percentile_approx("doc", [i / ranges for i in range(1, ranges)], F.lit(100 * ranges))).first()[0] if ranges > 1 else []
    cuts = F.lit(sorted(set(cuts or [])))
    rows = rows.withColumn("range", F.size(F.filter(cuts.cast("array<long>"), lambda c: c <= F.col("doc"))))

    first = rows.groupBy("range").agg(F.min(F.struct("doc", "sig")).alias("own"))
    every = Window.partitionBy(F.lit(0))  # one row for each range
    first = first.select("range", F.coalesce(F.lead("own").over(every.orderBy("range")), F.min("own").over(every)).alias("own"))
    first = written(first.select(F.col("range").alias("last_of"), "own.*"), "ranges")
    ends = rows.join(F.broadcast(first), ["doc", "sig"])  # at most ``ranges`` rows
    ends = ends.dropDuplicates(["last_of"]).withColumns({"range": F.col("last_of"), "end": F.lit(True)}).drop("last_of")

    order = Window.partitionBy("range").orderBy("end", "doc", "sig")
    named = rows.withColumn("end", F.lit(False)).unionByName(ends).withColumn("fingerprint", fingerprint(F.col("text")))
    named = named.withColumns({"next": F.lead("text").over(order), "next_print": F.lead("fingerprint").over(order)}).where("NOT end")
    edited = F.expr("concat(left(text, length(text) - length(text) div 2), left(next, length(text) div 2))")
    made = named.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_print", edited.alias("edited"))
    made = made.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(n) for c, n in (("edited_fingerprint", "near_edited"), ("next_print", "near_next"))]
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near)
