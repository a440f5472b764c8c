"""Alignment of the tokens that two tokenizers make of the same texts, and how often each pair of ids is linked."""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.vocab import merge_piece, read_ranks
from jobtide.sources.shared import written

#: What stands for a blank in the pieces of the second tokenizer.
_BLANK = "▁"
#: Characters worked on at once, different pairs that a task counts before it sends them on, and pairs whose counts every task gets.
_PART, _PAIRS, _HEAD = 1 << 20, 1 << 21, 1 << 20


class ByteTokens:
    """The byte-level tokenizer: ids of a text with a blank before it."""

    def __init__(self, path: str, pattern: str):
        self._ranks, self._find = read_ranks(path), regex.compile(pattern).findall
        self._fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})
        self.size = max(self._ranks.values()) + 1
        self.lengths = np.zeros(self.size, dtype=np.int64)
        for token, i in self._ranks.items():
            self.lengths[i] = len(token)

    def of(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(" " + text, disallowed_special=())
        except ValueError:  # the library gives up on runs of a million blanks
            return np.array([i for piece in self._find(" " + text) for i in merge_piece(piece.encode(), self._ranks)], dtype=np.uint32)


class PieceTokens:
    """The piece tokenizer: ids of texts, before which it puts a blank itself."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._encode, self.size = model.encode, model.get_piece_size()
        self._bytes = [self._read(model, i) for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self._bytes], dtype=np.int64)

    @staticmethod
    def _read(model, i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_BLANK, " ").encode()

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, or none where their bytes are not those of the text with a blank before it."""
        found = self._encode(texts, num_threads=1)
        same = (b"".join(map(self._bytes.__getitem__, ids)) == (" " + text).encode() for text, ids in zip(texts, found))
        return [np.array(ids if text and ok else [], dtype=np.int64) for text, ids, ok in zip(texts, found, same)]


@cache
def _tokenizers(byte_path: str, pattern: str, piece_path: str) -> tuple[ByteTokens, PieceTokens, list[bytes]]:
    a, b = ByteTokens(byte_path, pattern), PieceTokens(piece_path)
    signs = [b"%d%s" % (i, end) for size, ends in ((a.size, (b",", b"|")), (b.size, (b",", b";"))) for i in range(size) for end in ends]
    return a, b, signs


def component_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terminal A token of the group of each A and each B token, and the links (rows of A token, B token) of overlapping ones.

    Tokens cover the same bytes and end at ``ends_a`` and ``ends_b``. Every token points to its farthest-right overlapping token, the one that holds its last byte; of two that end
    together B points to A and A to itself. Pointers are followed twice as far in each round until none moves.
    """
    n, total = len(ends_a), int(ends_a[-1]) if len(ends_a) else 0
    marks_a, marks_b = np.zeros(total + 1, dtype=np.int32), np.zeros(total + 1, dtype=np.int32)
    marks_a[ends_a], marks_b[ends_b] = 1, 1
    cuts = np.flatnonzero(marks_a | marks_b)
    done_a, done_b = np.cumsum(marks_a, dtype=np.int32), np.cumsum(marks_b, dtype=np.int32)  # tokens that end up to a byte
    over = done_b[ends_a - 1]
    jump = np.concatenate([np.where(ends_b[over] > ends_a, n + over, np.arange(n)), done_a[ends_b - 1]])
    while not np.array_equal(jump, further := jump[jump]):
        jump = further
    return jump[:n], jump[n:], np.stack([done_a[cuts - 1], done_b[cuts - 1]], axis=1)


class _Aligned:
    """Groups and links of a few texts, whose tokens lie one after another; no group reaches over the end of a text."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], tokenizers):
        left, right, self._signs = tokenizers
        ids_a, ids_b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]).astype(np.int64) for x in (a, b))
        top_a, top_b, links = component_labels(np.cumsum(left.lengths[ids_a]), np.cumsum(right.lengths[ids_b]))
        self.pairs = ids_a[links[:, 0]] * right.size + ids_b[links[:, 1]]
        terminal = top_a == np.arange(len(top_a))
        number = np.cumsum(terminal)  # groups that end up to an A token
        group_a, group_b = number[top_a] - 1, number[top_b] - 1
        until_a, until_b = np.flatnonzero(terminal) + 1, np.searchsorted(group_b, np.arange(number[-1] if len(number) else 0), "right")
        self.n_a, self.n_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (a, b))
        self.n_groups = np.diff(np.append(0, np.append(0, number)[np.cumsum(self.n_a)]))
        self.n_links = self.n_a + self.n_b - self.n_groups  # one for each place where a token of either ends
        # A tokens of a group, its B tokens, those of the next group
        self._order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        self._order[np.arange(len(ids_a)) + np.append(0, until_b)[group_a]] = 2 * ids_a + terminal
        last = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        self._order[np.arange(len(ids_b)) + until_a[group_b]] = 2 * (left.size + ids_b) + last

    def groups(self):
        """Groups of each text: ids of A, a bar, ids of B, with semicolons between."""
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        for start, end in zip([0, *ends], ends):
            yield b"".join(map(self._signs.__getitem__, self._order[start:end].tolist()))[:-1]


def _aligning(byte_path: str, pattern: str, piece_path: str, digest: bool):
    kept = "groups_sha256" if digest else "groups"

    def run(batches):
        tokenizers = left, right, _ = _tokenizers(byte_path, pattern, piece_path)
        kind = "<u4" if left.size * right.size <= 1 << 32 else "<u8"
        for batch in batches:
            for start, texts in blocks(batch.column("text"), _PART):
                b = right.of(texts)
                a = [left.of(t) if len(x) else x for t, x in zip(texts, b)]
                made = _Aligned(a, b, tokenizers)
                groups = [(sha256(g).hexdigest() if g else "") if digest else g.decode() for g in made.groups()]
                ends = np.cumsum(made.n_links).tolist()
                pairs = made.pairs.astype(kind)
                links = [pairs[x:y].tobytes() for x, y in zip([0, *ends], ends)]
                counts = [pa.array(x, pa.int64()) for x in (made.n_a, made.n_b, made.n_groups, made.n_links)]
                columns = [batch.column("doc_id").slice(start, len(texts)), *counts, pa.array(groups, pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", kept, "links"])

    return run, kept


def align(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of tokens of each text under a byte-level vocabulary (A, of a blank and the text) and a piece model (B): doc_id, n_a, n_b, n_groups, n_links, groups, links.

    Byte offsets at which tokens of both end cut the tokens into groups, written ``a1,a2|b1;a3|b2,b3``. Links are the pairs of overlapping tokens,
    each a number (A id * size of B's vocabulary + B id, little-endian, 4 bytes where all pairs fit in), in order of place. With ``digest`` the SHA-256 of the groups stands in their place.

    A null or empty text, and one that the tokens of either do not give back byte by byte, has no tokens: zeros, and empty groups. Special strings in texts are plain text.
    Repeated rows give repeated rows; null ids stay null. No shuffle.
    """
    run, kept = _aligning(byte_path, pattern, piece_path, digest)
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {kept} string, links binary")


def pair_counts(aligned: DataFrame, width: int, size_b: int) -> DataFrame:
    """How many links of all texts each pair of ids has: pair, n, best (no other A id has more with this B id). ``width``: bytes of a link.

    Tasks count their links first, so a pair that is everywhere is one row a task.
    """

    def run(batches):
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for found in _links(batch.column("links"), width):
                new, n = np.unique(found, return_counts=True)
                keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n])).astype(np.int64)
                if len(keys) > _PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])

    counted = written(aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    own = F.col("pair") % size_b
    most = counted.groupBy(own.alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has pieces
    return counted.withColumn("b", own).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _links(column: pa.Array, width: int):
    """Links of a binary column as arrays of some _PART links, or those of one longer text."""
    held, size = [], 0
    for value in column:
        data = value.as_buffer()
        if held and size + data.size > _PART * width:
            yield np.concatenate(held).astype(np.int64)
            held, size = [], 0
        held.append(np.frombuffer(data, dtype=f"<u{width}"))
        size += data.size
    if held:
        yield np.concatenate(held).astype(np.int64)


def report(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, head: int = _HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of ``align`` and of all texts together: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties
    included), count_sum (counts of all its links' pairs), groups_sha256 ('' without tokens).

    Links are made once and written. Every task gets the counts of the most frequent pairs, ``head`` at most (17 bytes each); other pairs of a text are
    joined with their counts, so a pair that is everywhere never moves. Nulls, empty texts and repeated rows as in ``align``.
    """
    left, right, _ = _tokenizers(byte_path, pattern, piece_path)
    width = 4 if left.size * right.size <= 1 << 32 else 8
    aligned = written(align(docs, byte_path, pattern, piece_path, True, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(aligned, width, right.size), "pair-counts")
    level = F.floor(F.log2("n")).cast("int")
    per_level, room, least = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True), head, 99  # one row for each power of two
    for r in per_level:
        if (room := room - r["count"]) < 0:
            break
        least = r.level
    table = counts.where(level >= least).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    names = [c for c in aligned.columns if c != "links"]
    rest_kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches):
        pairs, n, best = known.value
        for batch in batches:
            sizes, sums, flags, rest = [], [], [], []
            for value in batch.column("links"):
                links = np.frombuffer(value.as_buffer(), dtype=f"<u{width}").astype(np.int64)
                if not len(links) or not len(pairs):
                    at, there = np.zeros(len(links), dtype=np.int64), np.zeros(len(links), dtype=bool)
                else:
                    at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                    there = pairs[at] == links
                sums.append(int(n[at[there]].sum()))
                flags.append(int(best[at[there]].sum()))
                other, times = np.unique(links[~there], return_counts=True)
                rest.append([{"pair": p, "times": t} for p, t in zip(other.tolist(), times.tolist())])
            made = [pa.array(flags, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, rest_kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n_best", "count_sum", "rest"])

    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in names)
    scored = written(aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(counts.where(level < least), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = scored.join(rest, "row", "left")
    n_best, count_sum = (F.col(c) + F.coalesce(F.col(m), F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more")))
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256")
