import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtide.llm import vocab
from jobtide.llm.byte_bpe import decode, encode
from jobtide.llm.packing import assign, encoder, pack
from jobtide.llm.token_counts import count_symbols, token_counts
from jobtide.llm.vocab import merge_piece, read_ranks

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", "é", "1", "²", "'s", "'ll", "<|endoftext|>", "<|endof", "日本", "\x85", "\x1c", "​", "!", "🙂", "th", "ing", "aaaa", "\t"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return [*made, "", None, "", "a" * 3000, " " * 3000, "word " * 2000, "x" * 700 + " y" * 700]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 5 else i // 2, t, "clash", i) for i, t in enumerate(texts)]  # ids repeat
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string, n_tokens long").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_those_of_the_library(docs, texts, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON, PATTERN, known=50).collect())
    want = []
    for i, t in enumerate(texts):
        n = len(ids_of(library, t))
        want.append((i == 5, 0 if i == 5 else i // 2, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abthe éin", min_size=1, max_size=30), min_size=1, max_size=20))
def test_rank_synchronous_merging_counts_like_a_heap(pieces):
    data = [p.encode() for p in pieces]
    ranks = read_ranks(JSON)
    by_heap = [len(merge_piece(b"\0" + p, ranks)) for p in data]  # the first byte keeps whole words from being looked up
    assert count_symbols([b"\0" + p for p in data], JSON).tolist() == by_heap


def test_pieces_hold_every_token_once(docs, texts, library):
    pieces = pack(docs, JSON, PATTERN, size=64, window=500).collect()
    want = sorted(([*ids_of(library, t), 0] for t in texts), key=lambda x: (len(x), x))
    held, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.tokens, dtype="<u4").tolist()
        assert len(ids) == p.length and p.length > 0
        held.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(map(len, want))
    assert sorted(i for p in pieces for i in np.frombuffer(p.tokens, dtype="<u4").tolist()) == sorted(i for w in want for i in w)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and at & at - 1 == 0  # full, or a power of two
    single = {k: v for k, v in held.items() if sum(len(x) for _, x in v) == k[1]}
    for parts in single.values():
        assert [i for _, x in sorted(parts) for i in x] in want


@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([8, 64]))
def test_assignment_fills_all_sequences(lengths, size):
    rows = assign(lengths, size, 1.0, 0.01)
    fill, seen = {}, {}
    for doc, start, n, s, offset in rows:
        assert offset == fill.get(s, 0) and 0 < n <= size
        fill[s] = offset + n
        seen.setdefault(doc, []).append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == length
    assert all(f & f - 1 == 0 and f <= size for f in fill.values()) and sum(f == size for f in fill.values()) >= sum(lengths) // size


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.randint(1, 300) for _ in range(400)]
    cost = {}
    for _, _, n, s, _ in assign(lengths, 512, 1.0, 0.01):
        cost[s] = cost.get(s, 0) + n + 0.01 * n * n
    full = sorted(cost.values())[10:]
    assert full[-1] < 1.5 * sum(full) / len(full)


def test_runs_of_blanks_that_the_library_gives_up_on():
    assert encoder(JSON, PATTERN)(" " * 1_200_000 + "a")[-1] == Tokenizer.from_file(JSON).encode("  a").ids[-1]


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (60, 12), (1000, 100)])
def test_round_trip_is_that_of_the_library(docs, texts, chunk, overlap):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = encode(docs, RANKS, PATTERN, chunk, overlap, known=50)
    got = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, dtype="<u4").tolist(), r.n_tokens) for r in encoded.collect())
    want = [(i == 5, 0 if i == 5 else i // 2, ids := library.encode_ordinary(t or ""), len(ids)) for i, t in enumerate(texts)]
    assert got == sorted(want)
    back = sorted(bytes(r.bytes) for r in decode(encoded, RANKS).collect())
    assert back == sorted((t or "").encode() for t in texts)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert token_counts(none, JSON, PATTERN).collect() == pack(none, JSON, PATTERN).collect() == decode(encode(none, RANKS, PATTERN), RANKS).collect() == []


def test_digest_of_ids_is_little_endian(docs):
    row = pack(docs.where("text = 'x'").unionByName(docs.limit(1)), JSON, PATTERN).select("tokens", F.crc32("tokens").alias("c")).first()
    assert zlib.crc32(bytes(row.tokens)) == row.c


def test_short_pieces_merge_as_long_ones_do(monkeypatch):
    ranks, rng = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), random.Random(81)
    pieces = ["".join(rng.choices("ab'cdethin éß漢01!?", k=rng.randrange(40))).encode() for _ in range(500)]
    pieces += [bytes(rng.choices(range(256), k=rng.randrange(48))) for _ in range(200)] + [b"a" * k for k in range(vocab._SHORT + 3)]
    short = [merge_piece(p, ranks) for p in pieces]
    assert any(len(x) > 5 for x in short)
    monkeypatch.setattr(vocab, "_SHORT", -1)
    assert short == [merge_piece(p, ranks) for p in pieces]
