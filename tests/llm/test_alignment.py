import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from jobtide.llm.alignment import align, component_labels, report
from jobtide.llm.vocab import byte_letters

BYTE, PIECE, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
PARTS = ["a", " ", "  ", "\n", "é", "é́", "1", "½", "'s", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "日本", "\x00", "﻿", "！", "🙂", "thing", " and", "ﬁ", "\t", "x" * 40]


class Plain:
    """Tokens by the libraries and groups and links by loops over bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def tokens(self, text):
        if not text:
            return [], []
        letters = byte_letters()
        a = [(i, bytes(letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return a, b

    def groups(self, a, b):
        out, x, y, n, m = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if n <= m and a:
                i, t = a.pop()
                x, n = [*x, i], n + len(t)
            else:
                i, t = b.pop()
                y, m = [*y, i], m + len(t)
            if n == m:
                out.append((x, y))
                x, y = [], []
        return out

    def links(self, a, b):
        owner = {}
        for side, tokens in enumerate((a, b)):
            at = 0
            for k, (i, t) in enumerate(tokens):
                for p in range(at, at + len(t)):
                    owner.setdefault(p, []).append((k, i))
                at += len(t)
        return [(x[1], y[1]) for x, y in {tuple(v) for v in owner.values()}]

    def report(self, texts):
        made = [(d, *self.tokens(t)) for d, t in texts]
        links = [self.links(a, b) for _, a, b in made]
        counts = Counter(x for each in links for x in each)
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(n, best.get(b, 0))
        out = []
        for (d, a, b), each in zip(made, links):
            groups = self.groups(a, b)
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            digest = sha256(text.encode()).hexdigest() if text else ""
            out.append((d, len(a), len(b), len(groups), len(each), sum(counts[x] == best[x[1]] for x in each), sum(counts[x] for x in each), digest))
        return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    made += ["a hot text, met very often"] * 80 + ["", None, "a▁b", "▁", " ", "  a  b ", "word " * 1500, " " * 2000, "x" * 3000]
    return [(None if i == 7 else i // 2, t) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, row int, links string").repartition(3)


@pytest.mark.parametrize("head", [1 << 20, 300, 0])  # all pairs known to every task, some, none
def test_figures_are_those_of_loops_over_bytes(docs, texts, head):
    got = sorted(map(tuple, report(docs, BYTE, PATTERN, PIECE, head=head).collect()), key=repr)
    assert got == sorted(Plain().report(texts), key=repr)


def test_groups_and_links(docs, texts):
    plain = Plain()
    want = []
    for d, t in texts:
        a, b = plain.tokens(t)
        pairs = sorted(x * 32000 + y for x, y in plain.links(a, b))
        want.append((d, ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain.groups(a, b)), pairs))
    got = [(r.doc_id, r.groups, sorted(np.frombuffer(r.links, dtype="<u4").tolist())) for r in align(docs, BYTE, PATTERN, PIECE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 59)), st.sets(st.integers(1, 59)))
def test_pointers_end_at_the_last_token_of_the_group(a, b):
    ends_a, ends_b = (np.array(sorted({*x, 60})) for x in (a, b))
    top_a, top_b, links = component_labels(ends_a, ends_b)
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for ends, top in ((ends_a, top_a), (ends_b, top_b)):
        assert [ends_a[t] for t in top] == [min(c for c in common if c >= e) for e in ends.tolist()]
    spans = [list(zip([0, *e.tolist()], e.tolist())) for e in (ends_a, ends_b)]
    assert sorted(map(tuple, links.tolist())) == [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]


def test_empty_table_and_ids_that_are_no_numbers(docs):
    assert report(docs.limit(0), BYTE, PATTERN, PIECE).count() == 0
    named = report(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), BYTE, PATTERN, PIECE, head=100)
    same = report(docs, BYTE, PATTERN, PIECE)
    assert sorted(r.count_sum for r in named.collect()) == sorted(r.count_sum for r in same.collect())
