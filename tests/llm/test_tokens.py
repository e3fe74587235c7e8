import base64
import random

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from foliant.llm import token_counts, token_ids as t

RANKS = open(t.RANKS, "rb").read()
PAIRS = tiktoken.Encoding("ranks", pat_str=t.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
TEXTS = ["", None, "Don't stop, it's 12345  end \n\n x", "naïve café — 漢字 😀!!", "a" * 3000, " " * 2000, "\t\n" * 50, "x'll 're y''s ' s", "word " * 40000, "\x1c\x85  z"]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_round_trip(values, cut):
    parts = [values[: len(values) * cut // 3], values[len(values) * cut // 3 :], [0] * (cut * 150)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.array([x for p in parts for x in p], np.uint64)
    words, seg, blocks, block_off = t.encode(flat, off)
    for i, p in enumerate(parts):
        got = t.decode(words[seg[i] : seg[i + 1]], blocks[block_off[i] : block_off[i + 1]], len(p))
        assert got.tolist() == p
        for j, o in enumerate(blocks[block_off[i] : block_off[i + 1]]):  # any block on its own
            part = p[j * t.BLOCK : (j + 1) * t.BLOCK]
            assert t.decode(words[seg[i] + o : seg[i + 1]], np.array([0]), len(part)).tolist() == part


def test_packing_is_dense():
    ids = np.full(1280, 7)
    words, *_ = t.encode(ids, np.array([0, 1280]))
    assert len(words) == 70  # 20 values of 3 bits a word, 7 words a block


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    many = ["".join(r.choices("ab c'd.1é漢\n 	", k=r.randint(0, 60))) for _ in range(150)]
    return list(enumerate(TEXTS + many))


def test_packed_ids_decode_to_the_encoders(spark, docs):
    enc = t.encoder(RANKS, t.PATTERN)
    rows = spark.createDataFrame([*docs, (None, "null id"), (3, "again")], "doc_id long, text string").selectExpr("*", "1 as words", "2 as n_tokens")
    out = t.packed(rows).collect()
    assert len(out) == len(docs) + 2
    want = sorted((d, tuple(enc.encode_ordinary(x or ""))) for d, x in [*docs, (-1, "null id"), (3, "again")])
    got = sorted((-1 if r.doc_id is None else r.doc_id, tuple(t.decode(np.frombuffer(r.words, "<u8"), np.array(r.block_offsets, np.int64), r.n_tokens).tolist())) for r in out)
    assert got == want
    assert t.packed(rows.limit(0)).collect() == []


@pytest.mark.parametrize("most", [10**6, 5, 0])
def test_counts_are_the_encoders(spark, docs, most):
    enc = t.encoder(RANKS, t.PATTERN)
    rows = spark.createDataFrame([*docs, (None, "null id"), (None, "and more"), (3, "again")], "doc_id long, text string").selectExpr("*", "1 as piece", "2 as k")
    out = token_counts.token_counts(rows, most=most).collect()
    got = {r.doc_id: r.n_tokens for r in out}
    split = regex.compile(t.PATTERN).findall
    pre = {d: len(split(x or "")) for d, x in docs}
    pre[3] += len(split("again"))
    pre[None] = sum(len(split(x)) for x in ("null id", "and more"))
    assert {r.doc_id: r.n_pretokens for r in out} == pre
    want = {d: len(enc.encode_ordinary(x or "")) for d, x in docs}
    want[3] += len(enc.encode_ordinary("again"))
    want[None] = sum(len(enc.encode_ordinary(x)) for x in ("null id", "and more"))
    assert got == want
    assert token_counts.token_counts(rows.limit(0), most=most).collect() == []


def test_long_texts_are_split_alike(docs, monkeypatch):
    enc = t.encoder(RANKS, t.PATTERN)
    want = [PAIRS.encode_ordinary(x or "") for _, x in docs]
    monkeypatch.setattr(t, "LONG", 0)
    assert [enc.encode_ordinary(x or "") for _, x in docs] == want


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_long_runs_of_white_space(spark, blank):
    n = 1_200_000
    ends = [" end"] if blank == " " else [blank, "end"]
    want = {
        1: [*PAIRS.encode_ordinary("begin"), *PAIRS._encode_single_piece(blank * (n - 1)), *(x for e in ends for x in PAIRS.encode_ordinary(e))],
        2: PAIRS._encode_single_piece(blank * n),
        3: PAIRS.encode_ordinary("other"),
    }
    rows = spark.createDataFrame([(1, "begin" + blank * n + "end"), (2, blank * n), (3, "other")], "doc_id long, text string")
    got = {r.doc_id: t.decode(np.frombuffer(r.words, "<u8"), np.array(r.block_offsets, np.int64), r.n_tokens).tolist() for r in corpus_pipeline.tokenize(spark, rows, "").collect()}
    assert got == want
    counts = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(rows).collect()}
    assert counts == {1: (2 + len(ends), len(want[1])), 2: (1, len(want[2])), 3: (1, len(want[3]))}


def test_bytes_that_are_not_utf8(spark):
    odd = {1: b"a surrogate \xed\xa0\x80 here", 2: b"overlong \xc0\x80", 3: b"\xf7\xbf\xbf\xbf beyond", 4: "plain é".encode()}
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in odd.items()], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    want = {k: PAIRS.encode_ordinary(x.decode("utf-8", "replace")) for k, x in odd.items()}
    got = {r.doc_id: t.decode(np.frombuffer(r.words, "<u8"), np.array(r.block_offsets, np.int64), r.n_tokens).tolist() for r in corpus_pipeline.tokenize(spark, rows, "").collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows).collect()} == {k: len(x) for k, x in want.items()}
