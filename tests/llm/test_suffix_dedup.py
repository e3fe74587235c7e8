import random

import numpy as np
import pytest

from foliant.llm import suffix_dedup as s

R = random.Random(8)
V = ["".join(R.choices("abcdefghij", k=R.randint(1, 6))) for _ in range(500)]


def prose(k):
    return [R.choice(V) for _ in range(k)]


def brute(rows, length):
    """Spans from all windows; rows in order, one for each document."""
    first, marks = {}, set()
    for d, text in rows:
        w = (text or "").split()
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if key in first:
                marks |= {(d, p, False), (*first[key], True)}
            else:
                first[key] = (d, p)
    out = []
    for d, p, kept in sorted(marks, key=lambda m: (m[0], m[2], m[1])):
        if out and out[-1][0] == d and out[-1][3] == kept and p <= out[-1][2]:
            out[-1][2] = p + length
        else:
            out.append([d, p, p + length, kept])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block", [1, 12_000])
def test_spans_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK_ROWS", block)
    passages = [prose(R.randint(15, 120)) for _ in range(12)]
    rows = []
    for d in range(120):
        w = prose(R.randint(0, 150))
        for _ in range(R.randint(0, 3)):
            at = R.randint(0, len(w))
            p = R.choice(passages)
            a = R.choice([0, 0, R.randint(0, 10)])
            w[at:at] = p[a:]
        rows.append((d, " ".join(w)))
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    rows += [(600, "a " * 300), (601, "x a " * 200), (602, "b " + "a " * 70), (603, "p q r s t u v " * 40), (604, "r s t u v p q " * 30)]
    got = sorted((r.doc_id, r.start, r.end, r.kept) for r in s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect())
    assert got == brute(rows, 20) and len(got) > 100


def test_suffix_order_is_the_suffix_arrays():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 3, 40):
        text = np.concatenate([rng.integers(1, kinds + 1, 90), np.zeros(4 * s.V + 100, np.int64)])
        at = rng.permutation(60)
        order, _ = s.suffix_order(text, at, np.zeros(60, np.int64))
        key = lambda i: text[i : i + 64].tolist()
        assert [key(at[i]) for i in order] == sorted(map(key, at))


def test_odd_rows(spark):
    p = " ".join(prose(60))
    rows = [(1, p), (1, p), (None, p), (2, None), (3, ""), (4, "x " + p), (5, "y " * 90000), (6, "字" * 60), (7, "字" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g", "2 as t", "3 as start", "'z' as seg")
    got = sorted((r.doc_id, r.start, r.end, r.kept) for r in s.repeated_passages(docs).collect())
    assert got == [(1, 0, 60, True), (4, 1, 61, False), (5, 0, 45, True), (5, 1, 90000, False), (6, 0, 45, True), (6, 1, 60, False), (7, 0, 60, False)]
    assert s.repeated_passages(docs.limit(0)).collect() == []
    assert s.repeated_passages(docs.where("doc_id = 1")).collect() == []
