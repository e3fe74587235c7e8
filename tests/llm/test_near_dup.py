import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import near_dup as n
from foliant.llm.textkit import Words, shingles, words_of

R = random.Random(5)
VOCABULARY = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(400)]


def prose(k):
    return [R.choice(VOCABULARY) for _ in range(k)]


def edited(words, share):
    return [R.choice(VOCABULARY) if R.random() < share else w for w in words]


def brute(rows, threshold):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        if d is not None and w:
            sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    group = {d: d for d, _ in rows if d is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    pairs = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                pairs.add((a, b))
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {d: find(d) for d in group}, pairs


@pytest.mark.parametrize("bucket", [4096, 3])
def test_groups_match_brute_force(spark, bucket):
    rows, d = [], 0
    for size in (1, 2, 3, 40):
        for _ in range(12 if size < 40 else 1):
            base = prose(R.randint(30, 200))
            for _ in range(size):
                rows.append((d, " ".join(edited(base, R.choice([0, 0.03, 0.06])))))
                d += 1
    want, pairs = brute(rows, 0.5)
    out = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()
    got = {r.doc_id: r.group_id for r in out}
    assert all((r.n_links > 0) == (list(got.values()).count(r.group_id) > 1) for r in out)
    assert set(got) == set(want)
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs)
    assert all(want[a] == want[b] for a, b in got.items())  # nothing is joined that brute force keeps apart
    assert all(r.kept == (r.doc_id == r.group_id) for r in out)


@pytest.mark.parametrize("bucket", [4096, 40])
def test_copies_of_one_original_are_linked_whatever_leads(spark, bucket):
    base = prose(400)
    rows = [(150, " ".join(base))]
    for d in (*range(150), *range(151, 301)):
        new = {R.randrange(at, at + 12) for at in range(0, 396, 12)}  # a quarter of the runs of three words
        rows.append((d, " ".join(f"own{d}" if i in new else w for i, w in enumerate(base))))
    want, pairs = brute(rows, 0.5)
    assert pairs == {(min(d, 150), max(d, 150)) for d, _ in rows if d != 150}  # the copies aren't alike to each other
    got = {r.doc_id: r.group_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs), (found, len(pairs))
    assert all(want[a] == want[b] for a, b in got.items())


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c d", "x"), (4, "A, b; c. D!", "x"), (None, "a b c d", "x"), (5, "lone", None), (6, "lone", None), (3, "a b c d", "x"), (7, "word " * 30000, "x"), (8, "字字 字", "x"), (9, "字字字", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string").withColumn("c1", F.lit(1)).withColumn("bands", F.lit(2)).withColumn("rep", F.lit(3))
    got = {r.doc_id: r.group_id for r in n.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}
    assert n.near_duplicates(docs.limit(0)).collect() == []


def test_a_repeated_id_is_alike_to_what_each_of_its_texts_is(spark):
    a, b, c = prose(60), prose(60), prose(60)
    near = lambda x: " ".join(["other", *x[1:]])
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, near(b)), (20, " ".join(c)), (21, " ".join(c)), (21, near(c)), (22, "alone")]
    rows += [(7, " ".join(b))]  # 5 stands for this copy
    got = {r.doc_id: r.group_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20, 22: 22}


def test_words_are_those_of_the_definition():
    texts = ["Ab c-d éÉ 1x", "", "漢字ab字 ñandú", "  ", "a b", "😀x😀"]
    w = Words(pa.array([*texts, None]))
    got = [[bytes(w.data[s : s + z]) for s, z in zip(w.start[a:b], w.size[a:b])] for a, b in zip(w.off, w.off[1:])]
    assert got[:-1] == [words_of(t) for t in texts] and got[-1] == []
    same = defaultdict(set)
    for row, (a, b) in zip(got, zip(w.off, w.off[1:])):
        for word, h in zip(row, w.hash[a:b]):
            same[word].add(int(h))
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        est = []
        for _ in range(30):
            both = rng.integers(0, 2**64 - 1, int(1000 * j), dtype=np.uint64)
            u = np.concatenate([both, rng.integers(0, 2**64 - 1, (1000 - len(both)) // 2, dtype=np.uint64)])
            v = np.concatenate([both, rng.integers(0, 2**64 - 1, (1000 - len(both)) // 2, dtype=np.uint64)])
            k = n.registers(np.concatenate([u, v, u, v]), np.array([0, len(u), len(u) + len(v), 2 * (len(u) + len(v))]), 128)
            assert (np.maximum(k[0], k[1]) == k[2]).all()  # the sketch of a union
            est.append(n.jaccard_ml(k[:1], k[1:2])[0])
        assert abs(np.mean(est) - j) < 0.03
    k = n.registers(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64), np.array([0, 5000]), 128)
    assert abs(n.cardinality(k)[0] / 5000 - 1) < 0.35
    assert (shingles(np.zeros(0, np.uint64), np.array([0, 0]), 3)[1] == [0, 0]).all()


def test_pairs_just_over_the_threshold_are_found(spark):
    """Of pairs with a similarity of 0.50 to 0.55 at least 99 in 100 are in one group."""
    rows, close = [], []
    for i in range(600):
        w = prose(R.randint(120, 260))
        v = list(w)
        for at in R.sample(range(1, len(w) - 1, 4), int(len(w) * R.uniform(0.095, 0.12))):
            v[at] = f"own{i}x{at}"
        a, b = ({tuple(x[j : j + 3]) for j in range(len(x) - 2)} for x in (w, v))
        if 0.5 <= len(a & b) / len(a | b) < 0.55:
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
            close.append(2 * i)
    got = {r.doc_id: r.group_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(close) > 200 and np.mean([got[d] == got[d + 1] for d in close]) >= 0.99


def test_a_hot_id_of_many_texts_and_rows(spark):
    rows = [(1, " ".join(prose(30))) for _ in range(200)] + [(1, "a b c d e f")] * 300 + [(2, "a b c d e f"), (3, rows_ := " ".join(prose(40))), (4, rows_ + " z")]
    got = {r.doc_id: (r.group_id, r.kept) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (3, False)}
