import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid as g
from foliant.llm.store import smallest

R = random.Random(4)
ROOTS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "oui", "ère", "çon"]}


def prose(lang, k):
    return " ".join("".join(R.choices(ROOTS[lang], k=R.randint(1, 4))) for _ in range(k))


def brute(ll, penalty):
    """The best set of languages of one document, over all sets, by long EM."""
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    p = (1 - g.NOISE) * p + g.NOISE * p.mean(axis=1, keepdims=True)
    best = None
    for size in range(1, ll.shape[1] + 1):
        for s in combinations(range(ll.shape[1]), size):
            share = np.zeros(ll.shape[1])
            share[list(s)] = 1 / size
            for _ in range(300):
                r = p * share
                share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            score = np.log((p * share).sum(axis=1)).sum() - penalty * np.log1p(len(ll)) * (size - 1)
            if best is None or score > best[0]:
                best = score, set(s), share
    return best


def test_sets_match_brute_force():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 120, 60)
    ll = []
    for n in sizes:
        share = rng.dirichlet([0.3] * 4)
        z = rng.choice(4, n, p=share)
        x = rng.normal(0, 1.5, (n, 4)) - 4
        x[np.arange(n), z] += 4
        ll.append(x)
    off = np.concatenate([[0], np.cumsum(sizes)])
    got = g.identify(np.concatenate(ll).astype(np.float32), off, 3.0)
    same = 0
    for x, s in zip(ll, got, strict=True):
        _, want, share = brute(x, 3.0)
        if set(np.flatnonzero(s > 0)) == want:
            same += 1
            assert np.abs(s - share).max() < 0.03
    assert same >= 57


def test_mixtures_and_held_out_accuracy(spark):
    rows = [(d, prose(lang, 30), lang) for d, lang in enumerate(list(ROOTS) * 40)]
    held = [(1000 + d, prose(lang, 8), None) for d, lang in enumerate(list(ROOTS) * 20)]
    mixed = [(2000, prose("aa", 60) + " " + prose("cc", 30), None)]
    out = {r.doc_id: r for r in g.language_mixtures(spark.createDataFrame(rows + held + mixed, "doc_id long, text string, lang string")).collect()}
    assert np.mean([out[1000 + d].langs == [x] for d, x in enumerate(list(ROOTS) * 20)]) > 0.95
    assert out[2000].langs == ["aa", "cc"] and out[2000].shares[0] == pytest.approx(2 / 3, abs=0.1) and sum(out[2000].shares) == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(1, prose("aa", 50), "aa"), (2, prose("bb", 50), "bb"), (3, None, "aa"), (4, "", "bb"), (5, "!!!", None), (None, prose("aa", 9), "aa"), (1, prose("bb", 9), None), (6, prose("bb", 60000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as bucket", "1 as n", "2 as n_words")
    out = g.language_mixtures(docs).collect()
    got = sorted((r.doc_id or 0, r.lang, r.n_words) for r in out)
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, None, 0), (4, None, 0), (5, None, 0)] and len(out) == len(rows)
    assert (0, "aa", 9) in got and (1, "bb", 9) in got and (6, "bb", 60000) in got
    assert g.language_mixtures(docs.limit(0)).collect() == []
    assert all(r.lang is None for r in g.language_mixtures(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect())


def test_ties_are_in_the_order_of_names():
    ll = np.log(np.tile([[0.3, 0.3, 0.1]], (5, 1))).astype(np.float32)
    assert g.identify(ll, np.array([0, 5]), 3.0).tolist() == [[1, 0, 0]]


def test_training_takes_the_smallest_hashes_without_sorting_the_corpus(spark):
    rows = [(d % 50, prose(lang, 5), lang) for d, lang in enumerate(["aa"] * 400 + ["bb"] * 9)] + [(7, "ka", "aa")] * 300
    docs = spark.createDataFrame(rows, "d long, text string, lang string")
    got = sorted((r.lang, r.d) for r in smallest(docs.select("lang", "d"), 12, "lang").collect())
    ids = docs.select("lang", "d").distinct().withColumn("h", F.xxhash64("d")).toPandas().sort_values(["h", "d"])
    want = sorted((lang, int(d)) for lang in ("aa", "bb") for d in ids[ids["lang"] == lang].head(12)["d"])
    assert got == want and len(want) == 12 + 9
    assert smallest(docs.where("false").select("lang", "d"), 12, "lang").collect() == []
    assert sorted(r.d for r in smallest(docs.select("d"), 12).collect()) == sorted(int(d) for d in ids.drop_duplicates("d").head(12)["d"])
