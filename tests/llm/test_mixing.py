import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing as m

from .test_quality import corpus, frames


def brute(t, p, target, ridge):
    """The same minimum by plain projected gradients, for very long."""
    w = t / t.sum()
    r = np.ones(len(t))
    for _ in range(20000):
        r = np.maximum(0, r - (p @ ((w * r) @ p - target) + ridge * (r - 1)) / (1 + ridge))
    return r


def test_rates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet([0.4, 0.3, 0.3], 200), 3)
    t = rng.integers(1, 500, 200)
    target = np.array([0.8, 0.15, 0.05])
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "t long, p0 double, p1 double, p2 double").repartition(3)
    step, _, _ = m.solve(table, 3, target, 1.0, 0.01, 300, 1e-9)
    got, want = np.maximum(0, 1 + p @ step), brute(t.astype(float), p, target, 0.01)
    assert np.abs(got - want).max() < 2e-3 and (got >= 0).all()


def test_domain_totals_meet_their_targets(spark):
    rows, labels = corpus(500)
    docs, lab = frames(spark, rows, labels[:350])
    out = m.rates(docs, lab, target=(0.7, 0.2, 0.1)).toPandas()
    assert len(out) == 500
    total = (out.n_tokens * out.rate).to_numpy() @ out[["p_clean", "p_low", "p_toxic"]].to_numpy() / out.n_tokens.sum()
    assert total == pytest.approx([0.7, 0.2, 0.1], rel=0.002)
    held = out[out.doc_id >= 350]
    guess = held[["p_clean", "p_low", "p_toxic"]].to_numpy().argmax(axis=1)
    assert np.mean(guess == [{0: 2, 1: 1}.get(d % 5, 0) for d in held.doc_id]) > 0.9
    twice = m.rates(docs, lab, target=(0.7, 0.2, 0.1), budget=2.0).toPandas()
    assert (twice.n_tokens * twice.rate).sum() == pytest.approx(2 * out.n_tokens.sum(), rel=0.002)


def test_odd_rows(spark):
    rows, labels = corpus(60)
    rows += [(500, None, None, None), (501, "", "en", "s1"), (None, "a b", "en", "s1"), (500, "x " * 100_000, "en", "s0")]
    docs, lab = frames(spark, rows, [*labels, (None, 1, 1), (5, 1, 1)])
    docs = docs.selectExpr("*", "1 as t", "2 as p0", "'z' as rate")
    out = m.rates(docs, lab, steps=10).toPandas()
    assert len(out) == 64 and (out.rate >= 0).all()
    none = m.rates(docs, lab.limit(0), steps=5).toPandas()
    assert (none.p_clean == 1).all() and len(none) == 64
    assert len(m.rates(docs.limit(0), lab)._jdf.collectAsList()) == 0
    assert (m.rates(docs.where("text = '' or text is null"), lab).toPandas().rate == 1).all()


@pytest.mark.parametrize("target", [(0.9, 0.08, 0.02), (0.99, 0.007, 0.003), (0.2, 0.3, 0.5)])
def test_each_total_of_the_drivers_tables_is_within_a_hundredth(spark, target):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        out = m.rates(docs, labels, target=target).cache()
    tokens = out.agg(F.sum("n_tokens")).first()[0]
    got = {r.domain: r.total / tokens for r in m.totals(out).collect()}
    assert [got[x] for x in m.DOMAINS] == pytest.approx(target, rel=0.01) and out.agg(F.min("rate")).first()[0] >= 0


def test_a_budget_of_the_first_domains_tokens(spark):
    rows, labels = corpus(300)
    docs, lab = frames(spark, rows, labels)
    at_one = {r.domain: r.total for r in m.totals(m.rates(docs, lab).withColumn("rate", F.lit(1.0))).collect()}
    got = {r.domain: (r.total, r.share) for r in m.totals(m.rates(docs, lab, target=(0.9, 0.06, 0.04), budget=None)).collect()}
    assert got["clean"][0] == pytest.approx(at_one["clean"], rel=0.002)
    assert [got[x][1] for x in m.DOMAINS] == pytest.approx([0.9, 0.06, 0.04], rel=0.002)


def test_targets_that_no_rates_reach_are_warned_of(spark):
    rows, labels = corpus(60)
    docs, lab = frames(spark, rows, labels)
    with pytest.warns(UserWarning, match="low, toxic"):
        m.rates(docs, lab.limit(0), target=(0.5, 0.3, 0.2))


def test_copies_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, 7, 8), (2, 7, 8), (None, 7, 8), (3, 7, 8), (3, 7, 9)], "doc_id long, times int, nth int").selectExpr("*", "9 as __times", "5 as rate")
    rated = spark.createDataFrame([(1, 3.0), (2, 0.0), (3, 2.0), (3, 1.0), (None, 4.0)], "doc_id long, rate double")
    out = [tuple(r) for r in m.resampled(docs, rated).collect()]
    assert sorted(out, key=repr) == sorted([(1, 7, 8, 9, 5)] * 3 + [(3, 7, 8, 9, 5)] * 2 + [(3, 7, 9, 9, 5)] * 2 + [(None, 7, 8, 9, 5)], key=repr)
