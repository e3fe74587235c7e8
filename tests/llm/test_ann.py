import numpy as np
import pytest

from foliant.llm import ann


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], "vec_id long, embedding array<float>")


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, clustered):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    if clustered:
        x = x * 0.2 + rng.normal(size=(20, 32))[rng.integers(0, 20, 600)]
    out = ann.neighbours(frame(spark, x.astype(np.float32)), k=5, every=1).collect()
    want = {(i, j) for i, r in enumerate(brute(x, 5)) for j in r}
    assert len({(r.vec_id, r.neighbour_id) for r in out} & want) >= 0.95 * len(want)
    for r in out[:50]:
        assert r.similarity == pytest.approx(x[r.vec_id] @ x[r.neighbour_id] / np.linalg.norm(x[r.vec_id]) / np.linalg.norm(x[r.neighbour_id]), abs=1e-5)


def test_both_plans_retrieve_every_code_within_the_radius(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(10, 16))[rng.integers(0, 10, 150)] + 0.15 * rng.normal(size=(150, 16))).astype(np.float32)
    rows = {p: sorted(map(tuple, ann.neighbours(frame(spark, x), k=150, every=1, radius=37, plan=p).collect())) for p in ("scan", "probe")}
    assert [r[:3] + r[4:] for r in rows["scan"]] == [r[:3] + r[4:] for r in rows["probe"]] and len(rows["scan"]) > 500
    unit = (x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    import pyspark.sql.functions as F
    order = [r.vec_id for r in frame(spark, x).orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    c = ann.codes(unit, *ann.learn(unit[order]))
    h = np.bitwise_count(c[:, None] ^ c[None]).sum(axis=2)
    assert len(rows["scan"]) == (h <= 37).sum() - 150


def test_pigeonhole():
    assert ann.balls(0) == [0] + [-1] * 15 and ann.balls(16) == [1, *[0] * 15] and ann.balls(37) == [2] * 6 + [1] * 10
    assert ann.probing_reads(37) < 1 < ann.probing_reads(105)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), (8, [1.0, None]), (1, [1.0, 0.0]), (9, [2.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "'c' as c", "2 as rank")
    out = ann.neighbours(t, k=3, every=1, radius=256).collect()
    assert {r.vec_id for r in out} == {1, 2, 3, 9}
    assert [(r.neighbour_id, round(r.similarity, 3)) for r in sorted(out, key=lambda r: r.rank) if r.vec_id == 1] == [(9, 1.0), (2, 0.994), (3, 0.0)]
    assert ann.neighbours(t.limit(0)).collect() == [] and ann.neighbours(t.where("vec_id = 2"), every=1).collect() == [] and ann.neighbours(t).collect() == []


def test_queries_are_the_rows_of_every_twentieth_id_and_each_has_its_k(spark):
    """Loose vectors far from all clusters have no code within the radius, and get their neighbours all the same."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(20, 24))[rng.integers(0, 20, 800)] + 0.05 * rng.normal(size=(800, 24))).astype(np.float32)
    loose = np.arange(0, 800, 80)
    x[loose] = 3 * rng.normal(size=(len(loose), 24))
    out = ann.neighbours(frame(spark, x), k=6).collect()
    want = brute(x.astype(np.float64), 6)
    got = {}
    for r in sorted(out, key=lambda r: r.rank):
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert sorted(got) == list(range(0, 800, 20)) and all(len(v) == 6 for v in got.values())
    recall = lambda ids: np.mean([len(set(got[i]) & set(want[i])) / 6 for i in ids])
    assert recall(got) >= 0.9 and recall(loose) >= 0.9


@pytest.mark.parametrize("block", [7, 10**6])
def test_blocks_change_nothing(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(130, 8)).astype(np.float32)
    monkeypatch.setattr(ann, "QUERIES", block)
    got = {(r.vec_id, r.rank): r.neighbour_id for r in ann.neighbours(frame(spark, x), k=4, radius=256).collect()}
    want = brute(x.astype(np.float64), 4)
    assert got == {(i, j + 1): want[i][j] for i in range(0, 130, 20) for j in range(4)}


def test_other_ids_raise(spark):
    with pytest.raises(TypeError):
        ann.neighbours(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
