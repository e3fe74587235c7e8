import random

import pytest

from foliant.operators import analytics, sorting

R = random.Random(1)
ARRAYS = [[], [5], [2, 1], [3] * 7, list(range(9)), list(range(8, -1, -1)), [R.randrange(100) for _ in range(1000)], [R.randrange(-(2**31), 2**31) for _ in range(65)], [-5, 0, 5, -5, 2**31 - 1, -(2**31)]]


@pytest.mark.parametrize("name", sorting.STRATEGIES)
def test_strategies_sort(spark, name):
    for a in ARRAYS:
        df = spark.createDataFrame([(x,) for x in a], "value int")
        got = [r.value for r in sorting.sort_by(df, name).collect()]
        assert got == sorted(a)


@pytest.mark.parametrize("name", sorting.STRATEGIES)
def test_places_are_the_strategys_own(spark, monkeypatch, name):
    """A strategy that doesn't sort gets places that aren't the values' order."""
    a = [R.randrange(-500, 500) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in a], "value int").repartition(3)
    order = lambda: [r.value for r in sorted(analytics.placed(sorting.sort_by(df, name)).collect(), key=lambda r: r.pos)]
    assert order() == sorted(a)
    monkeypatch.setitem(sorting.STRATEGIES, name, ("", lambda x: x))
    assert order() != sorted(a)


def test_a_hot_value_is_no_array(spark):
    df = spark.range(200_000).selectExpr("cast(if(id % 3 = 0, 7, id % 40) as int) as value")
    want = sorted(r.value for r in df.collect())
    for name in ("binary_insertion", "bitonic", "comb", "heap", "gnome"):
        assert [r.value for r in sorting.sort_by(df, name).collect()] == want


def test_positions(spark):
    for a in ARRAYS:
        df = spark.createDataFrame([(x, i) for i, x in enumerate(a)], "value int, i int").repartition(3)
        got = sorted((r.pos, r.value, r.i) for r in analytics.positioned(df, "value", "i").collect())
        assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(a)))]


def test_histogram_and_digits(spark):
    df = spark.createDataFrame([(x,) for x in (5, 15, 25, 7, -12)], "value int")
    assert sorted(map(tuple, sorting.digit_starts(df).collect())) == [(2, 1, 1), (5, 3, 4), (7, 1, 5)]
    assert sorted(map(tuple, sorting.histogram(df).collect())) == [(-12, 1), (5, 1), (7, 1), (15, 1), (25, 1)]
    assert [r.value for r in sorting.distinct_sorted(df.union(df)).collect()] == [-12, 5, 7, 15, 25]


def test_harness(spark):
    df = sorting.random_ints(spark, 500, 3)
    assert df.collect() == sorting.random_ints(spark, 500, 3).collect()
    out = sorting.measure(df, ("tim", "radix")).collect()
    assert [(r.method, r.size) for r in out] == [("tim", 500), ("radix", 500)] and all(r.time_ns > 0 for r in out)
