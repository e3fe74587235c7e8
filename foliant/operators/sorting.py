"""Twelve ways to sort integers, as relational shapes, and a harness that times them.

All give the correct order, whatever the input.  ``tree`` has a variant of its own: distinct values
in order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WIDTH = 16


def _arrays(df: DataFrame, sort: Callable[[Column], Column]) -> DataFrame:
    """Distinct values by ranges of ``WIDTH``, each range sorted as an array of (value, n), ranges in order.

    No array has more than ``WIDTH`` elements, however often a value occurs."""
    pair = F.struct("value", "n")
    ranges = _counted(df).groupBy(F.floor(F.col("value") / WIDTH).alias("range")).agg(F.collect_list(pair).alias("a"))
    each = ranges.orderBy("range").select(F.explode(sort(F.col("a"))).alias("x"))
    return each.select("x.value", F.explode(F.sequence(F.lit(1), "x.n")).alias("i")).select("value")


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("value").agg(F.count("*").alias("n"))


def _expanded(counts: DataFrame) -> DataFrame:
    return counts.orderBy("value").select("value", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select("value")


def _tim(df: DataFrame) -> DataFrame:
    return df.orderBy("value")


def _comb(df: DataFrame) -> DataFrame:
    return _arrays(df, F.array_sort)


def _selection(df: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("range").orderBy("value"))
    return df.withColumn("range", F.floor(F.col("value") / WIDTH)).withColumn("nth", nth).orderBy("range", "nth").select("value")


def distinct_sorted(df: DataFrame) -> DataFrame:
    return df.select("value").distinct().orderBy("value")


def _tree(df: DataFrame) -> DataFrame:
    return distinct_sorted(df).join(_counted(df), "value").orderBy("value").select("value", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select("value")


def _pigeonhole(df: DataFrame) -> DataFrame:
    return _expanded(_counted(df))


def _bucket(df: DataFrame) -> DataFrame:
    low = df.agg(F.min("value").alias("low"))
    bucket = F.floor((F.col("value").cast("long") - F.col("low")) / WIDTH)
    return df.crossJoin(F.broadcast(low)).orderBy(bucket, "value").select("value")


def _quick(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("value").sortWithinPartitions("value")


def _heap(df: DataFrame) -> DataFrame:
    return _arrays(df, lambda a: F.array_sort(a, lambda x, y: F.when(x.value < y.value, -1).when(x.value > y.value, 1).otherwise(0)))


def _bitonic(df: DataFrame) -> DataFrame:
    """The bitonic network over ``WIDTH`` places, filled up with values larger than any."""
    steps = [(k, j) for k in (2, 4, 8, 16) for j in (8, 4, 2, 1) if j < k]
    network = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(j).alias("j")) for k, j in steps))

    def step(a: Column, s: Column) -> Column:
        def place(i: Column) -> Column:
            other = i.bitwiseXOR(s.j)
            small = (i < other) == (i.bitwiseAND(s.k) == 0)
            x, y = F.get(a, i), F.get(a, other)
            return F.when(small, F.least(x, y)).otherwise(F.greatest(x, y))

        return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), place)

    def sort(a: Column) -> Column:
        wide = F.transform(a, lambda x: F.struct(x.value.cast("long").alias("value"), x.n.alias("n")))
        most = F.struct(F.lit(1 << 40).alias("value"), F.lit(0).cast("long").alias("n"))
        done = F.aggregate(network, F.concat(wide, F.array_repeat(most, F.lit(WIDTH) - F.size(a))), step)
        return F.transform(F.filter(done, lambda x: x.n > 0), lambda x: F.struct(x.value.cast("int").alias("value"), x.n.alias("n")))

    return _arrays(df, sort)


def _gnome(df: DataFrame) -> DataFrame:
    return _arrays(df, F.sort_array)


def _binary_insertion(df: DataFrame) -> DataFrame:
    """Each value inserted at the place that a binary search among those before it finds."""

    def half(lo: Column, hi: Column) -> Column:
        return F.floor((lo + hi) / 2).cast("int")

    def put(done: Column, x: Column) -> Column:
        def look(s: Column, _: Column) -> Column:
            mid = half(s.lo, s.hi)
            above, open_ = F.get(done, mid).value <= x.value, s.lo < s.hi
            lo = F.when(open_ & above, mid + 1).otherwise(s.lo)
            return F.struct(lo.alias("lo"), F.when(open_ & ~above, mid).otherwise(s.hi).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.size(done).alias("hi"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(WIDTH.bit_length())), start, look, lambda s: s.lo)
        return F.concat(F.slice(done, F.lit(1), at), F.array(x), F.slice(done, at + 1, F.size(done)))

    return _arrays(df, lambda a: F.aggregate(a, F.slice(a, 1, 0), put))


def _radix(df: DataFrame) -> DataFrame:
    """By decimal digits, the highest first; shifted so that none is negative."""
    return df.orderBy(*[F.expr(f"((cast(value as bigint) + {1 << 31}) div {10**k}) % 10") for k in range(9, -1, -1)])


STRATEGIES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "tim": ("O(n log n)", _tim),
    "comb": ("O(n²)", _comb),
    "selection": ("O(n²)", _selection),
    "tree": ("O(n log n)", _tree),
    "pigeonhole": ("O(n + range)", _pigeonhole),
    "bucket": ("O(n + k)", _bucket),
    "quick": ("O(n log n)", _quick),
    "heap": ("O(n log n)", _heap),
    "bitonic": ("O(n log² n)", _bitonic),
    "gnome": ("O(n²)", _gnome),
    "binary_insertion": ("O(n²)", _binary_insertion),
    "radix": ("O(d (n + k))", _radix),
}


def sort_by(df: DataFrame, name: str) -> DataFrame:
    """The column ``value`` (int) in ascending order, by one of the strategies."""
    return STRATEGIES[name][1](df.select(F.col("value").cast("int").alias("value")))


def milliseconds(nanoseconds: Column) -> Column:
    return nanoseconds / 1_000_000.0


def random_ints(spark: SparkSession, n: int, seed: int, below: int = 100_000) -> DataFrame:
    return spark.range(n).select(F.floor(F.rand(seed) * below).cast("int").alias("value"))


def histogram(df: DataFrame) -> DataFrame:
    return _counted(df)


def digit_starts(df: DataFrame, exponent: int = 1) -> DataFrame:
    """(digit, n, upto): how many values have each decimal digit, and the running sum, as a counting sort needs them."""
    digit = F.expr(f"abs(cast(value as bigint) div {exponent}) % 10")
    counts = df.groupBy(digit.cast("int").alias("digit")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))  # ten rows at most


def measure(df: DataFrame, names: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """(method, complexity, size, time_ns, time_ms) of one run of each strategy over the same persisted input."""
    df = df.persist()
    size, rows = df.count(), []
    for name in names:
        began = time.perf_counter_ns()
        sort_by(df, name).write.format("noop").mode("overwrite").save()
        took = time.perf_counter_ns() - began
        rows.append((name, STRATEGIES[name][0], size, took, took / 1e6))
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "method string, complexity string, size int, time_ns long, time_ms double")
