"""Author ranking, orders, and the report over sorting times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def author_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("authors").alias("author")).groupBy("author").agg(F.count("*").alias("appearances"))


def top_authors(records: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent authors; equals in the order of their names."""
    return author_counts(records).orderBy(F.desc("appearances"), "author").limit(k)


def by_year_and_title(records: DataFrame) -> DataFrame:
    """In the order of year, then title in any case, then input."""
    return records.orderBy("year", F.lower("title"), "ord")


def placed(df: DataFrame, name: str = "pos") -> DataFrame:
    """A column with each row's place (from 0) in the order that ``df`` has, over partitions and within them.

    A row's place is that in its partition plus the sizes of the partitions before.  The rows are
    persisted, so that both uses see the same ones, until the session's cache is cleared.
    """
    from pyspark import StorageLevel

    at = F.monotonically_increasing_id()
    kept = df.withColumn("__at", at).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    found = kept.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return found.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__start")


def positioned(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """A column with each row's place (from 0) in a total order, without a single-partition window."""
    return placed(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def benchmark_report(times: DataFrame, size: int) -> DataFrame:
    """Timings of one size over 0, the fastest first; the columns method, size and time_ms, text or numbers."""
    t = times.withColumn("time_ms", F.col("time_ms").cast("string").try_cast("double")).withColumn("size", F.col("size").cast("string").try_cast("int"))
    return t.where((F.col("size") == size) & (F.col("time_ms") > 0) & ~F.isnan("time_ms")).orderBy("time_ms", "method")


def sizes_present(times: DataFrame) -> DataFrame:
    return times.select(F.col("size").cast("string").try_cast("int").alias("size")).where("size is not null").distinct()


def bar_heights(df: DataFrame, value: str, height: int = 600, padding: int = 60) -> DataFrame:
    """``bar``: each value's share of the largest, of the height between the paddings, cut to an integer; 0 if all are 0."""
    most = df.agg(F.max(value).alias("__most"))
    scaled = F.col(value) / F.nullif(F.col("__most"), F.lit(0)) * (height - 2 * padding)
    return df.crossJoin(F.broadcast(most)).withColumn("bar", F.coalesce(scaled, F.lit(0.0)).cast("int")).drop("__most")
