"""Tables that cut lineage, in the folder that every executor shares; semi-joins and samples of bounded size."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

_local: list[str] = []
#: Bins of the histogram of hashes by which samples are drawn.
BINS = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, if executors are on this machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Stage:
    """A written table: ``df`` reads it, ``drop`` deletes it once nothing reads it any more.

    Tables that results still read are deleted when the driver's JVM ends.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/foliant/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        fs, path = self._files()
        fs.deleteOnExit(path)

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        fs, path = self._files()
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


def only_stage(df: DataFrame, name: str, *used: Stage) -> DataFrame:
    """``df`` written, and the tables dropped that it was made of."""
    out = Stage(df, name).df
    for x in used:
        x.drop()
    return out


def long_id(df: DataFrame, col: str) -> Column:
    """An id as a long.  Ids are integers; those of another type raise."""
    if not isinstance(df.schema[col].dataType, IntegralType):
        raise TypeError(f"{col} is {df.schema[col].dataType.simpleString()}; ids must be integers")
    return F.col(col).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(df: DataFrame, ids: DataFrame, on: str | list[str], most: int = 4_000_000, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``on`` (one long or a few) is in ``ids``: wide rows stay where they are while
    there are at most ``most`` ids, which are then broadcast; beyond that both sides are shuffled.
    ``how`` may also be ``left_anti``, or ``left`` for narrow columns of ``ids``."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, how)


def smallest(ids: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The distinct rows (``by``, a text; d) of the ``n`` smallest hashes of d (a long), of each ``by`` if given.

    A histogram of the hashes gives a threshold under which there are enough, so that neither a sort
    nor a group ever holds more than about n rows and a bin; a repeated id counts once.
    """
    keys = [by] if by else []
    place = F.xxhash64("d") / F.lit(2.0**64) + 0.5
    hashed = ids.select(*keys, "d", F.floor(place * BINS).alias("bin"))
    sizes = hashed.groupBy(*keys, "bin").agg(F.count("*").alias("rows")).toArrow().to_pandas()
    spark, found = ids.sparkSession, []
    want = {k: n for k in sizes[by].unique()} if by else {None: n}
    while want:
        cuts = {}
        for k, enough in want.items():
            own = (sizes[sizes[by] == k] if by else sizes).sort_values("bin")
            at = int(np.searchsorted(own["rows"].cumsum().to_numpy(), enough))
            cuts[k] = int(own["bin"].iloc[at]) if at < len(own) else BINS
        if by:
            limits = spark.createDataFrame(pa.table({by: pa.array(list(cuts), pa.string()), "cut": pa.array(list(cuts.values()), pa.int64())}))
            some = hashed.join(F.broadcast(limits), by).where("bin <= cut").select(by, "d")
        else:
            some = hashed.where(F.col("bin") <= cuts[None]).select("d")
        got = some.distinct().withColumn("h", F.xxhash64("d")).toArrow().to_pandas().sort_values(["h", "d"])
        again = {}
        for k, enough in want.items():
            own = got[got[by] == k] if by else got
            if len(own) < n and cuts[k] < BINS:  # repeated ids: look further
                again[k] = enough * 4
            else:
                found.append(own.head(n))
        want = again
    rows = [pa.Table.from_pandas(x[[*keys, "d"]], preserve_index=False) for x in found]
    schema = pa.schema([*((k, pa.string()) for k in keys), ("d", pa.int64())])
    return spark.createDataFrame(pa.concat_tables([t.cast(schema) for t in rows]) if rows else schema.empty_table())
