"""The same projections over streams of CSV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.operators.analytics import author_counts
from foliant.sources.records import CSV, parse_csv_rows


def stream_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the CSV files that arrive in a folder (13 columns, in order)."""
    raw = spark.readStream.schema(", ".join(f"`{h}` string" for _, h in CSV)).csv(folder, header=True, multiLine=True, quote='"', escape='"')
    return parse_csv_rows(raw.withColumn("ord", F.lit(None).cast("long")))


def running_author_counts(records: DataFrame) -> DataFrame:
    """Author counts over a stream, for the update or complete output mode."""
    return author_counts(records)
