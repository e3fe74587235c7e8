"""One run: scan, unify, rank, write."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from foliant.operators import analytics, dedup
from foliant.sources import records as io


class DataProcessingError(RuntimeError):
    """A run that can't go on."""


@dataclass
class Result:
    status: str
    message: str
    stats: DataFrame | None = None
    unique: DataFrame | None = None
    unified_path: str | None = None
    duplicates_path: str | None = None
    process_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    started: datetime = field(default_factory=datetime.now)
    ended: datetime | None = None
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for x in self.held:
            x.unpersist()


def process(spark: SparkSession, frames: list[DataFrame], out: str | None = None, semantics: str = "compat", single: bool = True) -> Result:
    """Unify the records of several sources, and write unique and duplicate ones to CSV under ``out``.

    Keyed records, memberships and unique records are read several times, and persisted: ``Result.release``
    gives them up.  Failures of Spark or of files give the status FAILED, and mistakes in the call raise
    ``DataProcessingError``.
    """
    if semantics not in ("compat", "strict") or not frames:
        raise DataProcessingError("semantics is compat or strict, and there must be a source")
    result = Result("IN_PROGRESS", "")
    try:
        k = dedup.keyed(io.union_sources(frames)).persist()
        m = dedup.members(k, semantics).persist()
        u = dedup.unique(k, m, semantics).persist()
        result.held = [k, m, u]
        result.stats, result.unique = dedup.stats(k, m, u), u
        if out is not None and not k.isEmpty():
            os.makedirs(out, exist_ok=True)
            result.unified_path, result.duplicates_path = f"{out}/resultados_unificados.csv", f"{out}/resultados_duplicados.csv"
            io.write_csv(io.csv_rows(u.orderBy("ord")), result.unified_path, single)
            io.write_csv(io.csv_rows(m.orderBy("first", "kind", "ord")), result.duplicates_path, single)
            io.write_top_authors(analytics.top_authors(u), f"{out}/top_authors.csv", single)
        result.status, result.message = "COMPLETED", "done" if not k.isEmpty() else "no records"
    except (PySparkException, Py4JError, OSError) as e:
        result.status, result.message = "FAILED", f"Error: {e}"
    result.ended = datetime.now()
    return result
