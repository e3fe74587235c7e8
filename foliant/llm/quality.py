"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; pairs are summed in linear time as
half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.  A document is *bad* if it is labelled of low
quality or toxic.  The machine is fitted in the driver to at most ``train_rows`` labelled
documents (those of the smallest hash of the id), by Adam on the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import Features, Rows, Selection, choose, labelled
from .store import fresh, long_id
from .textkit import pieces, reduce_sum


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    features: Features

    def logit(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows from their sorted (row, column) features."""
        off = np.searchsorted(rows, np.arange(n + 1))
        linear = reduce_sum(self.w[cols], off)
        each = self.v[cols]
        pairs = reduce_sum(each, off) ** 2 - reduce_sum(each * each, off)
        return self.w0 + linear + 0.5 * pairs.sum(axis=1)


def fit(x: Rows, y: np.ndarray, f: Features, rank: int = 8, epochs: int = 25, l2: float = 2e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    n, size = len(x), x.size
    bad = y.mean() if n else 0.5
    p = [np.array([np.log((bad + 1e-3) / (1 - bad + 1e-3))]), np.zeros(size), rng.normal(0, 0.01, (size, rank))]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.03 * (1 - epoch / epochs) + 0.001
        for at in range(0, n, 256):
            b = order[at : at + 256]
            xb = x.dense(b)
            xv = xb @ p[2]
            z = p[0][0] + xb @ p[1] + 0.5 * (xv**2 - xb @ (p[2] ** 2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[b]) / len(b)
            xg = xb.T @ g
            grad = [np.array([g.sum()]), xg + l2 * p[1], xb.T @ (g[:, None] * xv) - xg[:, None] * p[2] + 5 * l2 * p[2]]
            t += 1
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32), f)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, meta_cols: tuple[str, ...] = ("lang", "source"), selection: Selection = Selection(), id_col: str = "doc_id", text_col: str = "text") -> Machine:
    cols = [c for c in meta_cols if c in docs.columns]
    table = labelled(docs, labels, train_rows, cols, id_col, text_col, ["quality", "toxic"])
    y = ((table["y_quality"].to_numpy() == 0) | (table["y_toxic"].to_numpy() == 1)).astype(np.int64)
    f, x = choose(table, y, cols, selection)
    return fit(x, y, f)


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, cols, _ = machine.features.of(b)
            z = machine.logit(rows, cols, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40))))], ["d", "bad"])

    return run


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(c) for c in machine.features.cols))
    return d.mapInArrow(_score(machine), "d long, bad double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 12_000, selection: Selection = Selection(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (of being bad), kept (score < threshold); a row per document row.

    Null and empty texts, null metadata and null doc_ids are scored like others, by what features they
    have; labels without an id or a label are passed over, and of several labels of an id the
    largest quality and the largest toxicity count; of several documents of a labelled id the machine is
    fitted to one.  A score of just ``threshold`` is rejected; equal rows have equal scores.  Without any label
    every score is 0.5 and every document is kept.  Other columns are ignored; empty tables give no rows.
    """
    machine = train(docs, labels, train_rows, selection=selection, id_col=id_col, text_col=text_col)
    known = F.lit(bool(np.any(machine.w)))
    return scores(docs, machine, id_col, text_col).select(F.col("d").alias("doc_id"), F.col("bad").alias("score"), ((F.col("bad") < threshold) | ~known).alias("kept"))


def _passing(machine: Machine, threshold: float, text_col: str, meta: list[str], out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            view = pa.RecordBatch.from_arrays([b.column(text_col), *(b.column(c) for c in meta)], ["text", *machine.features.cols])
            rows, cols, _ = machine.features.of(view)
            z = machine.logit(rows, cols, b.num_rows).astype(np.float64)
            yield b.select(out).filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold))

    return run


def passing(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 12_000, selection: Selection = Selection(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``classify`` keeps; made in one pass over them, without a join."""
    machine = train(docs, labels, train_rows, selection=selection, id_col=id_col, text_col=text_col)
    if not np.any(machine.w):
        return docs
    meta = [fresh(docs, f"{c}_text") for c in machine.features.cols]
    wide = docs.select("*", *(F.col(c).cast("string").alias(m) for c, m in zip(machine.features.cols, meta, strict=True)))
    return wide.mapInArrow(_passing(machine, threshold, text_col, meta, docs.columns), docs.schema)
