"""Sparse binary features of documents: hashed words and beginnings of words, binned structure statistics, metadata.

Word buckets are chosen from a labelled sample by the chi-squared statistic (``Selection``); every
metadata value of the sample is a feature; statistics are cut at the sample's quantiles.
Everything is then linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import long_id, smallest
from .textkit import Lookup, Words, filled, list_array, pieces, ragged, raw, signed

BUCKETS = np.uint64((1 << 24) - 1)
BINS = 8
CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*@^~+=<>{}[]\\/_`", "\n", " \t\r"), 1):
    CLASS[list(_chars.encode())] = _k
CLASS[128:] = 9
N_STATS = 9 + 5
PREFIXES = (4, 7)


def stats(text: pa.Array, w: Words) -> np.ndarray:
    """Structure statistics of each text, N_STATS columns: shares of kinds of bytes, sizes, repetition."""
    data, off = raw(filled(text))
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 10 + CLASS[data], minlength=n * 10).reshape(n, 10).astype(np.float64)
    words = np.diff(w.off)
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((w.hash, owner)) if len(owner) else owner
    h = w.hash[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(owner[new], minlength=n)
    letters = np.bincount(owner, w.size, minlength=n) if len(owner) else np.zeros(n)
    return np.column_stack([
        kinds[:, 1:] / np.maximum(size, 1)[:, None],
        np.log2(size + 1), np.log2(words + 1), letters / np.maximum(words, 1),
        distinct / np.maximum(words, 1), words / (kinds[:, 7] + 1),
    ])


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, and of the beginnings of long words."""
    owner = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    parts = [(w.hash, owner)] + [(h, owner[at]) for h, at in map(w.prefix, PREFIXES)]
    return np.concatenate([o for _, o in parts]), np.concatenate([h & BUCKETS for h, _ in parts])


def meta(batch: pa.RecordBatch, cols: list[str]) -> list[list[str]]:
    return [[f"{c}={v}" for v in batch.column(c).to_pylist()] for c in cols]


def raw_features(cols: list[str], keep: list[str]):
    """Of each row: ``keep``, its distinct word buckets, its metadata values and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            owner, bucket = buckets(w)
            pair = np.unique((owner.astype(np.uint64) << np.uint64(24)) | bucket)
            off = np.searchsorted(pair >> np.uint64(24), np.arange(b.num_rows + 1, dtype=np.uint64))
            s = stats(b.column("text"), w)
            values = list(zip(*meta(b, cols), strict=True)) if cols else [()] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), list_array((pair & BUCKETS).astype(np.int32), off, pa.int32()), pa.array(values, pa.list_(pa.string())), list_array(s.ravel(), np.arange(len(s) + 1) * N_STATS, pa.float64())],
                [*keep, "words", "meta", "stats"],
            )

    return run


@dataclass(frozen=True)
class Selection:
    """Word buckets to fit to: at most ``most``, of ``least_rows`` labelled rows and a chi-squared of ``least_chi2``, the largest first."""

    most: int = 4096
    least_chi2: float = 12.0
    least_rows: int = 3


class Rows:
    """Sparse 0/1 rows of ``size`` columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, size: int) -> None:
        order = np.argsort(rows, kind="stable")
        self.off, self.cols, self.size = np.searchsorted(rows[order], np.arange(n + 1)), cols[order], size

    def __len__(self) -> int:
        return len(self.off) - 1

    def dense(self, at: np.ndarray) -> np.ndarray:
        count = np.diff(self.off)[at]
        x = np.zeros((len(at), self.size))
        x[np.repeat(np.arange(len(at)), count), self.cols[np.repeat(self.off[:-1][at], count) + ragged(count)]] = 1
        return x


@dataclass
class Features:
    """What was chosen: word buckets, metadata values and the cuts of the statistics, in this order of columns."""

    words: np.ndarray
    meta: list[str]
    cuts: np.ndarray
    cols: list[str]

    @property
    def size(self) -> int:
        return len(self.words) + len(self.meta) + N_STATS * BINS

    def binned(self, s: np.ndarray) -> np.ndarray:
        """Column numbers of each row's bins."""
        base = len(self.words) + len(self.meta)
        return np.stack([base + j * BINS + np.searchsorted(self.cuts[j], s[:, j], side="right") for j in range(N_STATS)], axis=1)

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Words]:
        """(row, column) of each feature of a batch, sorted by row, and the texts' words."""
        w = Words(b.column("text"))
        look = Lookup(self.words)
        owner, bucket = buckets(w)
        at, place = look.find(bucket)
        pair = np.unique(owner[at] * self.size + place)
        binned = self.binned(stats(b.column("text"), w))
        known = {v: len(self.words) + k for k, v in enumerate(self.meta)}
        more = [(r, known[v]) for vs in meta(b, self.cols) for r, v in enumerate(vs) if v in known]
        rows = np.concatenate([pair // self.size, np.repeat(np.arange(b.num_rows), N_STATS), np.array([r for r, _ in more], np.int64)])
        cols = np.concatenate([pair % self.size, binned.ravel(), np.array([c for _, c in more], np.int64)])
        order = np.argsort(rows, kind="stable")
        return rows[order], cols[order], w


def labelled(docs: DataFrame, labels: DataFrame, rows: int, cols: list[str], id_col: str, text_col: str, label_cols: list[str]) -> pa.Table:
    """Raw features of the documents of at most ``rows`` labelled ids, the smallest by a hash of the id; with ``label_cols``.

    Of several labels of one id, the largest of each column; of several documents of one id, the
    one of the smallest hash of the text.
    """
    lab = labels.select(long_id(labels, id_col).alias("d"), *(F.col(c).cast("int").alias(f"y_{c}") for c in label_cols)).dropna()
    lab = lab.groupBy("d").agg(*(F.max(f"y_{c}").alias(f"y_{c}") for c in label_cols))
    ids = smallest(lab.select("d").join(docs.select(long_id(docs, id_col).alias("d")), "d", "left_semi"), rows)
    lab = lab.join(F.broadcast(ids), "d")  # ids: at most `rows`
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(c) for c in cols))
    d = d.join(F.broadcast(ids), "d").groupBy("d").agg(F.min_by(F.struct(*(F.col(c) for c in d.columns if c != "d")), F.xxhash64("text")).alias("x")).select("d", "x.*")
    keep = ["d", *(f"y_{c}" for c in label_cols)]
    schema = "d long, " + "".join(f"y_{c} int, " for c in label_cols) + "words array<int>, meta array<string>, stats array<double>"
    return d.join(F.broadcast(lab), "d").mapInArrow(raw_features(cols, keep), schema).toArrow().sort_by("d")


def choose(table: pa.Table, y: np.ndarray, cols: list[str], selection: Selection) -> tuple[Features, Rows]:
    """Features chosen for classes y (0, 1, ...), and the sample's rows of them."""
    n, classes = len(y), int(y.max(initial=0)) + 1
    words = table["words"].combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = words.chunk(0)
    off, flat = words.offsets.to_numpy().astype(np.int64), words.values.to_numpy(zero_copy_only=False)
    off = off - off[0]
    owner = np.repeat(np.arange(n), np.diff(off))
    kinds, place = np.unique(flat[: off[-1]], return_inverse=True)
    table_ = np.bincount(place * classes + y[owner], minlength=len(kinds) * classes).reshape(-1, classes).astype(np.float64)
    df, share = table_.sum(axis=1), np.bincount(y, minlength=classes) / max(1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = ((table_ - df[:, None] * share) ** 2 / (df[:, None] * share)).sum(axis=1)
        chi2 = np.nan_to_num(inside * n / np.maximum(n - df, 1e-9))
    some = np.flatnonzero((df >= selection.least_rows) & (chi2 >= selection.least_chi2))
    some = np.sort(some[np.lexsort((some, -chi2[some]))][: selection.most])
    metas = table["meta"].to_pylist()
    values = sorted({v for r in metas for v in r})
    s = np.array(table["stats"].to_pylist(), np.float64).reshape(n, N_STATS)
    cuts = np.quantile(s, np.arange(1, BINS) / BINS, axis=0).T if n else np.zeros((N_STATS, BINS - 1))
    f = Features(kinds[some].astype(np.uint64), values, cuts, cols)
    column = np.full(len(kinds), -1)
    column[some] = np.arange(len(some))
    ok = column[place] >= 0
    known = {v: len(f.words) + k for k, v in enumerate(values)}
    pairs = [(r, known[v]) for r, vs in enumerate(metas) for v in dict.fromkeys(vs)]
    more = np.array(pairs, np.int64).reshape(-1, 2)
    rows = np.concatenate([owner[ok], more[:, 0], np.repeat(np.arange(n), N_STATS)])
    return f, Rows(rows, np.concatenate([column[place][ok], more[:, 1], f.binned(s).ravel()]), n, f.size)
