"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: the signs of a vector (less the mean) under rotations learned by iterative quantisation on
at most ``train_rows`` vectors (of the smallest hash of the id); rotations from different starts
are stacked up to ``BITS`` bits.  The radius r is learned too: the exact neighbours of ``probes``
vectors among all others, by one pass, give the Hamming distance within which ``share`` of
neighbours lie.

Search: a code is split into substrings of ``SUB`` bits, each indexed.  Codes within r = m * s + a of
each other (m substrings) are within s in one of the first a + 1 substrings or within s - 1 in one
of the others, so probing these balls retrieves every code within r; retrieved codes are compared
in full, and those within r ranked by the cosine of the vectors.  Where the balls are so large
that probing would read every code at least once per query, the queries' codes are compared with
all codes instead, block by block: the same codes are retrieved, for less.

Queries are the vectors whose id is divisible by ``every``; all vectors are indexed and searched.
Queries with fewer than k codes within r are looked up again without a radius, so that each has its k.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import Stage, long_id, only_stage, smallest

BITS, SUB = 256, 16
PARTS = BITS // SUB
#: Codes, and queries, that one task compares with each other at most, on average.
BLOCK, QUERIES = 16_384, 8_192


def learn(x: np.ndarray, steps: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the projection to ``BITS`` columns whose signs are the code."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :BITS]
    z = z @ axes
    found = []
    while sum(r.shape[1] for r in found) < BITS:
        r = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
            r = vt.T @ u.T
        found.append(axes @ r)
    return mean, np.concatenate(found, axis=1)[:, :BITS]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of BITS / 64 words."""
    return np.packbits((x - mean) @ projection >= 0, axis=1).view(np.uint64)


def balls(r: int) -> list[int]:
    """The radius to probe in each substring; -1: none."""
    s, a = divmod(r, PARTS)
    return [s if j <= a else s - 1 for j in range(PARTS)]


def probing_reads(r: int) -> float:
    """How often probing reads each code, for one vector, on average over random codes."""
    return sum(sum(comb(SUB, i) for i in range(b + 1)) for b in balls(r)) / 2**SUB


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(v, e): usable vectors, one of each id, as packed floats of length 1 (or 0)."""
    t = table.select(long_id(table, id_col).alias("v"), F.col(vec_col).cast("array<double>").alias("e"))
    t = t.where("v is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity'))").groupBy("v").agg(F.min("e").alias("e"))
    common = t.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    t = t.where(F.size("e") == (common.n if common else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("e").to_pylist(), np.float64)
                x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["v", "e"])

    return t.mapInArrow(pack, "v long, e binary")


def matrix(col: pa.Array, kind) -> np.ndarray:
    parts = col.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def best(ids: np.ndarray, sims: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest similarities of each owner, ties by id."""
    order = np.lexsort((ids, -sims, owner))
    o = owner[order]
    start = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
    nth = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[nth < k]


PAIRS = "v long, n long, sim double, hamming int"


def pairs(v: np.ndarray, n: np.ndarray, sim: np.ndarray, hamming: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array(sim.astype(np.float64)), pa.array(hamming.astype(np.int32))], ["v", "n", "sim", "hamming"])


def top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "n")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _exact(qv: np.ndarray, q: np.ndarray, qc: np.ndarray, k: int):
    """Exact neighbours of the vectors q among those of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, x, c = b.column("v").to_numpy(), matrix(b.column("e"), np.float32), matrix(b.column("c"), np.uint64)
            sim = q @ x.T
            sim[qv[:, None] == v[None, :]] = -np.inf
            near = np.argpartition(-sim, min(k, len(v)) - 1, axis=1)[:, :k]
            owner, at = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            ok = np.isfinite(sim[owner, at])
            owner, at = owner[ok], at[ok]
            yield pairs(qv[owner], v[at], sim[owner, at], np.bitwise_count(qc[owner] ^ c[at]).sum(axis=1))

    return run


def _blocks(r: int, k: int):
    """Neighbours within r of the vectors of one block among those of another."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        t = t.combine_chunks().to_batches()[0]
        side = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
        v, x, c = t.column("v").to_numpy(), matrix(t.column("e"), np.float32), matrix(t.column("c"), np.uint64)
        qv, qx, qc, dv, dx, dc = v[side], x[side], c[side], v[~side], x[~side], np.ascontiguousarray(c[~side].T)
        for at in range(0, len(qv), 128):
            h = np.zeros((len(qv[at : at + 128]), len(dv)), np.uint16)
            for w in range(dc.shape[0]):
                h += np.bitwise_count(qc[at : at + 128, w, None] ^ dc[w][None, :])
            i, j = np.nonzero(h <= r)
            ok = qv[at + i] != dv[j]
            i, j = i[ok], j[ok]
            sim = np.concatenate([np.einsum("ij,ij->i", qx[at + i[s : s + 65536]], dx[j[s : s + 65536]]) for s in range(0, max(len(i), 1), 65536)])
            take = best(dv[j], sim, i, k)
            out.append(pairs(qv[at + i[take]], dv[j[take]], sim[take], h[i[take], j[take]]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([pairs(*(np.zeros(0, x) for x in (np.int64, np.int64, np.float64, np.int32)))])

    return run


def scan(coded: DataFrame, asking: DataFrame, n: int, queries: int, r: int, k: int) -> DataFrame:
    """The codes of ``asking`` compared with all, block by block; every row is copied once for each block of the other side."""
    rows, cols = -(-queries // QUERIES), max(8, -(-n // BLOCK))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = lambda blocks: F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    left = asking.select(own(rows).alias("i"), spread(cols).alias("j"), F.lit(True).alias("query"), "v", "e", "c")
    right = coded.select(spread(rows).alias("i"), own(cols).alias("j"), F.lit(False).alias("query"), "v", "e", "c")
    return left.union(right).groupBy("i", "j").applyInArrow(_blocks(r, k), PAIRS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        subs = matrix(b.column("c"), np.uint16)
        n = len(subs)
        yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(np.repeat(np.arange(n), PARTS))), pa.array(np.tile(np.arange(PARTS, dtype=np.int32), n)), pa.array(subs.astype(np.int32).ravel())], ["v", "j", "s"])


def _probe(r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {b: np.array([sum(1 << i for i in c) for z in range(b + 1) for c in combinations(range(SUB), z)], np.uint16) for b in set(balls(r))}
        for b in batches:
            subs = matrix(b.column("c"), np.uint16)
            for j, ball in enumerate(balls(r)):
                m = masks[ball]
                if len(m):
                    yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(np.repeat(np.arange(len(subs)), len(m)))), pa.array(np.full(len(subs) * len(m), j, np.int32)), pa.array((subs[:, j, None] ^ m).astype(np.int32).ravel())], ["q", "j", "s"])

    return run


def _rank(r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.bitwise_count(matrix(b.column("qc"), np.uint64) ^ matrix(b.column("c"), np.uint64)).sum(axis=1) if b.num_rows else np.zeros(0)
            b = b.filter(pa.array(h <= r))
            if b.num_rows:
                yield pairs(b.column("q").to_numpy(), b.column("v").to_numpy(), np.einsum("ij,ij->i", matrix(b.column("qe"), np.float32), matrix(b.column("e"), np.float32)), h[h <= r])

    return run


def probe(coded: DataFrame, asking: DataFrame, r: int) -> DataFrame:
    """The indexes joined with the probes."""
    index, probes = coded.select("v", "c").mapInArrow(_index, "v long, j int, s int"), asking.select("v", "c").mapInArrow(_probe(r), "q long, j int, s int")
    met = probes.join(index, ["j", "s"]).where("q != v").select("q", "v").distinct()
    asked = asking.select(F.col("v").alias("q"), F.col("e").alias("qe"), F.col("c").alias("qc"))
    return met.join(coded, "v").join(asked, "q").select("q", "v", "qe", "qc", "e", "c").mapInArrow(_rank(r), PAIRS)


def neighbours(
    table: DataFrame, k: int = 10, every: int = 20, share: float = 0.99, train_rows: int = 10_000, probes: int = 256, radius: int | None = None, plan: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, similarity (cosine), hamming; k rows per query, all others where there are fewer.

    Queries are the rows whose id is divisible by ``every`` (1: all).  Ties rank by the smaller id.
    Rows without an id or a vector, with null, NaN or infinite elements, or of another length than
    most, are left out; of rows that share an id the smallest vector counts.  A vector of
    zeros has similarity 0 to all.  ``plan`` forces "probe" or "scan"; a ``radius`` that is given is
    kept, and queries have fewer rows where fewer codes are within it.
    Other columns are ignored; empty tables give no rows.
    """
    base = Stage(vectors(table, id_col, vec_col), "vectors")
    n = base.df.count()
    queries = base.df.where(F.col("v") % every == 0).count()
    if n < 2 or not queries:
        base.drop()
        return table.sparkSession.createDataFrame([], "vec_id long, rank int, neighbour_id long, similarity double, hamming int")
    ids = smallest(base.df.select(F.col("v").alias("d")), train_rows)
    sample = base.df.join(F.broadcast(ids), base.df.v == ids.d).select("v", "e", F.xxhash64("v").alias("h")).toArrow().sort_by([("h", "ascending"), ("v", "ascending")])  # at most `train_rows`
    x = matrix(sample["e"].combine_chunks(), np.float32).astype(np.float64)
    mean, projection = learn(x)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = codes(matrix(b.column("e"), np.float32), mean, projection)
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("e"), pa.array([r.tobytes() for r in c], pa.binary())], ["v", "e", "c"])

    coded = Stage(base.df.mapInArrow(code, "v long, e binary, c binary"), "codes")
    base.drop()
    fill = radius is None
    if radius is None:
        first = sample.slice(0, probes)
        qv, q = first["v"].to_numpy(), matrix(first["e"].combine_chunks(), np.float32)
        near = top(coded.df.mapInArrow(_exact(qv, q, codes(q, mean, projection), k), PAIRS), k).select("hamming").toArrow()["hamming"].to_numpy()
        radius = int(np.quantile(near, share, method="higher"))
    plan = plan or ("scan" if probing_reads(radius) >= 1 else "probe")
    asking = coded.df.where(F.col("v") % every == 0)
    found = Stage(top(scan(coded.df, asking, n, queries, radius, k) if plan == "scan" else probe(coded.df, asking, radius), k), "found")
    out, used = found.df, [found, coded]
    if fill:
        full = found.df.groupBy("v").agg(F.count("*").alias("m")).where(F.col("m") >= min(k, n - 1)).select("v")
        short = Stage(asking.join(full, "v", "left_anti"), "short")
        used.append(short)
        if left := short.df.count():
            more = top(scan(coded.df, short.df, n, left, BITS, k), k)
            out = found.df.join(short.df.select("v"), "v", "left_anti").unionByName(more)
    out = out.select(F.col("v").alias("vec_id"), "rank", F.col("n").alias("neighbour_id"), F.col("sim").alias("similarity"), "hamming")
    return only_stage(out, "neighbours", *used)
