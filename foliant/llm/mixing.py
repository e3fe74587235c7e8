"""Mixing sources to target weights by soft membership.

A softmax classifier, fitted to at most ``train_rows`` rows of the labelled table, gives each
document's posteriors p over the domains (clean, low quality, toxic).  Rates r >= 0 of the
documents then bring the expected token totals of the domains to their targets:

    minimise  |sum_i t_i r_i p_i / S - budget * target|^2 / 2 + ridge / 2 * sum_i t_i / S (r_i - 1)^2

with t_i the document's tokens (words) and S their sum.  It is solved by projected gradients in the
metric of t_i / S: the gradient at document i is p_i . e + ridge * (r_i - 1), where e are the domains'
residuals, so that all steps together move a rate from 1 along p_i by a vector m of K numbers, and
r_i = max(0, 1 + p_i . m), projected whenever it is read (lazily).  A step is preconditioned by the
K x K Gram matrix of the documents whose rate isn't 0, and halved while it doesn't descend.  Each step
is one distributed sum of JVM expressions over all documents; executors keep no state, and a lost one
is no matter.  The ridge starts at ``RIDGES[0]`` and is lowered until every domain is within a tenth of
``MISS`` of its target, or for as long as that halves the miss: where targets can't be met, the rates of
the larger ridge stand, which are nearer to 1.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .features import Features, Rows, Selection, choose, labelled
from .store import Stage, fresh, long_id, only
from .textkit import pieces, reduce_sum

DOMAINS = ("clean", "low", "toxic")
#: Share of a domain's target that its total may miss before a warning.
MISS = 0.01
RIDGES = tuple(10.0**-x for x in range(3, 9))


def fit(x: Rows, y: np.ndarray, classes: int, epochs: int = 20, l2: float = 2e-4, seed: int = 11) -> np.ndarray:
    """Weights (feature, class) of a softmax regression over 0/1 rows, the last row the intercepts; by Adam."""
    rng = np.random.default_rng(seed)
    n, size = len(x), x.size
    p = np.zeros((size + 1, classes))
    p[-1] = np.log(np.bincount(y, minlength=classes) + 1)
    m, s, t = np.zeros_like(p), np.zeros_like(p), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.03 * (1 - epoch / epochs) + 0.001
        for at in range(0, n, 256):
            b = order[at : at + 256]
            xb = np.column_stack([x.dense(b), np.ones(len(b))])
            z = xb @ p
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(b)), y[b]] -= 1
            g = xb.T @ z / len(b) + l2 * p
            g[-1] -= l2 * p[-1]
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return p


def _posteriors(f: Features, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        for b in pieces(batches):
            rows, cols, w = f.of(b)
            z = reduce_sum(weights[cols], np.searchsorted(rows, np.arange(b.num_rows + 1))) + weights[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(np.diff(w.off)), *(pa.array(np.ascontiguousarray(p[:, j])) for j in range(k))], ["d", "t", *(f"p{j}" for j in range(k))])

    return run


def rate_of(p: list[Column], m: np.ndarray) -> Column:
    """The projected rate of posteriors p after steps that add up to m."""
    z = F.lit(1.0)
    for c, x in zip(p, m, strict=True):
        z = z + c * F.lit(float(x))
    return F.greatest(F.lit(0.0), z)


def sums(table: DataFrame, p: list[Column], m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """All tokens S; the domains' totals at the rates of m, the Gram matrix of the rows of a rate over 0, and the rates' squares, over S."""
    k, t, r = len(p), F.col("t"), rate_of(p, m)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    found = table.agg(F.sum(t), F.sum(t * r * r), *(F.sum(t * r * c) for c in p), *(F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in upper)).first()
    x = np.array([v or 0 for v in found], np.float64)
    x[1:] /= x[0] or 1
    gram = np.zeros((k, k))
    for (i, j), v in zip(upper, x[2 + k :], strict=True):
        gram[i, j] = gram[j, i] = v
    return x[0], x[2 : 2 + k], gram, x[1]


def solve(table: DataFrame, k: int, target: np.ndarray, budget: float | None, ridge: float, steps: int, tolerance: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vector m, how far the domains' totals are from their targets, and these, over a table of (t, p0, p1, ...)."""
    p = [F.col(f"p{j}") for j in range(k)]
    m, step, size, last = np.zeros(k) if start is None else start, np.zeros(k), 1.0, None
    goal, best, residual = target * (budget or 1), m, np.zeros(k)
    if budget is None:
        goal = target * (sums(table, p, np.zeros(k))[1][0] / target[0])
    for _ in range(steps):
        total, at, gram, squares = sums(table, p, m)
        if not total:
            return np.zeros(k), np.zeros(k), goal
        value = squares / 2 - goal @ m + ridge / 2 * m @ m
        slope = at - goal + ridge * m
        if last is not None and value > last[0] + 1e-4 * size * (last[1] @ step) + 1e-15 and size > 1e-6:  # no descent
            size /= 2
            m = last[2] + size * step
            continue
        residual, best = at - goal, m
        if (np.abs(slope) <= tolerance * np.maximum(goal, 1e-9)).all():
            break
        step, size, last = -np.linalg.solve(gram + ridge * np.eye(k), slope), 1.0, (value, slope, m)
        m = m + step
    return best, residual, goal


def anneal(table: DataFrame, k: int, target: np.ndarray, budget: float | None, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``solve`` with the largest ridge that meets the targets or that lower ones don't improve on."""
    best, miss = None, np.inf
    for ridge in RIDGES:
        found = solve(table, k, target, budget, ridge, steps, tolerance, best[0] if best else None)
        now = (np.abs(found[1]) / np.maximum(found[2], 1e-12)).max()
        if now > miss / 2:
            break
        best, miss = found, now
        if miss <= MISS / 10:
            break
    return best


def rates(
    docs: DataFrame, labels: DataFrame, target: tuple[float, ...] = (0.9, 0.08, 0.02), budget: float | None = 1.0, ridge: float | None = None, steps: int = 60, tolerance: float = 1e-4,
    train_rows: int = 8000, meta_cols: tuple[str, ...] = ("lang", "source"), selection: Selection = Selection(), train_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, p_clean, p_low, p_toxic, rate; a row per document row.

    ``target``: the domains' shares of ``budget`` times all tokens; without a budget, of as many tokens as
    leave the first domain's total what it is.  A ``ridge`` that is given is kept.  A domain whose total misses its target by more
    than ``MISS`` of it, since no rates reach it or for want of ``steps``, is warned of; ``totals`` tells how far.
    ``train_docs``: the documents of the labels, if they aren't ``docs``.  Toxic rows are of the
    toxic domain, whatever their quality.  Null and empty texts have no tokens, and a rate like others of
    their posteriors; null doc_ids and repeated rows each give a row, equal rows equal rates.  Without
    labels every document is clean for sure.  Where there are no tokens at all rates are 1.
    Other columns are ignored.
    """
    cols = [c for c in meta_cols if c in docs.columns and c in (train_docs or docs).columns]
    sample = labelled(train_docs or docs, labels, train_rows, cols, id_col, text_col, ["quality", "toxic"])
    toxic, low = sample["y_toxic"].to_numpy() == 1, sample["y_quality"].to_numpy() == 0
    y = np.where(toxic, 2, np.where(low, 1, 0)).astype(np.int64)
    f, x = choose(sample, y, cols, selection)
    k = len(DOMAINS)
    weights = fit(x, y, k) if len(y) else np.vstack([np.zeros((f.size, k)), [50.0, 0, 0]])
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(c) for c in cols))
    names = [f"p{j}" for j in range(k)]
    post = Stage(d.mapInArrow(_posteriors(f, weights), "d long, t long, " + ", ".join(f"{c} double" for c in names)), "posteriors").df
    goal = np.array(target) / sum(target)
    m, residual, goal = solve(post, k, goal, budget, ridge, steps, tolerance) if ridge else anneal(post, k, goal, budget, steps, tolerance)
    missed = [n for n, e, g in zip(DOMAINS, residual, goal, strict=True) if abs(e) > MISS * g]
    if missed:
        warnings.warn(f"the targets of {', '.join(missed)} aren't reached: off by {residual.tolist()} of all tokens", stacklevel=2)
    return post.select(F.col("d").alias("doc_id"), F.col("t").alias("n_tokens"), *(F.col(c).alias(f"p_{x}") for c, x in zip(names, DOMAINS, strict=True)), rate_of([F.col(c) for c in names], m).alias("rate"))


def totals(rated: DataFrame) -> DataFrame:
    """domain, total (expected tokens at the rates), share (of all domains); a row per domain."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("domain"), F.col(f"p_{x}").alias("p")) for x in DOMAINS)))
    t = rated.select("n_tokens", "rate", each.alias("e")).groupBy("e.domain").agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("e.p")).alias("total"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("total").alias("all")))).select("domain", "total", (F.col("total") / F.nullif("all", F.lit(0.0))).alias("share"))  # a row per domain


def resampled(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, each as many times as its rate says: the rate's floor, and one more where its
    fraction exceeds a hash of the id.  Documents that share an id take the largest of their numbers;
    rows without an id stay once.  Only ids whose number isn't 1 are joined."""
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    number, nth = fresh(docs, "times"), fresh(docs, "nth")
    times = rated.where("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate")).select(F.col("doc_id").alias(id_col), F.floor(F.col("rate") + u).cast("int").alias(number))
    other = Stage(times.where(F.col(number) != 1), "times").df
    joined = only(docs, other, id_col, how="left").withColumn(number, F.coalesce(number, F.lit(1))).where(F.col(number) > 0)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), number))).select(*docs.columns)
