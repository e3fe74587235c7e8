"""Language identification as a mixture: proportions by EM, the set by penalised likelihood.

A language's model is a table of byte-trigram probabilities (of lower-case words, with their
ends), hashed to ``BUCKETS``, fitted to at most ``train_rows`` labelled documents of each language
(those of the smallest hash of the id).  A word's likelihood in a language is the product of its
trigrams', with a share ``NOISE`` of the mean over all languages, so that no single word decides.

A document's words are drawn from a mixture of languages.  EM estimates the proportions; the set
S of languages maximises  log-likelihood - penalty * log(1 + words) * (|S| - 1).  As more languages
never fit worse, a document whose best language is within one penalty of the mixture of all has
that one alone; for the others the least proportion is dropped again and again, and the best set
on the way is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import long_id, smallest
from .textkit import Words, pieces, ragged, reduce_sum

BUCKETS = 1 << 16
NOISE = 0.05
STEPS = 20


def trigrams(w: Words) -> np.ndarray:
    """The bucket of the trigram around each byte of each word, word after word."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    at = np.repeat(w.start, w.size) + ragged(w.size)
    cur = w.data[at].astype(np.uint32)
    first = ragged(w.size) == 0
    last = np.append(first[1:], True)
    before = np.where(first, 32, np.append(np.uint32(32), cur[:-1])).astype(np.uint32)
    after = np.where(last, 32, np.append(cur[1:], np.uint32(32))).astype(np.uint32)
    code = (before << np.uint32(16)) | (cur << np.uint32(8)) | after
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for b in pieces(batches):
        w = Words(b.column("text"))
        tri = trigrams(w)
        ends = np.concatenate([[0], np.cumsum(w.size)])[w.off]
        for r, lang in enumerate(b.column("lang").to_pylist()):
            n = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            n += np.bincount(tri[ends[r] : ends[r + 1]], minlength=BUCKETS)
    for lang, n in seen.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "bucket", "n"])


def train(docs: DataFrame, train_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities: a row per bucket, a column per language."""
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("d is not null and lang is not null and length(text) > 0")
    ids = smallest(d.select("lang", "d"), train_rows, "lang")
    # One text of an id and language, however often they come; ids: at most `train_rows` for each language.
    some = d.join(F.broadcast(ids), ["lang", "d"]).groupBy("lang", "d").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = some.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    n = np.zeros((BUCKETS, len(langs)))
    if langs:
        n[rows["bucket"].to_numpy(), [langs.index(x) for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    return langs, np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)


def em(p: np.ndarray, off: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each segment's mixture of its allowed languages, and its log-likelihood."""
    n = np.maximum(np.diff(off), 1)[:, None]
    seg = np.repeat(np.arange(len(off) - 1), np.diff(off))
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(steps):
        r = p * share[seg].astype(p.dtype)
        r /= r.sum(axis=1, keepdims=True)
        share = reduce_sum(r, off).astype(np.float64) / n
    return share, reduce_sum(np.log((p * share[seg].astype(p.dtype)).sum(axis=1)).astype(np.float64), off)


def identify(ll: np.ndarray, off: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of the languages chosen for each segment of words, from words' log-likelihoods."""
    docs, k = len(off) - 1, ll.shape[1]
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    p = (1 - NOISE) * p + NOISE * p.mean(axis=1, keepdims=True)
    size = np.diff(off)
    single = reduce_sum(np.log(p).astype(np.float64), off)
    best = single.argmax(axis=1)
    value = single[np.arange(docs), best]
    cost = penalty * np.log1p(size)
    out = np.zeros((docs, k))
    out[np.arange(docs), best] = size > 0
    if k < 2:
        return out
    share, full = em(p, off, np.ones((docs, k)))
    # 1: for EM that stops short of its maximum.
    left = np.flatnonzero((full + 1 > value + cost) & (size > 0))
    if not len(left):
        return out
    take = np.repeat(off[:-1][left], size[left]) + ragged(size[left])
    p, sub = p[take], np.concatenate([[0], np.cumsum(size[left])])
    share, high, allowed = share[left], value[left], np.ones((len(left), k))
    for count in range(k, 1, -1):
        if count < k:
            least = np.where(allowed > 0, share, np.inf).argmin(axis=1)
            allowed[np.arange(len(left)), least] = 0
            share, full = em(p, sub, allowed, 2 * STEPS)
        else:
            share, full = em(p, sub, allowed, 2 * STEPS)
        better = full - cost[left] * (count - 1) > high
        high = np.where(better, full - cost[left] * (count - 1), high)
        out[left[better]] = share[better]
    return out


def _identify(langs: list[str], table: np.ndarray, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            tri = trigrams(w)
            ll = reduce_sum(table[tri], np.concatenate([[0], np.cumsum(w.size)])) if len(langs) else np.zeros((len(w.hash), 0), np.float32)
            shares = identify(ll, w.off, penalty) if len(langs) else np.zeros((b.num_rows, 0))
            found, parts = [], []
            for s in shares:
                order = sorted(np.flatnonzero(s > 0), key=lambda i: (-s[i], i))
                found.append([langs[i] for i in order])
                parts.append([float(s[i]) for i in order])
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array([x[0] if x else None for x in found], pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(np.diff(w.off))], ["doc_id", "lang", "langs", "shares", "n_words"])

    return run


def language_mixtures(docs: DataFrame, penalty: float = 3.0, train_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang (of the largest share), langs and their shares (largest first), n_words; a row per row.

    Texts without a word (null, empty) have no language: null, and empty lists.  Rows without an
    id, a language or a text aren't trained on, but are identified.  Without any labelled row no
    text has a language.  Of an id's texts of one language one is trained on.  Languages of equal
    shares come in the order of their names, as the best of equal single ones does.  Repeated rows
    each give a row; other columns are ignored.
    """
    langs, table = train(docs, train_rows, id_col, text_col, lang_col)
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"))
    return d.mapInArrow(_identify(langs, table, penalty), "doc_id long, lang string, langs array<string>, shares array<double>, n_words long")
