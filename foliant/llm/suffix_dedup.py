"""Repeated passages by suffix arrays, one suffix bucket at a time.

Tokens are what stands between white space (characters from U+3000 on are tokens of their own).
The suffixes that matter are those with at least ``L`` = ``min_tokens`` tokens left; two of them
belong together if they share their first L tokens.

Buckets: the smallest hash among a suffix's first L - GRAM + 1 runs of GRAM tokens (the rightmost
of equals) is its anchor.  Equal L-token prefixes have the same anchor at the same place, so the
anchor is the bucket; an anchor that occurs once in the corpus has nothing to sort, and neither its
suffixes nor its text are ever moved.  Suffixes of one occurrence of an anchor are neighbours, and
travel as one short segment of text.  Segments of the same content collapse to the first.

Within a bucket the suffixes are sorted by their first V tokens (ranks by prefix doubling), and
longer ties by the ranks of a sample: positions whose residues modulo V are in a difference cover,
so that any two suffixes reach sampled ones after the same number of tokens, less than V.
Anchors lie at residue 0, so for all but periodic texts that number is common to a whole tie.
Memory is bounded by the distinct segments of one bucket.  Neighbours of the order that share L
tokens form the groups; of each group the first occurrence, by (doc_id, place), stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import Stage, long_id, only, only_stage
from .textkit import SPACED, Words, mix, pieces, ragged, reduce_sum, shingles, signed

GRAM = 8
V = 16
COVER = np.array([0, 1, 2, 5, 8])  # every difference modulo 16
#: By residues of two suffixes: after how many tokens both are at sampled positions.
DELTA = np.array([[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)])
#: Rows held before complete buckets are sorted.
BLOCK_ROWS = 12_000


def tokens(arr: pa.Array) -> Words:
    return Words(arr, SPACED, lower=False)


def window_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the rightmost of equals."""
    at, span = np.arange(len(g)), 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(g[right] <= g[left], right, left)
        span *= 2
    left, right = at[: len(g) - width + 1], at[width - span :]
    return np.where(g[right] <= g[left], right, left)


def anchors_of(hashes: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, text, place, first suffix, number of suffixes) of every anchor, places and suffixes counted within the text."""
    n = np.diff(off)
    none = np.zeros(0, np.int64)
    if not (n >= length).any():
        return none.astype(np.uint64), none, none, none, none
    # Runs of GRAM tokens at every token; those that cross a text's end belong to no valid suffix.
    ext = np.concatenate([hashes, np.zeros(GRAM, np.uint64)])
    g, _ = shingles(ext, np.array([0, len(ext)]), GRAM)
    sel = window_minima(g[: len(hashes)], length - GRAM + 1)
    count = np.maximum(n - length + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    p = ragged(count)
    a = sel[off[:-1][text] + p]
    new = np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    return g[a[first]], text[first], a[first] - off[:-1][text[first]], p[first], np.diff(np.append(first, len(a)))


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = tokens(b.column("text"))
            g, text, a, lo, n = anchors_of(w.hash, w.off, length)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(signed(g)), b.column("d").take(row), b.column("t").take(row), *(pa.array(x.astype(np.int32)) for x in (a, lo, n))], ["g", "d", "t", "a", "lo", "n"])

    return run


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = tokens(b.column("text"))
            hits = b.column("hits")
            row = np.repeat(np.arange(b.num_rows), hits.value_lengths().to_numpy())
            flat = hits.flatten()
            g, a, lo, n = (flat.field(k).to_numpy() for k in ("g", "a", "lo", "n"))
            size = n.astype(np.int64) + length - 1
            off = np.concatenate([[0], np.cumsum(size)])
            pos = ragged(size)
            x = w.hash[np.repeat(w.off[:-1][row] + lo, size) + pos]
            s = mix(reduce_sum(x * mix(pos.astype(np.uint64) + np.uint64(7)), off) + mix((a - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)))
            seg = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off * 8), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(signed(s)), b.column("d").take(at), b.column("t").take(at), pa.array(lo), pa.array(n), pa.array(a - lo), seg], ["g", "s", "d", "t", "lo", "n", "rel", "seg"])

    return run


def dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def suffix_order(text: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by (bucket, text from there on), and the ranks of all
    positions by their first V tokens.  ``text`` holds ranks of tokens, 0 for padding, with 4 * V of padding at its end."""
    rank, step = text, 1
    shifted = lambda r, k: np.concatenate([r[k:], np.zeros(k, r.dtype)])
    while step < V:
        rank = dense(rank * (rank.max(initial=0) + 1) + shifted(rank, step))
        step *= 2
    sample = np.flatnonzero(np.isin(np.arange(len(text)) % V, COVER))
    cover = np.zeros(len(text), np.int64)
    cover[sample] = rank[sample]
    while step < 4 * V:
        cover[sample] = dense(cover[sample] * (cover.max(initial=0) + 1) + shifted(cover, step)[sample])
        step *= 2
    residue = at % V
    order = np.lexsort((cover[at + DELTA[residue, residue]], rank[at], bucket))
    b, r, q = bucket[order], rank[at[order]], residue[order]
    start = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (r[1:] != r[:-1]))) if len(order) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(order))
    if len(start):
        mixed = np.flatnonzero(np.minimum.reduceat(q, start) != np.maximum.reduceat(q, start))
        for i in mixed:  # a tie of suffixes of different residues: compare each pair after its own number of tokens

            def compare(x: int, y: int) -> int:
                d = DELTA[at[x] % V, at[y] % V]
                return int(cover[at[x] + d]) - int(cover[at[y] + d])

            order[start[i] : end[i]] = sorted(order[start[i] : end[i]].tolist(), key=cmp_to_key(compare))
    return order, rank


def _sort(length: int):
    """(d, t, start, end, later) of repeated spans, from segments sorted by bucket and content."""

    def spans(d, t, p, later) -> pa.RecordBatch:
        order = np.lexsort((p, later, t, d))
        d, t, p, later = d[order], t[order], p[order], later[order]
        new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (later[1:] != later[:-1]) | (p[1:] > p[:-1] + 1)) if len(p) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p))[: len(first)] - 1
        return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), pa.array(p[first]), pa.array(p[last] + length), pa.array(later[first].astype(bool))], ["d", "t", "start", "end", "later"])

    def solve(x: dict) -> pa.RecordBatch:
        n = x["n"].astype(np.int64)
        size = n + length - 1
        pad = -x["rel"].astype(np.int64) % V
        room = (pad + size + V) // V * V
        base = np.cumsum(room) - room + pad
        text = np.zeros(int(room.sum()) + 4 * V + length, np.int64)
        flat = np.frombuffer(b"".join(x["seg"]), np.uint64)
        text[np.repeat(base, size) + ragged(size)] = dense(flat) + 1
        owner = np.repeat(np.arange(len(n)), n)
        p = ragged(n)
        at = base[owner] + p
        order, rank = suffix_order(text, at, dense(x["g"])[owner])
        i, j, g = at[order][:-1], at[order][1:], x["g"][owner[order]]
        same = g[1:] == g[:-1]
        for k in [*range(0, length - V, V), length - V]:
            same &= rank[i + k] == rank[j + k]
        group = np.cumsum(np.append(False, ~same)) if len(order) else order
        o = owner[order]
        d, t, place, copied = x["d"][o], x["t"][o], x["lo"][o].astype(np.int64) + p[order], x["copied"][o]
        by = np.lexsort((place, t, d, group))
        d, t, place, copied, group = d[by], t[by], place[by], copied[by], group[by]
        later = np.append(False, group[1:] == group[:-1]) if len(group) else copied
        shared = np.append(later[1:], False) | later | copied if len(group) else copied
        return spans(d[shared], t[shared], place[shared], later[shared])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("g", "s", "d", "t", "lo", "n", "rel")
        held: dict | None = None
        last = None  # (g, s, d, t, lo) of the row before

        def copy(x: dict, at: np.ndarray) -> pa.RecordBatch:
            n = x["n"][at].astype(np.int64)
            who = np.repeat(at, n)
            return spans(x["d"][who], x["t"][who], x["lo"][who].astype(np.int64) + ragged(n), np.ones(len(who), bool))

        for b in batches:
            if not b.num_rows:
                continue
            x = {k: b.column(k).to_numpy() for k in keys}
            x["seg"], x["copied"] = b.column("seg").to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
            before = {k: np.append(np.array([last[k] if last else 0], x[k].dtype), x[k][:-1]) for k in ("g", "s", "d", "t", "lo")}
            same = (x["g"] == before["g"]) & (x["s"] == before["s"])
            again = same & (x["d"] == before["d"]) & (x["t"] == before["t"]) & (x["lo"] == before["lo"])
            if last is None:
                same[0] = again[0] = False
            last = {k: x[k][-1] for k in before}
            copies = np.flatnonzero(same & ~again)
            if len(copies):
                yield copy(x, copies)
            head = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            x["copied"][head[copies][head[copies] >= 0]] = True
            if held is not None and (head[copies] < 0).any():
                held["copied"][-1] = True
            x = {k: v[~same] for k, v in x.items()}
            held = x if held is None else {k: np.concatenate([held[k], x[k]]) for k in x}
            if len(held["g"]) >= BLOCK_ROWS:
                other = np.flatnonzero(held["g"] != held["g"][-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield solve({k: v[:cut] for k, v in held.items()})
                    held = {k: v[cut:] for k, v in held.items()}
        if held is not None:
            yield solve(held)

    return run


def repeated_passages(docs: DataFrame, min_tokens: int = 45, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (tokens, end exclusive), n_tokens, kept; a row per longest repeated span.

    A span with ``kept`` consists of runs of ``min_tokens`` tokens that come again later; one without,
    of runs that stood before, in the same document or one of a smaller (doc_id, hash of the text):
    these are the ones to delete.  Rows equal in doc_id and text are one document; rows that share
    only the doc_id are different ones.  Null and short texts have no spans; rows without a doc_id
    are left out.  Other columns are ignored; empty tables give no rows.
    """
    if min_tokens < max(V, GRAM) + 1:
        raise ValueError(f"min_tokens must be over {max(V, GRAM)}")
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text")).where("d is not null").withColumn("t", F.coalesce(F.xxhash64("text"), F.lit(0)))
    anchors = Stage(d.mapInArrow(_anchors(min_tokens), "g long, d long, t long, a int, lo int, n int"), "anchors")
    many = anchors.df.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    hits = anchors.df.join(many, "g").distinct().groupBy("d", "t").agg(F.collect_list(F.struct("g", "a", "lo", "n")).alias("hits"))
    hits = only_stage(hits, "hits", anchors)
    # Rows equal in doc_id and text meet again below, where all but one are passed over.
    texts = only(d, hits.select("d").distinct(), "d").join(hits, ["d", "t"]).select("d", "t", "text", "hits")
    segments = texts.mapInArrow(_segments(min_tokens), "g long, s long, d long, t long, lo int, n int, rel int, seg binary")
    found = segments.repartition("g").sortWithinPartitions("g", "s", "d", "t", "lo").mapInArrow(_sort(min_tokens), "d long, t long, start long, end long, later boolean")
    w = Window.partitionBy("d", "t", "later").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") > F.coalesce(far, F.lit(-1)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("part", part).groupBy("d", "t", "later", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.col("d").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_tokens"), (~F.col("later")).alias("kept"))


#: The same rows from the definition: all windows of 45 tokens.
ORACLE_SQL = r"""
with tokens as (select doc_id as d, regexp_extract_all(text, '[\x{3000}-\x{10FFFF}]|[^\x00-\x20\x{3000}-\x{10FFFF}]+') as w from documents where doc_id is not null),
windows as (select d, unnest(range(0, len(w) - 44)) as p, unnest([hash(w[j + 1 : j + 45]) for j in range(0, len(w) - 44)]) as h from tokens where len(w) >= 45),
numbered as (select d, p, row_number() over (partition by h order by d, p) > 1 as later, count(*) over (partition by h) as n from windows),
marked as (select d, p, later, p - lag(p) over (partition by d, later order by p) > 45 as gap from numbered where n > 1),
spans as (select d, p, later, sum(case when coalesce(gap, true) then 1 else 0 end) over (partition by d, later order by p rows unbounded preceding) as span from marked)
select d as doc_id, min(p) as start, max(p) + 45 as "end", max(p) + 45 - min(p) as n_tokens, not later as kept from spans group by d, later, span
"""
