"""Near-duplicate groups by SetSketch registers.

Elements are the runs of ``SHINGLE`` words.  Each element has one point in every register, in an
order of its own: the j-th lies in the j-th of ``m`` exponentially spaced intervals (a truncated
exponential variate), so a register's minimum is an exponential variate, most points never need
to be made, and sketches of parts merge by the maximum of their registers.  A register holds
``floor(1 - log_b(minimum))``.

Documents of equal words collapse first.  Bands of ``rows`` registers are joined; in each bucket
the smallest document left leads: all others are compared with it by the joint maximum likelihood
of (bigger, smaller, equal) register counts, and those surely alike follow it.  What is left is
then compared with each follower in turn, whose own followers join them, and the next document
leads, until none is left.  So a pair is compared unless both follow the same leader, and a bucket
of n copies takes n comparisons.  Pairs likely enough are verified by the exact Jaccard similarity
of their shingle sets.  Where a pair that was sure fails, the buckets that hold both are walked
again without it, until every pair that wasn't compared is implied by verified ones.  Groups are the
connected components of verified pairs.

A bucket of more than ``bucket`` documents is split into parts by a hash of the id, which are walked
like buckets of their own.  Then one document of each component found so far stands for it in the
bucket, and these are walked, until that joins no more; what is still apart is compared pair by
pair, in blocks, the members of all but the largest component with those of every other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Stage, long_id, only, only_stage
from .textkit import Words, list_array, mix, pieces, ragged, reduce_sum, shingles, signed

SHINGLE = 3
B, A, Q = 1.001, 20.0, 65534
FREE = np.uint32(0xFFFFFFFF)


def registers(sh: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """SetSketch of each segment of element hashes, one row of m registers each; 0 where it is empty."""
    n, bits = len(off) - 1, m.bit_length() - 1
    low = np.full(n * m, FREE, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    h = sh
    first, step = (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(63 - 2 * bits)).astype(np.int64) & (m - 1)) | 1
    for j in range(m):
        if not len(doc):
            break
        u = (mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(low, doc * m + ((first + j * step) & (m - 1)), np.uint32(j << 24 >> max(0, bits - 7)) | (u >> np.uint32(max(0, bits - 7))))
        active = np.unique(doc)
        full = np.zeros(n, bool)
        full[active] = (low.reshape(n, m)[active] != FREE).all(axis=1)
        left = ~full[doc]
        doc, h, first, step = doc[left], h[left], first[left], step[left]
    t = (low.astype(np.float64) + 0.5) / 2**31
    x = -np.log1p(-np.minimum(t, 1 - 1e-12)) / A
    k = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1)
    return np.where(low == FREE, 0, k).astype(np.uint16).reshape(n, m)


def band_keys(k: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of each sketch."""
    n, m = k.shape
    parts = k[:, : m // rows * rows].reshape(n, m // rows, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, :, i] + np.uint64(1))
    return mix(key + np.arange(m // rows, dtype=np.uint64)[None, :])


def cardinality(k: np.ndarray) -> np.ndarray:
    return k.shape[1] * (1 - 1 / B) / (A * np.log(B) * np.exp(-k.astype(np.float64) * np.log(B)).sum(axis=1))


def jaccard_ml(ku: np.ndarray, kv: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity of pairs of sketches."""
    nu, nv = cardinality(ku), cardinality(kv)
    u = nu / (nu + nv)
    more, less = (ku > kv).sum(axis=1)[:, None], (ku < kv).sum(axis=1)[:, None]
    same = ku.shape[1] - more - less
    top = np.minimum(u / (1 - u), (1 - u) / u)[:, None]
    u = u[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    lo, width = np.zeros_like(top), top
    for _ in range(3):
        j = np.clip(lo + width * np.linspace(0, 1, 17)[None, :], 0, top)
        pm, pl = p(u - (1 - u) * j), p(1 - u - u * j)
        ll = more * np.log(np.maximum(pm, 1e-12)) + less * np.log(np.maximum(pl, 1e-12)) + same * np.log(np.maximum(1 - pm - pl, 1e-12))
        best = np.take_along_axis(j, ll.argmax(axis=1)[:, None], 1)
        width = width / 8
        lo = np.maximum(best - width / 2, 0)
    return best[:, 0]


def _sketch(m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            count = np.diff(w.off)
            full = np.flatnonzero(count)
            pos = ragged(count).astype(np.uint64)
            c1 = reduce_sum(w.hash * mix(pos + np.uint64(1)), w.off)[full]
            c2 = reduce_sum(mix(w.hash) * mix(pos + np.uint64(1 << 40)), w.off)[full]
            k = registers(*shingles(w.hash, w.off, SHINGLE), m)[full]
            keys = band_keys(k, rows)
            yield pa.RecordBatch.from_arrays([
                b.column("d").take(pa.array(full)), pa.array(signed(mix(c1))), pa.array(signed(mix(c2))),
                pa.Array.from_buffers(pa.binary(2 * m), len(full), [None, pa.py_buffer(np.ascontiguousarray(k).tobytes())]).cast(pa.binary()),
                list_array(signed(keys).ravel(), np.arange(len(full) + 1) * keys.shape[1], pa.int64()),
            ], ["d", "c1", "c2", "k", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        w = Words(b.column("text"))
        sh, off = shingles(w.hash, w.off, SHINGLE)
        each = [np.unique(signed(sh[off[i] : off[i + 1]])) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("d"), list_array(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), pa.int64())], ["d", "s"])


def _lead(m: int, threshold: float, margin: float):
    """Edges (u, v, sure) of the members of each bucket, u < v; pairs that aren't compared are joined
    by edges that are sure.  Rows come sorted by bucket ``g`` and id; ``no``: ids that aren't surely alike."""

    def bucket(ids: np.ndarray, k: np.ndarray, no: list, out: list) -> None:
        left, follow = np.arange(len(ids)), []
        while len(left):
            if follow:
                at = follow.pop()
            else:
                at, left = left[0], left[1:]
            est = np.concatenate([jaccard_ml(np.broadcast_to(k[at], (len(x), k.shape[1])), k[x]) for x in np.array_split(left, len(left) // 4096 + 1)])
            near, sure = est >= threshold - margin, est >= threshold + margin
            if no[at]:
                sure &= ~np.isin(ids[left], no[at])
            out.append((np.full(near.sum(), ids[at]), ids[left][near], sure[near]))
            follow.extend(left[sure])
            left = left[~sure]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def solve(key: np.ndarray, ids: np.ndarray, k: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(at, len(key)))
            out: list = []
            two = at[size == 2]
            if len(two):
                ok = jaccard_ml(k[two], k[two + 1]) >= threshold - margin
                out.append((ids[two][ok], ids[two + 1][ok], np.zeros(ok.sum(), bool)))  # nothing else hangs on them
            for i in np.flatnonzero(size > 2):
                bucket(*(x[at[i] : at[i] + size[i]] for x in (ids, k, no)), out)
            u, v, sure = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1, 2))
            e = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), sure], 1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(e[:, 2] == 1)], ["u", "v", "sure"])

        for b in batches:
            if not b.num_rows:
                continue
            got = [b.column("g").to_numpy(), b.column("d").to_numpy(), np.frombuffer(b"".join(b.column("k").to_pylist()), np.uint16).reshape(-1, m), np.fromiter(b.column("no").to_pylist(), object, b.num_rows)]
            rest = got if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, got, strict=True)]
            other = np.flatnonzero(rest[0] != rest[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield solve(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield solve(*rest)

    return run


def components(edges: DataFrame) -> tuple[DataFrame, Stage]:
    """(node, group) for every node of edges (u, v): the smallest node of its connected component."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    now = Stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("group")), "labels")
    while True:
        near = both.join(now.df.select(F.col("node").alias("v"), F.col("group").alias("g")), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("g"))
        low = now.df.join(near, "node").select("node", F.col("group").alias("was"), F.least("group", "g").alias("group"))
        jump = now.df.select(F.col("node").alias("group"), F.col("group").alias("far"))
        new = Stage(low.join(jump, "group", "left").select("node", "was", F.least("group", F.coalesce("far", "group")).alias("group")), "labels")
        changed = not new.df.where("was != group").isEmpty()
        now.drop()
        now = new
        if not changed:
            return now.df.select("node", "group"), now


def _cross(m: int, least: float):
    """Pairs (u, v, sure) of a block's queries and its members, of different components."""

    def run(t: pa.Table) -> pa.Table:
        ask = t["query"].to_numpy()
        d, c, k = t["d"].to_numpy(), t["comp"].to_numpy(), np.frombuffer(b"".join(t["k"].to_pylist()), np.uint16).reshape(-1, m)
        out = []
        for i in np.flatnonzero(ask):
            j = np.flatnonzero(~ask & (c != c[i]))
            j = j[jaccard_ml(np.broadcast_to(k[i], (len(j), m)), k[j]) >= least] if len(j) else j
            out.append(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])], 1))
        e = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"u": e[:, 0], "v": e[:, 1], "sure": np.zeros(len(e), bool)})

    return run


class Joined:
    """The pairs compared so far, ``alike`` or not, over documents ``d`` (d, text) and ``sketch`` (d, c1, k)."""

    def __init__(self, d: DataFrame, sketch: DataFrame, threshold: float, m: int, margin: float) -> None:
        self.d, self.sketch, self.threshold, self.m, self.margin = d, sketch, threshold, m, margin
        self.alike: list[Stage] = []
        self.compared: Stage | None = None
        self.no: Stage | None = None

    def verify(self, found: DataFrame) -> tuple[Stage, bool]:
        """The edges, written; and whether any that wasn't compared before is alike."""
        edges = Stage(found.groupBy("u", "v").agg(F.max("sure").alias("sure")), "edges")
        new = edges.df.join(self.compared.df, ["u", "v"], "left_anti") if self.compared else edges.df
        ids = Stage(new.select(F.col("u").alias("d")).union(new.select("v")).distinct(), "ids")
        sets = Stage(only(self.d, ids.df, "d").mapInArrow(_sets, "d long, s array<long>"), "sets")
        side = lambda x: sets.df.select(F.col("d").alias(x), F.col("s").alias(f"s{x}"))
        pair = new.join(side("u"), "u").join(side("v"), "v").withColumn("i", F.size(F.array_intersect("su", "sv")))
        ok = Stage(pair.where(F.col("i") >= self.threshold * (F.size("su") + F.size("sv") - F.col("i"))).select("u", "v").distinct(), "alike")
        done = new.select("u", "v").join(ok.df.withColumn("ok", F.lit(True)), ["u", "v"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        after = Stage(done.union(self.compared.df) if self.compared else done, "compared")
        for x in (ids, sets, *([self.compared] if self.compared else [])):
            x.drop()
        self.alike.append(ok)
        self.compared = after
        return edges, not ok.df.isEmpty()

    def walk(self, members: DataFrame) -> bool:
        """All pairs of each bucket of (d, c1, g) compared that verified ones don't imply; whether any was alike."""
        part, any_ = members, False
        while True:
            rows = part.join(self.sketch, ["d", "c1"])
            if self.no:
                both = self.no.df.union(self.no.df.select("v", "u")).groupBy(F.col("u").alias("d")).agg(F.collect_list("v").alias("no"))
                rows = rows.join(both, "d", "left").select("d", "g", "k", "no")
            else:
                rows = rows.select("d", "g", "k", F.lit(None).cast("array<long>").alias("no"))
            edges, more = self.verify(rows.repartition("g").sortWithinPartitions("g", "d").mapInArrow(_lead(self.m, self.threshold, self.margin), "u long, v long, sure boolean"))
            any_ |= more
            wrong = edges.df.where("sure").select("u", "v").join(self.compared.df.where("not ok").select("u", "v"), ["u", "v"])
            failed = Stage(wrong.union(self.no.df).distinct() if self.no else wrong, "failed")
            edges.drop()
            before = self.no.df.count() if self.no else 0
            if failed.df.count() <= before:
                failed.drop()
                return any_
            again = failed.df.join(self.no.df, ["u", "v"], "left_anti") if self.no else failed.df
            again = Stage(again.join(members.select(F.col("d").alias("u"), "g"), "u").join(members.select(F.col("d").alias("v"), "g"), ["v", "g"]).select("g").distinct(), "again")
            if self.no:
                self.no.drop()
            self.no, part = failed, members.join(again.df, "g", "left_semi")

    def links(self) -> DataFrame:
        return reduce(DataFrame.union, [x.df for x in self.alike])

    def apart(self, hot: DataFrame, bucket: int) -> None:
        """The members (d, c1, b) of split buckets: components joined by one document of each, then pair by pair."""
        while True:
            label, labels = components(self.links())
            member = Stage(hot.join(label.select(F.col("node").alias("d"), F.col("group").alias("comp")), "d", "left").withColumn("comp", F.coalesce("comp", "d")), "members")
            labels.drop()
            one = member.df.groupBy("b", "comp").agg(F.min(F.struct("d", "c1")).alias("x"), F.count("*").alias("size"))
            several = one.groupBy("b").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("most")).where("comps > 1")
            parts = Stage(one.join(several, "b").select("b", "comp", "x.d", "x.c1", "comps", F.col("most.comp").alias("largest")), "parts")
            g = F.xxhash64("b", F.pmod(F.xxhash64("d"), F.ceil(F.col("comps") / bucket)), F.lit(1))
            more = not parts.df.isEmpty() and self.walk(parts.df.select("d", "c1", g.alias("g")))
            if not more:
                break
            member.drop()
            parts.drop()
        left = member.df.join(parts.df.select("b", "largest").distinct(), "b").join(self.sketch, ["d", "c1"])
        sizes = left.groupBy("b").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("largest")).alias("q"))
        blocks = lambda n: F.ceil(F.col(n) / bucket).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("d"), blocks(n)).cast("int")
        sized = left.join(sizes, "b")
        asking = sized.where("comp != largest").select("b", own("q").alias("i"), spread("n").alias("j"), F.lit(True).alias("query"), "d", "comp", "k")
        asked = sized.select("b", spread("q").alias("i"), own("n").alias("j"), F.lit(False).alias("query"), "d", "comp", "k")
        edges, _ = self.verify(asking.union(asked).groupBy("b", "i", "j").applyInArrow(_cross(self.m, self.threshold - self.margin), "u long, v long, sure boolean"))
        for x in (edges, member, parts):
            x.drop()


def near_duplicates(
    docs: DataFrame, threshold: float = 0.5, m: int = 128, rows: int = 3, margin: float = 0.15, bucket: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group), kept (doc_id = group_id), n_links; a row per doc_id.

    Documents are alike from a Jaccard similarity of ``threshold`` of their shingle sets on, or
    when they have the same words.  A pair just as similar shares one of the m // ``rows`` bands with a
    probability of 0.996, and is passed over where its estimate is under ``threshold`` - ``margin``.
    ``n_links``: the verified links of a document, exact copies' ones to the first included;
    those that others imply aren't looked for.  Texts without a word (null, empty) are alike to none.  Rows that
    share a doc_id are one document, alike to whatever one of them is alike to.  Rows without a
    doc_id are left out.  Other columns are ignored; empty tables give no rows.
    """
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text")).where("d is not null")
    made = d.mapInArrow(_sketch(m, rows), "d long, c1 long, c2 long, k binary, bands array<long>")
    sk = Stage(made.groupBy("d", "c1", "c2").agg(F.first("k").alias("k"), F.first("bands").alias("bands")), "sketches")
    first = sk.df.groupBy("c1", "c2").agg(F.min("d").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = Stage(sk.df.select("d", "c1", "c2").join(first, ["c1", "c2"]).where("d != rep"), "copies")
    reps = only(sk.df, copies.df.select("d", "c1", "c2"), ["d", "c1", "c2"], how="left_anti")
    each = reps.select("d", "c1", F.explode("bands").alias("b"))
    sizes = each.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    part = F.when(F.col("n") <= bucket, F.col("b")).otherwise(F.xxhash64("b", F.pmod(F.xxhash64("d"), F.ceil(F.col("n") / bucket))))
    shared = Stage(each.join(sizes, "b").withColumn("g", part), "shared")
    joined = Joined(d, reps.select("d", "c1", "k"), threshold, m, margin)
    joined.walk(shared.df.select("d", "c1", "g"))
    hot = shared.df.where(F.col("n") > bucket).select("d", "c1", "b")
    if not hot.isEmpty():
        joined.apart(hot, bucket)
    # A doc_id of several texts is linked to the copies of each.
    links = Stage(joined.links().union(copies.df.select("rep", "d")).distinct(), "links")
    for x in (sk, copies, shared, joined.compared, *joined.alike, *([joined.no] if joined.no else [])):
        x.drop()
    label, labels = components(links.df)
    degree = links.df.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = d.select("d").distinct().join(label.join(degree, "node").withColumnRenamed("node", "d"), "d", "left")
    out = out.select(F.col("d").alias("doc_id"), F.coalesce("group", "d").alias("group_id"), F.coalesce(F.col("group") == F.col("d"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return only_stage(out, "groups", links, labels)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, whose id is kept; one row of each id.  Rows without an id stay."""
    gone = Stage(groups.where("not kept").select(F.col("doc_id").alias(id_col)), "gone").df
    again = Stage(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "again").df
    left = only(docs, gone, id_col, how="left_anti")
    return only(left, again, id_col, how="left_anti").union(only(left, again, id_col).dropDuplicates([id_col]))
