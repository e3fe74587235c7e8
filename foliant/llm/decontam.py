"""Benchmark decontamination: a prefix-filtered set join of shingles over item-sized windows.

A document leaks an item when some window of it, as many words long as the item, holds at least
``threshold`` of the item's distinct shingles (runs of ``SHINGLE`` words).

1. Document frequencies of the items' shingles, over all documents, order each item's shingles
   from rare to common.
2. A window that holds ceil(threshold * n) of n shingles holds one of the first
   n - ceil(threshold * n) + 1 in that order: only documents with one of these prefix shingles,
   and enough shingles, become candidates (prefix and length bounds).
3. Candidates are verified exactly, over the windows that hold a prefix shingle (positional bound).

The items' shingles travel to the executors while there are at most ``max_lookup`` of them (about 40
bytes each), and a document is a candidate and verified where it is read: nothing of it is moved.
Beyond that the documents' shingles are joined with the items', and candidates are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import Stage, fresh, long_id, only, only_stage
from .textkit import Lookup, Words, pieces, ragged, shingles, signed

SHINGLE = 3
FOUND = "d long, i long, containment double, start long"


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        w = Words(b.column("text"))
        sh, off = shingles(w.hash, w.off, SHINGLE)
        item = np.repeat(np.arange(b.num_rows), np.diff(off))
        words = np.diff(w.off)[item]
        yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(item)), pa.array(signed(sh)), pa.array(words)], ["i", "h", "words"])


def _frequency(look: Lookup):
    """(h, n): in how many documents of the partition each sought shingle is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(look.values), np.int64)
        for b in pieces(batches):
            w = Words(b.column("text"))
            sh, off = shingles(w.hash, w.off, SHINGLE)
            at, place = look.find(sh)
            doc = np.searchsorted(off, at, side="right") - 1
            n += np.bincount(np.unique(doc * len(n) + place) % max(1, len(n)), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(signed(look.values)[some]), pa.array(n[some])], ["h", "n"])

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, size, h, p): all shingles with their places, and the document's number of them."""
    for b in pieces(batches):
        w = Words(b.column("text"))
        sh, off = shingles(w.hash, w.off, SHINGLE)
        doc = np.repeat(np.arange(b.num_rows), np.diff(off))
        yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(doc)), pa.array(np.diff(off)[doc]), pa.array(signed(sh)), pa.array(ragged(np.diff(off)))], ["d", "size", "h", "p"])


def best(sh: np.ndarray, item: np.ndarray, words: int, hits: np.ndarray) -> tuple[int, int]:
    """Most distinct shingles of the item in a window with a hit, and the first such window's start."""
    order = np.argsort(item)
    place = np.minimum(np.searchsorted(item[order], sh), len(item) - 1)
    at = np.flatnonzero(item[order][place] == sh)
    kind = place[at]
    span = max(1, words - SHINGLE + 1)
    most, where = 0, -1
    lo = np.searchsorted(at, np.unique(hits) - span + 1)
    hi = np.searchsorted(at, np.unique(hits), side="right")
    starts = np.unique(np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True)]))
    end = np.searchsorted(at, at[starts] + span)
    for s, e in zip(starts, end, strict=True):
        if e - s > most and (n := len(np.unique(kind[s:e]))) > most:
            most, where = n, int(at[s])
    return most, where


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            sh, off = shingles(w.hash, w.off, SHINGLE)
            out = []
            ids = b.column("d").to_pylist()
            for r, found in enumerate(b.column("items").to_pylist()):
                for x in found:
                    item = np.array(x["s"], np.int64).view(np.uint64)
                    n, start = best(sh[off[r] : off[r + 1]], item, x["words"], np.array(x["hits"], np.int64))
                    if n >= np.ceil(threshold * len(item) - 1e-9):
                        out.append((ids[r], x["i"], n / len(item), start))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["d", "i", "containment", "start"])

    return run


class Items:
    """The items' shingles and their prefixes, as a worker looks them up."""

    def __init__(self, each: pa.Table, prefix: pa.Table) -> None:
        each = each.sort_by([("i", "ascending"), ("h", "ascending")])
        i, h = each["i"].to_numpy(), each["h"].to_numpy()
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        self.ids, self.off = i[first], np.append(first, len(i))
        self.shingles, self.words = h.view(np.uint64), each["words"].to_numpy()[first]
        # By prefix shingle, in the lookup's order: the items that have it, and how many shingles a window of theirs needs.
        p = prefix["h"].to_numpy().view(np.uint64)
        order = np.argsort(p, kind="stable")
        self.look = Lookup(p)
        self.begin = np.append(np.searchsorted(p[order], self.look.values), len(p))
        self.item, self.need = np.searchsorted(self.ids, prefix["i"].to_numpy())[order], prefix["need"].to_numpy()[order]

    def leaks(self, text: pa.Array, threshold: float) -> list[tuple[int, int, float, int]]:
        """(row, item, containment, start) of the texts' leaks."""
        w = Words(text)
        sh, off = shingles(w.hash, w.off, SHINGLE)
        at, place = self.look.find(sh)
        row = np.searchsorted(off, at, side="right") - 1
        count = self.begin[place + 1] - self.begin[place]
        entry = np.repeat(self.begin[place], count) + ragged(count)
        row, at, item = np.repeat(row, count), np.repeat(at, count), self.item[entry]
        ok = np.diff(off)[row] >= self.need[entry]
        row, at, item = row[ok], at[ok], item[ok]
        order = np.lexsort((at, item, row))
        row, at, item = row[order], at[order], item[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else np.zeros(0, np.int64)
        out = []
        for a, z in zip(first, np.append(first[1:], len(row))[: len(first)], strict=True):
            r, x = row[a], item[a]
            own = self.shingles[self.off[x] : self.off[x + 1]]
            n, start = best(sh[off[r] : off[r + 1]], own, int(self.words[x]), at[a:z] - off[r])
            if n >= np.ceil(threshold * len(own) - 1e-9):
                out.append((int(r), int(self.ids[x]), n / len(own), start))
        return out


def _prepare(docs: DataFrame, benchmark: DataFrame, threshold: float, max_lookup: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, Stage, Stage, bool]:
    """The documents (d, text), the items' shingles (i, h, words), their prefixes (i, h, need), and whether workers look them up."""
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text")).where("d is not null")
    items = benchmark.select(long_id(benchmark, item_col).alias("i"), F.col(item_text_col).alias("text")).where("i is not null")
    longest = Window.partitionBy("i")
    each = items.mapInArrow(_item_shingles, "i long, h long, words long").withColumn("words", F.max("words").over(longest)).distinct()
    each = Stage(each, "items")
    small = each.df.count() <= max_lookup
    if small:
        look = Lookup(each.df.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64))  # at most `max_lookup`
        n = d.select("text").mapInArrow(_frequency(look), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    else:
        n = d.mapInArrow(_hits, "d long, size long, h long, p long").select("d", "h").distinct().join(each.df.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.df.join(n, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(longest.orderBy("n", "h"))).withColumn("size", F.count("*").over(longest))
    need = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    # A shingle that is in no document can't be met; it keeps its place in the prefix.
    prefix = Stage(ranked.withColumn("need", need).where("rank <= size - need + 1 and n > 0").select("i", "h", "need"), "prefix")
    return d, each, prefix, small


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, max_lookup: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, containment (of the best window), start (its first word, from 0); a row per leak.

    Documents or items without a word (null, empty) leak nothing, nor do rows without an id.  An
    item of fewer words than a shingle has one shingle, which only a document of just these words
    has.  Items that share an item_id are one item of all their shingles, as long as the longest.
    Of documents that share a doc_id the best window counts; of equal windows that of the lowest start.
    Other columns are ignored; empty tables give no rows.
    """
    d, each, prefix, small = _prepare(docs, benchmark, threshold, max_lookup, id_col, text_col, item_col, item_text_col)
    used = [each, prefix]
    if small:
        items = Items(each.df.toArrow(), prefix.df.toArrow())  # at most `max_lookup` rows each

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                out, ids = items.leaks(b.column("text"), threshold), b.column("d")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()), 1))], ["d", "i", "containment", "start"])

        found = d.mapInArrow(find, FOUND)
    else:
        hits = d.mapInArrow(_hits, "d long, size long, h long, p long").join(prefix.df.select("h").distinct(), "h", "left_semi")
        pairs = hits.join(prefix.df, "h").where("size >= need").groupBy("d", "i").agg(F.collect_set("p").alias("hits"))
        sets = each.df.groupBy("i").agg(F.collect_list("h").alias("s"), F.first("words").alias("words"))
        todo = Stage(pairs.join(sets, "i").groupBy("d").agg(F.collect_list(F.struct("i", "words", "s", "hits")).alias("items")), "candidates")
        used.append(todo)
        found = only(d, todo.df.select("d"), "d").join(todo.df, "d").mapInArrow(_verify(threshold), FOUND)
    top = found.groupBy("d", "i").agg(F.max(F.struct("containment", -F.col("start"))).alias("b"))
    return only_stage(top.select(F.col("d").alias("doc_id"), F.col("i").alias("item_id"), "b.containment", (-F.col("b.col2")).alias("start")), "leaks", *used)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, max_lookup: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows, with all their columns, of the documents that ``leaks`` finds nothing in: rows of an id whose
    other texts leak go too.  Rows without an id stay.  Rows are filtered where they are read, but for repeated ids."""
    _, each, prefix, small = _prepare(docs, benchmark, threshold, max_lookup, id_col, text_col, item_col, item_text_col)
    name = fresh(docs, "leaking")
    if not small:
        found = leaks(docs, benchmark, threshold, max_lookup, id_col, text_col, item_col, item_text_col)
        return only(docs, found.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct(), id_col, how="left_anti")
    items, cols = Items(each.df.toArrow(), prefix.df.toArrow()), docs.columns
    for x in (each, prefix):
        x.drop()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            bad = np.zeros(b.num_rows, bool)
            bad[[x[0] for x in items.leaks(b.column(text_col), threshold)]] = True
            bad &= b.column(id_col).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad)], [*cols, name])

    marked = docs.mapInArrow(mark, docs.select("*", F.lit(False).alias(name)).schema)
    again = Stage(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "again")
    if again.df.isEmpty():
        return marked.where(~F.col(name)).drop(name)
    bad = Stage(only(marked, again.df, id_col).where(F.col(name)).select(id_col).distinct(), "leaking")
    return only(marked.where(~F.col(name)).drop(name), bad.df, id_col, how="left_anti")


#: The same rows from the definition: every window that begins with a shingle of the item.
ORACLE_SQL = rf"""
with texts as (select doc_id as id, false as item, text from documents union all select item_id, true, text from benchmark),
words as (select id, item, regexp_extract_all(lower(text), '[\x{{3000}}-\x{{10FFFF}}]|[0-9a-z\x{{80}}-\x{{2FFF}}]+') as w from texts),
runs as (select id, item, len(w) as n, unnest([array_to_string(w[j + 1 : j + {SHINGLE}], ' ') for j in range(0, greatest(len(w) - {SHINGLE - 1}, 1))]) as s, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 1))) as p from words where len(w) > 0),
sought as (select distinct id as i, s, greatest(n - {SHINGLE - 1}, 1) as span from runs where item),
sizes as (select i, count(*) as size from sought group by i),
hits as (select r.id as d, i, span, r.s, p from runs r join sought q on r.s = q.s where not r.item),
enough as (select d, i from hits join sizes using (i) group by d, i, size having count(distinct s) >= 0.6 * size - 1e-9),
starts as (select a.d, a.i, a.p, count(distinct b.s) as n from hits a join enough using (d, i) join hits b on a.d = b.d and a.i = b.i and b.p >= a.p and b.p < a.p + a.span group by a.d, a.i, a.p)
select d as doc_id, i as item_id, n / size as containment, p as start from (select *, row_number() over (partition by d, i order by n desc, p) as nth from starts) join sizes using (i) where nth = 1 and n >= 0.6 * size - 1e-9
"""
