"""Line dedup by winnowing over line hashes.

Lines are the parts of a text between newlines, without white space at their ends; blank lines
don't count.  Documents are ordered by (doc_id, hash of the text), nulls first.  A run of ``window`` or more
consecutive lines is deleted where the same run stands earlier, in the same or an earlier
document; a document with fewer lines is one run, deleted where a document of just those lines
stands earlier.

Winnowing: each window of ``window`` line hashes selects its smallest (the rightmost of equals),
so two equal windows select the same line: any shared run of ``window`` lines has a common
fingerprint.  A row is written for each selected position, 2 in ``window`` + 1 lines on average, with
the lines around it as hashes of the windows that selected it.  Positions meet at their
fingerprints; those whose fingerprint occurs once go.  Where positions met, the match is extended
both ways over their windows, and every occurrence but the first of an equal window marks
its lines; longer runs are the union of their windows.  No pair of positions is ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .store import Stage, long_id, only
from .textkit import filled, pieces

BLANK = " \t\r"


def lines_of(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def fingerprints(d: DataFrame, window: int) -> DataFrame:
    """(d, t, n, s, p, runs) of each selected position of (d, t, text): n lines a window; s the selected line;
    the windows that selected it start at p, p + 1, ..., and have the hashes ``runs``."""
    keyed = d.select("d", "t", F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(x)).alias("h")).where("size(h) > 0")
    sliced = keyed.select("d", "t", F.expr(f"transform(sequence(0, greatest(size(h) - {window}, 0)), p -> slice(h, p + 1, {window}))").alias("w"))
    picked = sliced.select("d", "t", F.expr("transform(w, (x, p) -> struct(p + size(x) - array_position(reverse(x), array_min(x)) as at, array_min(x) as s, xxhash64(x) as r))").alias("w"), F.expr("size(w[0])").alias("n"))
    heads = picked.select("d", "t", "n", "w", F.explode(F.expr("filter(sequence(0, size(w) - 1), i -> i = 0 or w[i].at != w[greatest(i - 1, 0)].at)")).alias("p"))
    return heads.select("d", "t", "n", F.expr("w[p].s").alias("s"), "p", F.expr(f"transform(filter(slice(w, p + 1, {window}), x -> x.at = w[p].at), x -> x.r)").alias("runs"))


def remove_repeated_lines(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines (not blank), n_removed; a row per document.

    Null texts stay null, with 0 lines; empty texts stay empty.  Rows equal in doc_id and text are
    one document, and each gives a row.  Null doc_ids are kept, and are equal to each other.  Other
    columns are ignored.
    """
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    fp = Stage(fingerprints(d, window), "fingerprints")
    met = fp.df.groupBy("s").agg(F.count("*").alias("copies")).where("copies > 1").select("s")
    runs = Stage(fp.df.join(met, "s").select("d", "t", "n", "p", F.posexplode("runs").alias("o", "w")).select("d", "t", "n", (F.col("p") + F.col("o")).alias("p"), "w"), "runs")
    place = F.struct("d", "t", "p")
    first = runs.df.groupBy("w", "n").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marks = runs.df.join(first, ["w", "n"]).where(place != F.col("first"))
    # x: d and t as one number; that others have the same only costs time.
    drop = Stage(marks.groupBy(F.col("d").alias("dd"), F.col("t").alias("tt")).agg(F.collect_set("p").alias("drop")).withColumn("x", F.xxhash64("dd", "tt")), "drop")
    fp.drop()
    runs.drop()
    keyed = d.withColumn("x", F.xxhash64("d", "t"))
    ids = drop.df.select("x").distinct()
    same = (keyed.x == drop.df.x) & keyed.d.eqNullSafe(drop.df.dd) & keyed.t.eqNullSafe(drop.df.tt)
    marked = only(keyed, ids, "x").join(drop.df, same, "left").select("d", "text", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    rest = only(keyed, ids, "x", how="left_anti").select("d", "text", F.size(lines_of(F.col("text"))).cast("long"), F.lit(0).cast("long"))
    return marked.mapInArrow(_without(window), "doc_id long, text string, n_lines long, n_removed long").union(rest)


def _without(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            lines = pc.split_pattern(filled(b.column("text")), "\n")
            flat, off = lines.flatten(), np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))])
            place = np.flatnonzero(pc.binary_length(pc.ascii_trim(flat, BLANK)).to_numpy(zero_copy_only=False))
            begin = np.searchsorted(place, off)
            drop = b.column("drop")
            row = np.repeat(np.arange(b.num_rows), drop.value_lengths().to_numpy(zero_copy_only=False))
            at = begin[row][:, None] + drop.flatten().to_numpy()[:, None] + np.arange(window)
            gone = np.zeros(len(flat), bool)
            gone[place[at[at < begin[row + 1][:, None]]]] = True
            left = np.concatenate([[0], np.cumsum(~gone)])[off]
            kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(~gone)))
            removed = np.diff(off) - np.diff(left)
            text = pc.if_else(pc.is_null(b.column("text")), pa.scalar(None, pa.string()), pc.binary_join(kept, "\n"))
            yield pa.RecordBatch.from_arrays([b.column("d"), text, pa.array(np.diff(begin)), pa.array(removed)], ["doc_id", "text", "n_lines", "n_removed"])

    return run


#: The same rows from the definition: all windows, compared as text.
ORACLE_SQL = """
with lines as (select doc_id as d, text, [trim(x, chr(32) || chr(9) || chr(13)) for x in string_split(coalesce(text, ''), chr(10)) if trim(x, chr(32) || chr(9) || chr(13)) <> ''] as l, string_split(coalesce(text, ''), chr(10)) as raw from documents),
windows as (select d, text, p, list_slice(l, p + 1, p + 2) as w from (select d, text, l, unnest(range(0, greatest(len(l) - 1, 1))) as p from lines where len(l) > 0)),
marked as (select d, p, w from (select d, p, w, row_number() over (partition by w order by d, p) as k from windows) where k > 1),
gone as (select distinct d, p + j as i from marked, range(0, 2) as r(j) where j < len(w)),
numbered as (select d, raw_i, x, case when trim(x, chr(32) || chr(9) || chr(13)) <> '' then sum(case when trim(x, chr(32) || chr(9) || chr(13)) <> '' then 1 else 0 end) over (partition by d order by raw_i) - 1 end as i
  from (select d, unnest(raw) as x, unnest(range(0, len(raw))) as raw_i from lines)),
kept as (select n.d, string_agg(x, chr(10) order by raw_i) as text from numbered n left join gone g on n.d = g.d and n.i = g.i where g.i is null group by n.d),
many as (select d, count(*) as n from gone group by d)
select l.d as doc_id, case when m.n is null then l.text else coalesce(k.text, '') end as text, cast(len(l.l) as bigint) as n_lines, cast(coalesce(m.n, 0) as bigint) as n_removed
from lines l left join many m on l.d = m.d left join kept k on l.d = k.d
"""
