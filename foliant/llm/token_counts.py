"""Token counts without ids: pieces are counted once per distinct pre-token.

1. Pre-tokens (matches of the tokenizer's pattern) are counted over all documents.
2. Each distinct pre-token is encoded once, for its number of pieces.
3. Documents' pre-token frequencies are joined with these numbers and summed.

Texts are split twice: a written table of all frequencies takes more disk than the texts.

The join has two ways.  At most ``most`` of the most frequent pre-tokens are broadcast (a bounded table,
whatever the data); frequencies of all others are shuffled and joined with the whole table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import Stage, long_id, only_stage
from .textkit import pieces, strings
from .token_ids import PATTERN, RANKS, encoder

#: Distinct pre-tokens that a task holds at most before it hands them on.
HELD = 400_000


def _pre_tokens(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

        for b in pieces(batches):
            for t in strings(b.column("text")):
                seen.update(split(t))
            if len(seen) > HELD:
                yield out()
                seen.clear()
        yield out()

    return run


def _count(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for b in batches:
            k = [len(enc.encode_ordinary(t)) for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(k, pa.int64())], ["piece", "n", "k"])

    return run


def _sum(known, pattern: str):
    """(d, piece, f, k): of each document the pre-tokens f and tokens k of known ones, piece null; and its unknown pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, table = regex.compile(pattern).findall, dict(zip(*known.value, strict=True))
        for b in pieces(batches):
            ids, found, f, k = [], [], [], []
            for d, t in zip(b.column("d").to_pylist(), strings(b.column("text")), strict=True):
                counts = Counter(split(t))
                for p in set(counts).difference(table):
                    ids.append(d)
                    found.append(p)
                    f.append(counts.pop(p))
                    k.append(None)
                ids.append(d)
                found.append(None)
                f.append(sum(counts.values()))
                k.append(sum(map(int.__mul__, counts.values(), map(table.__getitem__, counts))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(f, pa.int64()), pa.array(k, pa.int64())], ["d", "piece", "f", "k"])

    return run


def token_counts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, most: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens; a row per doc_id.

    Rows that share a doc_id (null ones too) are counted together.  Null and empty texts have 0;
    bytes that aren't UTF-8 are read as U+FFFD.
    Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # the size of the vocabulary, whatever the data
    d = docs.select(long_id(docs, id_col).alias("d"), F.col(text_col).alias("text"))
    seen = d.select("text").mapInArrow(_pre_tokens(pattern), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = Stage(seen.mapInArrow(_count(content, pattern), "piece string, n long, k long"), "pretokens")
    # The most frequent: all from a step of a scale of frequencies on, so that nothing is sorted.
    scaled = vocabulary.df.withColumn("step", F.floor(F.log2("n") * 8))
    sizes = {r.step: r["count"] for r in scaled.groupBy("step").count().collect()}
    held, least = 0, max(sizes, default=0) + 1
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > most:
            break
        least = step
    top = scaled.where(F.col("step") >= least).select("piece", "k").toArrow()
    known = spark.sparkContext.broadcast((top["piece"].to_pylist(), pc.cast(top["k"], pa.int64()).to_pylist()))  # at most `most`
    each = Stage(d.mapInArrow(_sum(known, pattern), "d long, piece string, f long, k long"), "frequencies")
    rest = each.df.where("piece is not null").select("d", "piece", "f").join(vocabulary.df.select("piece", F.col("k").alias("pieces")), "piece")
    rest = rest.groupBy("d").agg(F.sum("f").alias("f"), F.sum(F.col("f") * F.col("pieces")).alias("k"))
    out = each.df.where("piece is null").select("d", "f", "k").unionByName(rest).groupBy(F.col("d").alias("doc_id")).agg(F.sum("f").alias("n_pretokens"), F.sum("k").alias("n_tokens"))
    return only_stage(out, "token-counts", each, vocabulary)
