import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from foliant.llm import decontam, mixing, near_dup, quality, token_ids

from .test_decontam import brute as leaks_of
from .test_near_dup import brute as groups_of
from .test_quality import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus(260)
    bench = [(0, " ".join(f"word{j}" for j in range(30))), (1, None)]
    rows += [(1000, rows[2][1], "en", "s1"), (1001, rows[2][1] + " tail", "en", "s2"), (1002, rows[3][1] + " " + bench[0][1], "en", "s0"), (1003, "", "en", "s0"), (1004, None, None, None), (1005, rows[4][1], "en", "s1"), (1005, rows[4][1], "en", "s1"), (None, "no id here", "en", "s1")]
    docs = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, bench


def test_the_pipeline_is_its_stages_by_brute_force(spark, folder):
    d, bench = folder
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.words)) for r in c.run(spark, d).collect())
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    # 1: documents whose score, by the definition of the machine, is under a half
    verdict = {}
    for r in quality.classify(docs, labels).collect():
        verdict.setdefault(r.doc_id, r.kept)
    rows = [r for r in rows if verdict[r[0]]]
    # 2: the smallest id of each group by brute force, once
    group, _ = groups_of([(r[0], r[1]) for r in rows], 0.5)
    seen, left = set(), []
    for r in rows:
        if r[0] is None or (group[r[0]] == r[0] and r[0] not in seen):
            left.append(r)
        seen.add(r[0])
    # 3: what holds no window of an item
    leaking = {a for a, _ in leaks_of([(r[0], r[1]) for r in left], bench, 0.6)}
    left = [r for r in left if r[0] is None or r[0] not in leaking]
    # 4: copies by the rates
    frame = spark.createDataFrame(left, docs.schema)
    rate = {r.doc_id: r.rate for r in mixing.rates(frame, labels, target=c.MIX, budget=None, train_docs=docs).collect()}
    u = {r.doc_id: r.u for r in frame.select("doc_id", (F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("u")).collect()}
    copies = {k: 1 if k is None else math.floor(rate[k] + u[k]) for k in rate}
    # 5: the encoder's ids
    enc = token_ids.encoder(open(token_ids.RANKS, "rb").read(), token_ids.PATTERN)
    want = []
    for r in left:
        ids = np.array(enc.encode_ordinary(r[1] or ""), np.uint64)
        words, *_ = token_ids.encode(ids, np.array([0, len(ids)]))
        want += [(-1 if r[0] is None else r[0], len(ids), words.astype("<u8").tobytes())] * copies[r[0]]
    assert got == sorted(want)
    assert {1000, 1001, 1002} & {g[0] for g in got} == set() and 2 in {r[0] for r in left}


def test_stages_keep_the_columns(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("d", F.lit(2)).withColumn("rate", F.lit(3)).withColumns({x: F.lit(4) for x in ("times", "nth", "lang_text", "again")})
    assert [n for n, _ in c.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "mix", "tokenize"]
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, d).columns == [*COLUMNS, "kept", "d", "rate", "times", "nth", "lang_text", "again"]
        assert stage(spark, docs.limit(0), d).collect() == []
    for m in (decontam, near_dup):
        assert m.__doc__
