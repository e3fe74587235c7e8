from pyspark.sql import functions as F

from foliant.operators import dedup
from foliant.schema import as_records

COLUMNS = "ord long, id string, title string, authors array<string>, abstract_text string, doi string, source string"


def frame(spark, rows):
    return as_records(spark.createDataFrame(rows, COLUMNS))


def run(spark, rows, semantics="compat"):
    u = dedup.unify(frame(spark, rows), semantics)
    return sorted((r.kind, r.ord) for r in u.members.collect()), sorted(r.ord for r in u.unique.collect()), u.stats.first()


ROWS = [
    (0, "a", "Deep Learning", ["x"], None, "10.1/A", "DBLP"),
    (1, "b", "Deep learning!", ["x"], "abs", " 10.1/a ", "OPENALEX"),
    (2, "c", "Deep-Learning", None, None, None, "OPENALEX"),  # equal to records with a DOI
    (3, "d", "Other", None, None, "", "DBLP"),
    (4, "e", "other", ["y"], None, None, "DBLP"),
    (5, "f", "Alone", None, None, "10.2/z", "DBLP"),
    (6, "g", "alone", None, None, None, "DBLP"),
    (7, "h", None, None, None, None, "UNKNOWN"),
    (8, "i", "", None, None, None, "UNKNOWN"),
]


def test_compat(spark):
    members, unique, stats = run(spark, ROWS)
    assert members == [("doi", 0), ("doi", 1), ("title", 3), ("title", 4)]
    assert unique == [1, 4, 5, 6, 7, 8]
    assert (stats.total_records, stats.unique_records, stats.duplicates_found, stats.dblp_records, stats.openalex_records) == (9, 6, 4, 5, 2)
    assert abs(stats.duplicate_percentage - 400 / 9) < 1e-9


def test_strict(spark):
    members, unique, _ = run(spark, ROWS, "strict")
    assert members == [("doi", 0), ("doi", 1), ("title", 3), ("title", 4)]
    assert unique == [1, 2, 4, 5, 6, 7, 8]


def test_the_text_null_is_a_doi_and_ties_go_to_the_first(spark):
    rows = [(k, str(k), f"T{k}", ["x"] if k else None, None, "null", "OPENALEX") for k in range(5)]
    members, unique, stats = run(spark, rows)
    assert len(members) == 5 and unique == [1] and stats.duplicate_percentage == 100.0


def test_empty(spark):
    members, unique, stats = run(spark, [])
    assert members == unique == [] and stats.duplicate_percentage == 0.0 and stats.total_records == 0


def test_labels_name_the_first_member(spark):
    m = dedup.members(dedup.keyed(frame(spark, ROWS)))
    assert {r.label for r in m.collect()} == {"doi_group_0", "title_group_3"}


def test_distinct_by_id(spark):
    rows = [(0, "W1", "T", ["a"], None, None, ""), (1, "W1", "T", ["a"], "abs", None, ""), (2, "W1", "T", ["a"], "abs", None, ""), (3, "", "Some  Title", ["Ann A"], None, None, ""), (4, None, "some title", ["ann a"], "abs", None, ""), (5, " ", "x", None, None, None, "")]
    got = sorted((r.place, r.ord) for r in dedup.distinct_by_id(frame(spark, rows)).collect())
    assert got == [(0, 1), (3, 3), (5, 5)]


def test_anti_joins_are_equi_joins(spark):
    u = dedup.unify(frame(spark, ROWS).withColumn("pad", F.lit(1)))
    plan = u.unique._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_long_keys_are_shuffled_as_digests(spark):
    long = "word " * 40
    rows = [*ROWS, *((9 + i, str(i), x, None, None, d, "DBLP") for i, (x, d) in enumerate([(long + "a", None), (long + "A!", None), (long + "b", None), (long + "c", "10.3/c"), (long + "c.", None)]))]
    k = dedup.keyed(frame(spark, rows))
    short = dedup.shortened(k)
    assert max(len(r[c]) for r in short.collect() for c in ("title_key", "ident")) <= 65
    for semantics in ("compat", "strict"):
        got = []
        for x in (k, short):
            m = dedup.members(x, semantics)
            u = dedup.unique(x, m, semantics)
            got.append((sorted((r.kind, r.n, r.label, r.ord) for r in m.collect()), sorted(r.ord for r in u.collect()), dedup.stats(x, m, u).first()))
        assert got[0] == got[1]
    assert ("title", 9) in {(r.kind, r.ord) for r in dedup.members(short).collect()}


def test_queries_without_keys_keep_digests(spark, tmp_path):
    from foliant.plans.queries import _unified

    spark.createDataFrame([(1, "long title " * 500, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(_unified(spark, str(tmp_path), keys=False).keyed.first().ident) == 65
    spark.catalog.clearCache()
