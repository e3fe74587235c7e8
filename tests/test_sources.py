import json

import pytest

from foliant.operators import analytics, dedup, similarity
from foliant.plans import literals, run
from foliant.plans.queries import QUERIES
from foliant.schema import RECORD_DDL, as_records
from foliant.sources import api, charts, records, shapes
from foliant.streaming import running_author_counts, stream_csv

CALLS = []


def fake(url):
    """Two full pages, then an empty one; the second concept fails."""
    CALLS.append(url)
    if "broken" in url or "C2" in url:
        raise OSError("no")
    if "dblp" in url:
        page = int(url.split("f=")[1])
        return literals.DBLP_PAGE if page < 10 else "{}"
    return literals.OPENALEX_PAGE if url.endswith("page=1") else '{"results": []}'


FETCH = "tests.test_sources:fake"


def test_dblp_scan(spark):
    reader = api.PageReader({"source": "dblp", "query": "gen ai", "max": "5", "fetcher": FETCH, "pause": "0"})
    got = list(reader.read(reader.partitions()[0]))
    assert len(got) == 1 and got[0][0] == "dblp"
    assert api.dblp_url("a b", 5, 10).endswith("?q=a+b&format=json&h=5&f=10")
    empty = api.PageReader({"source": "dblp", "max": "0", "fetcher": FETCH})
    assert list(empty.read(empty.partitions()[0])) == []


def test_openalex_partitions():
    reader = api.PageReader({"source": "openalex", "concepts": "[C1, C2]", "max": "1000", "query": "ignored"})
    assert [(s.concept, s.search, s.most) for s in reader.partitions()] == [("C1", None, 500), ("C2", None, 500)]
    assert [(s.concept, s.search) for s in api.PageReader({"source": "openalex"}).partitions()] == [(None, "artificial intelligence")]
    url = api.openalex_url(200, 2, "C1", None, "2018-01-01", "2025-12-31", "a@b.c")
    assert "filter=concepts.id:C1,from_publication_date:2018-01-01,to_publication_date:2025-12-31" in url and "per_page=200&page=2" in url
    with pytest.raises(ValueError):
        api.PageReader({"source": "scopus"})


def test_data_source_and_shapes(spark):
    pages = api.pages(spark, source="openalex", concepts="C1,C2", max=200, fetcher=FETCH, pause=0)
    got = shapes.openalex_records(pages).orderBy("ord").collect()
    assert [r.id for r in got] == ["W1", "W2", "W3", "W4"]  # what fails gives no page
    assert (got[1].doi, got[1].url, got[3].title) == ("null", "null", "null")
    assert (got[0].conference, got[2].journal, got[0].abstract_text, got[1].abstract_text) == ("NeurIPS", "null", "Abstract available", None)
    strict = shapes.openalex_records(pages, "strict").collect()
    assert [(r.id, r.doi) for r in strict] == [("W1", "10.1/a"), ("W2", None), ("W3", None)]
    odd = spark.createDataFrame([("no json",), ('{"results": {"a": 1}}',), (None,), ('{"results": [1, null]}',)], "body string")
    assert shapes.openalex_records(odd).collect() == [] and shapes.dblp_records(odd).collect() == []


def test_authors_given_as_an_object(spark):
    pages = spark.createDataFrame([(literals.DBLP_PAGE,)], "body string")
    assert {r.id: r.authors for r in shapes.dblp_records(pages).collect()} == {"k1": ["Ann A", "Bo B 0001"], "k2": [], "k3": ["Plain"]}
    assert {r.id: r.authors for r in shapes.dblp_records(pages, "strict").collect()}["k2"] == ["Solo"]


def test_router(spark, tmp_path):
    assert api.available("dblp", fetcher=FETCH) and not api.available("dblp", fetcher="tests.nothing:f")
    assert records.from_source(spark, "DBLP", fetcher="tests.nothing:f").collect() == []  # not available: nothing
    assert [r.id for r in records.from_source(spark, "DBLP", query="q", max="3", fetcher=FETCH, pause="0").orderBy("ord").collect()] == ["k1", "k2", "k3"]
    assert [r.id for r in records.from_source(spark, "scopus", str(tmp_path)).orderBy("ord").collect()] == ["SCOPUS_sample_1", "SCOPUS_sample_2"]
    (tmp_path / "unknown_source.csv").write_text('ID,Title,Year,Source\nx,"A, ""quoted""\ntitle", 2024 ,dblp\ny,No year,,dblp\nz,Bad,2024.0,dblp\n')
    got = records.from_source(spark, "scopus", str(tmp_path)).collect()
    assert [(r.id, r.title, r.year, r.source, r.doi, r.authors) for r in got] == [("x", 'A, "quoted"\ntitle', 2024, "DBLP", "", [])]


def test_csv_round_trip_in_one_file(spark, tmp_path):
    r = records.samples(spark, "DBLP")
    records.write_csv(records.csv_rows(r), str(tmp_path / "out.csv"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.csv"]
    back = records.read_csv(spark, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, records.csv_rows(back).collect())) == sorted(map(tuple, records.csv_rows(r).collect()))


def test_a_whole_run(spark, tmp_path):
    frames = [records.samples(spark, s) for s in ("DBLP", "OPENALEX")]
    result = run.process(spark, frames, str(tmp_path / "out"))
    assert result.status == "COMPLETED" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["resultados_duplicados.csv", "resultados_unificados.csv", "top_authors.csv"]
    s = result.stats.first()
    assert (s.total_records, s.unique_records, s.duplicates_found, s.duplicate_percentage) == (4, 2, 4, 100.0)
    assert "duplicates in percent: 100.00%" in charts.report(result.stats)
    assert run.process(spark, [as_records(spark.createDataFrame([], "ord long"))], str(tmp_path / "none")).message == "no records"
    assert run.process(spark, [spark.range(1)]).status == "FAILED"
    text = charts.report(result.stats, result.status, result.started, result.ended, analytics.top_authors(result.unique), spark.createDataFrame([("radix", 1.25)], "method string, time_ms double"))
    assert "seconds: " in text and "1. Brown, A.: 1" in text and "radix: 1.2500 ms" in text
    assert (tmp_path / "out/top_authors.csv").read_text().splitlines()[0] == "Autor,Apariciones"
    result.release()
    with pytest.raises(run.DataProcessingError):
        run.process(spark, frames, semantics="other")


def test_charts(spark):
    times = literals.frame(spark, literals.TIMES, "method string, size string, time_ms string")
    svg = charts.benchmark_chart(times, 50000)
    assert svg.count("<rect") == 12 and 'height="480"' in svg and charts.benchmark_chart(times, 7) == "no timings of size 7"
    none = spark.createDataFrame([("a", 0)], "author string, n int")
    assert analytics.bar_heights(none, "n").first().bar == 0
    assert "<svg" in charts.svg_bars(none.limit(0), "author", "n", "x < y")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    records.write_csv(records.csv_rows(records.samples(spark, "DBLP")), str(tmp_path / "in/a.csv"))
    q = running_author_counts(stream_csv(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("authors_now").start()
    q.processAllAvailable()
    q.stop()
    assert {r.author: r.appearances for r in spark.table("authors_now").collect()} == {"Smith, J.": 1, "Johnson, M.": 1, "Brown, A.": 1, "Davis, K.": 1}


def test_pair_joins_have_no_nested_loop(spark):
    k = dedup.keyed(records.samples(spark, "DBLP"))
    plan = similarity.all_pairs(k)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    top = analytics.top_authors(records.samples(spark, "DBLP"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_pairs_match_brute_force(spark):
    titles = ["a b c d e f g", "g f e d c b a", "a b c d e f h", "a b c d e f g h", "x", "x", None, "!!", "!!", "A b, c d e f g"]
    rows = [(i, x) for i, x in enumerate(titles)]
    got = sorted((r.a, r.b) for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "ord long, title string")).collect())
    sets = [set((x or "").lower().replace(",", "").replace("!!", "").split()) for x in titles]
    want = [(i, j) for i in range(10) for j in range(i + 1, 10) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert {"dedup_stats", "sort_radix", "jaccard_pairs"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1 and set(QUERIES) <= set(e.queries())
    assert "ord long" in RECORD_DDL and json.loads(literals.DBLP_PAGE)


def test_a_failed_scan_falls_back_to_files(spark, tmp_path):
    (tmp_path / "dblp_generative_ai.csv").write_text("ID,Title,Year,Source\nx,From a file,2024,dblp\n")
    with pytest.warns(UserWarning, match="come from files"):
        got = records.from_source(spark, "DBLP", str(tmp_path), query="q", max="many", fetcher=FETCH, pause="0")
    assert [r.title for r in got.collect()] == ["From a file"]


def test_times_files(spark, tmp_path):
    (tmp_path / "new.csv").write_text("M,C,T,ns,ms\nTim,O(n log n),50000,2274100,2.274\nBad,O(1),x,,n/a\n")
    got = records.read_times(spark, str(tmp_path / "new.csv"))
    assert [tuple(r) for r in got.collect()] == [("Tim", "O(n log n)", 50000, 2274100, 2.274), ("Bad", "O(1)", None, None, None)]
    (tmp_path / "old.csv").write_text("Metodo,Tamano,Tiempo\nTim,5000,2,0282\nComb,5000,2.5\n")
    assert [tuple(r) for r in records.read_legacy_times(spark, str(tmp_path / "old.csv")).collect()] == [("Tim", 5000, 2.0282), ("Comb", 5000, 2.5)]
    records.write_times(got, str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text().splitlines()[1] == "Tim,50000,2.274"
    assert charts.save_benchmark_chart(got, 50000, str(tmp_path)).endswith("benchmark_general_50000.svg") and (tmp_path / "benchmark_general_50000.svg").exists()
    assert charts.save_benchmark_chart(got, 7, str(tmp_path)) is None
