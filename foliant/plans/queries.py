"""Queries over the driver's tables, by name."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import text as t, variant as v
from foliant.operators import analytics, dedup, similarity, sorting
from foliant.sources import api, records as io, shapes

from . import literals
from .views import author_pairs, records, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keyed(records(spark, sf_dir))


def _unified(spark: SparkSession, sf_dir: str, semantics: str = "compat", keys: bool = True) -> dedup.Unified:
    """Over keyed records without the texts that no later step reads; persisted, as they are read many times.
    Without ``keys``, which no result then shows, long ones are shuffled and kept as digests."""
    k = _keyed(spark, sf_dir).select("ord", "doi_key", "title_key", "ident", "score", "source")
    k = (k if keys else dedup.shortened(k)).persist()
    m = dedup.members(k, semantics).persist()
    u = dedup.unique(k, m, semantics)
    return dedup.Unified(k, m, u, dedup.stats(k, m, u))


@query
def normalize_doi(spark, sf_dir):
    return records(spark, sf_dir).select("ord", t.normalize_doi(F.col("doi")).alias("doi_key"))


@query
def normalize_title(spark, sf_dir):
    return records(spark, sf_dir).select("ord", t.normalize_title(F.col("title")).alias("title_key"))


@query
def identity_key(spark, sf_dir):
    return records(spark, sf_dir).select("ord", t.identity_key(F.col("title")).alias("ident"))


@query
def java_string_hash(spark, sf_dir):
    return records(spark, sf_dir).select("ord", t.java_string_hash(t.identity_key(F.col("title"))).alias("hash"))


@query
def doi_groups(spark, sf_dir):
    return dedup.doi_groups(_keyed(spark, sf_dir)).select("key", "n", "first")


@query
def title_groups(spark, sf_dir):
    return dedup.title_groups(_keyed(spark, sf_dir)).select("key", "n", "first")


@query
def duplicate_members(spark, sf_dir):
    return _unified(spark, sf_dir).members.select("kind", "key", "n", "label", "ord")


@query
def duplicate_members_strict(spark, sf_dir):
    return _unified(spark, sf_dir, "strict").members.select("kind", "key", "n", "label", "ord")


@query
def completeness_score(spark, sf_dir):
    return _keyed(spark, sf_dir).select("ord", "score")


@query
def best_record(spark, sf_dir):
    return dedup.best(_unified(spark, sf_dir).members)


@query
def unique_records(spark, sf_dir):
    return _unified(spark, sf_dir, keys=False).unique.select("ord", "source", "score")


@query
def unique_records_strict(spark, sf_dir):
    return _unified(spark, sf_dir, "strict", keys=False).unique.select("ord", "source", "score")


@query
def dedup_stats(spark, sf_dir):
    return _unified(spark, sf_dir, keys=False).stats


@query
def union_sources(spark, sf_dir):
    r = records(spark, sf_dir).select("ord", "id", "source")
    return io.union_sources([r.where(F.col("source") == s) for s in ("DBLP", "OPENALEX")])


@query
def source_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query
def id_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    r = p.select(
        F.col("page_id").alias("ord"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.regexp_extract("url", "://([^/]+)/", 1)).alias("id"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("title"),
        F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Ann  A"))).alias("authors"), F.when(F.col("page_id") % 4 == 1, "Abstract available").alias("abstract_text"),
    )
    return dedup.distinct_by_id(r).select("ord", "place")


@query
def author_frequency(spark, sf_dir):
    return analytics.author_counts(author_pairs(spark, sf_dir))


@query
def top_authors(spark, sf_dir):
    return analytics.top_authors(author_pairs(spark, sf_dir))


@query
def top_authors_of_unique(spark, sf_dir):
    chosen = _unified(spark, sf_dir, keys=False).unique.select("ord")
    return analytics.top_authors(records(spark, sf_dir).join(chosen, "ord", "left_semi"))


@query
def sort_year_title(spark, sf_dir):
    r = records(spark, sf_dir).select("ord", "year", F.lower("title").alias("low"))
    return analytics.positioned(r, "year", "low", "ord").select("pos", "ord", "year")


@query
def conference_classifier(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("venue")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct().union(literals.frame(spark, literals.VENUES, "venue string"))
    return p.select("venue", t.is_conference(F.col("venue")).alias("plain"), t.is_conference(F.col("venue"), ("neurips",)).alias("extended"))


@query
def list_parse_join(spark, sf_dir):
    df = literals.frame(spark, literals.LISTS, "raw string")
    items = t.parse_list(F.col("raw"))
    return df.select("raw", F.size(items).alias("n"), t.join_list(items).alias("joined"))


@query
def date_int_source_parse(spark, sf_dir):
    df = literals.frame(spark, literals.CELLS, "d string, y string, s string")
    return df.select("d", "y", "s", F.date_format(t.parse_date(F.col("d")), "yyyy-MM-dd").alias("day"), t.parse_int(F.col("y")).alias("year"), t.parse_source(F.col("s")).alias("source"))


@query
def id_list_parse(spark, sf_dir):
    return literals.frame(spark, literals.ID_LISTS, "raw string").select("raw", F.array_join(t.parse_id_list(F.col("raw")), "|").alias("ids"))


@query
def json_path_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("x"))
    k = v.at(F.col("x"), "$.k")
    return e.select("event_id", v.as_text(k).alias("text"), v.as_text(v.at(F.col("x"), "$.none")).alias("missing"), v.text_value(k).alias("value"))


@query
def json_text_kinds(spark, sf_dir):
    df = literals.frame(spark, literals.JSON, "body string").withColumn("x", v.at(F.try_parse_json("body"), "$.a"))
    return df.select("body", v.as_text(F.col("x")).alias("text"), v.text_value(F.col("x")).alias("value"), v.text_or_null(F.col("x")).alias("strict"))


def _shaped(df: DataFrame) -> DataFrame:
    return df.select("id", "title", t.join_list(F.col("authors")).alias("authors"), "year", "journal", "conference", "doi", "url", "abstract_text", "document_type", "citation_count", "source")


@query
def dblp_shape(spark, sf_dir):
    return _shaped(shapes.dblp_records(literals.frame(spark, [(literals.DBLP_PAGE,)], "body string")))


@query
def dblp_shape_strict(spark, sf_dir):
    return _shaped(shapes.dblp_records(literals.frame(spark, [(literals.DBLP_PAGE,)], "body string"), "strict"))


@query
def openalex_shape(spark, sf_dir):
    return _shaped(shapes.openalex_records(literals.frame(spark, [(literals.OPENALEX_PAGE,)], "body string")))


@query
def openalex_shape_strict(spark, sf_dir):
    return _shaped(shapes.openalex_records(literals.frame(spark, [(literals.OPENALEX_PAGE,)], "body string"), "strict"))


def _scanned(spark: SparkSession, **options: str) -> DataFrame:
    pages = api.pages(spark, fetcher="foliant.plans.literals:offline", pause=0, **options)
    found = shapes.dblp_records(pages) if options["source"] == "dblp" else shapes.openalex_records(pages)
    return found.select("id", "title", "year", "doi", "source")


@query
def dblp_scan(spark, sf_dir):
    return _scanned(spark, source="dblp", query="generative ai", max=2500)


@query
def openalex_concept_scan(spark, sf_dir):
    return _scanned(spark, source="openalex", query="not asked for", concepts="[C1, C2]", max=1000)


@query
def openalex_text_scan(spark, sf_dir):
    return _scanned(spark, source="openalex", query="generative ai", max=500)


@query
def sample_records(spark, sf_dir):
    return _shaped(io.union_sources([io.samples(spark, s) for s in ("DBLP", "OPENALEX")]))


@query
def jaccard_pairs(spark, sf_dir):
    return similarity.jaccard_pairs(records(spark, sf_dir))


@query
def similar_pairs(spark, sf_dir):
    return similarity.all_pairs(_keyed(spark, sf_dir))


@query
def similar_to_target(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    target = k.where("ord = 1").select("title", "doi").first()
    return similarity.similar_to(k, F.lit(target.title), F.lit(target.doi)).select("ord")


@query
def levenshtein_pairs(spark, sf_dir):
    return similarity.levenshtein_pairs(table(spark, sf_dir, "part"), "p_name", 0.5)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("value"))


def _sort_query(name: str) -> Query:
    def run(spark, sf_dir):
        return analytics.placed(sorting.sort_by(_keys(spark, sf_dir), name)).select("pos", "value")

    return run


QUERIES |= {f"sort_{name}": _sort_query(name) for name in sorting.STRATEGIES}


@query
def distinct_sort(spark, sf_dir):
    return analytics.placed(sorting.distinct_sorted(_keys(spark, sf_dir))).select("pos", "value")


@query
def value_histogram(spark, sf_dir):
    return sorting.histogram(_keys(spark, sf_dir))


@query
def min_max(spark, sf_dir):
    return _keys(spark, sf_dir).agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query
def digit_prefix_sum(spark, sf_dir):
    return sorting.digit_starts(_keys(spark, sf_dir), 10)


@query
def bench_report(spark, sf_dir):
    return analytics.benchmark_report(literals.frame(spark, literals.TIMES, "method string, size string, time_ms string"), 50_000).select("method", "size", "time_ms")


@query
def bench_sizes(spark, sf_dir):
    return analytics.sizes_present(literals.frame(spark, literals.TIMES, "method string, size string, time_ms string"))


@query
def bar_heights(spark, sf_dir):
    return analytics.bar_heights(analytics.top_authors(author_pairs(spark, sf_dir)), "appearances")


@query
def percentage_text(spark, sf_dir):
    return dedup_stats(spark, sf_dir).select(F.format_string("%.2f%%", "duplicate_percentage").alias("text"))


@query
def csv_roundtrip(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="foliant-csv-") if not (shared := spark.conf.get("spark.checkpoint.dir", None)) else f"{shared}/csv-{os.urandom(8).hex()}"
    io.write_csv(io.csv_rows(records(spark, sf_dir)), f"{folder}/records", single=False)
    return io.csv_rows(io.read_csv(spark, f"{folder}/records"))
