import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t


def values(spark, rows, f):
    """f of each string, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keys(spark):
    assert values(spark, [" 10.1/A\t", "", None, " \n"], t.normalize_doi) == ["10.1/a", None, None, None]
    assert values(spark, ["  Deep\tLearning: a  Study! ", None, "Ñandú"], t.normalize_title) == ["deep learning a study", "", "and"]
    assert values(spark, ["A b-C 1", None, "Привет"], t.identity_key) == ["abc1", "", ""]


def java(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hash(spark):
    rows = ["abc", "", "thequickbrownfoxjumpsoverthelazydog", "zzzzzzzzzz"]
    assert values(spark, rows, t.java_string_hash) == [java(x) for x in rows] and java("abc") == 96354


def test_lists(spark):
    assert values(spark, ["a;b;;", ";a", ";;", "", "  ", None, "a;;b", " a ;b"], t.parse_list) == [["a", "b"], ["", "a"], [], [], [], [], ["a", "", "b"], [" a ", "b"]]
    assert values(spark, ["[a, b ,,c]", "x"], t.parse_id_list) == [["a", "b", "c"], ["x"]]


def test_numbers_dates_sources(spark):
    assert values(spark, [" 2024 ", "2024.0", "", None, "x", "+7", "-3", "99999999999"], t.parse_int) == [2024, None, None, None, None, 7, -3, None]
    d = datetime.date
    assert values(spark, ["2024-01-05", "2024-1-5", "2024", "2024-02-30", "2023-02-29", "2024-04-31", "2024-13-01", None], t.parse_date) == [d(2024, 1, 5), None, None, d(2024, 2, 29), d(2023, 2, 28), d(2024, 4, 30), None, None]
    assert values(spark, ["dblp", "OpenAlex", "scopus", "", None, " dblp"], t.parse_source) == ["DBLP", "OPENALEX", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_venues(spark):
    rows = ["ICML", "Proceedings of X", "NeurIPS", "Nature", None, "aclove", "the ACL."]
    assert values(spark, rows, t.is_conference) == [True, True, False, False, False, False, True]
    assert values(spark, rows, lambda c: t.is_conference(c, ("neurips",)))[2]


def test_similarities(spark):
    rows = [("a b c", "c b a", 1.0), ("a b", "a c", 1 / 3), ("!!", "!!", 1.0), ("!!", "?", 0.0), (None, "a", 0.0), ("", "", 1.0), ("A-b", "ab", 1.0)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i")
    got = [r.j for r in df.select(t.jaccard(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got == pytest.approx([r[2] for r in rows])
    assert [r.j for r in df.select(t.jaccard(F.col("b"), F.col("a")).alias("j")).collect()] == got
    lev = [r.x for r in spark.createDataFrame([("kitten", "sitting"), ("é", "e"), ("", ""), (None, "a"), ("", "ab")], "a string, b string").select(t.levenshtein_similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert lev == pytest.approx([1 - 3 / 7, 0, 1, 0, 0])


def test_maps_and_lines(spark):
    df = spark.createDataFrame([({"a": "1"}, "a", "2"), (None, "b", "3"), ({"a": "1"}, None, "4")], "m map<string,string>, k string, v string")
    assert [r.x for r in df.select(t.put_field(F.col("m"), F.col("k"), F.col("v")).alias("x")).collect()] == [{"a": "2"}, {"b": "3"}, {"a": "1"}]
    assert [r.x for r in df.select(t.fields_or_empty(F.col("m")).alias("x")).collect()] == [{"a": "1"}, {}, {"a": "1"}]
    r = spark.createDataFrame([("T", ["A", "B"], 2024, "OPENALEX"), (None, None, 0, None)], "t string, a array<string>, y int, s string")
    assert [x.x for x in r.select(t.record_text(F.col("t"), F.col("a"), F.col("y"), t.display_name(F.col("s"))).alias("x")).collect()] == ["A, B (2024). T [OpenAlex]", "- (0). - [-]"]
