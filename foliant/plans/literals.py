"""Small inputs of queries that no table of the driver has."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

VENUES = [(x,) for x in ("NeurIPS", "ICML", "Journal of ICML Studies", "An aclove paper", "Workshop on X", "ACL", "nature", "", "Symposium", "(iclr)", "PROCEEDINGS of Y")] + [(None,)]
LISTS = [(x,) for x in ("a;b;;", ";a", ";;", "", "  ", "a", " a ; b ", "a;;b", "x;y;z")] + [(None,)]
ID_LISTS = [(x,) for x in ("[C1, C2 ,,C3]", "C9", "[]", "", " C1 ,C2")]
CELLS = [
    ("2024-01-05", "2024", "dblp"), ("2024-1-5", " 2023 ", "scopus"), ("2024", "2024.0", "OPENALEX"), ("2024-02-30", "x", ""), ("2024-04-31", "+7", " dblp"), ("2023-02-29", "-3", "Unknown"),
    ("2024-13-01", "99999999999", "openalex"), ("2024-00-10", "", None), ("2024-12-31", "\t12", "DBLP"), (" 2024-01-05", "1 2", "x"), (None, None, "dblp"),
]
JSON = [(x,) for x in ('{"a":"s"}', '{"a":null}', "{}", '{"a":5}', '{"a":{"text":"in"}}', '{"a":{"text":7}}', '{"a":{"b":1}}', '{"a":["x"]}', '{"a":true}', '{"a":""}', "no json")]
DBLP_PAGE = json.dumps({"result": {"hits": {"hit": [
    {"info": {"key": "k1", "title": "A Study.", "year": "2024", "venue": "ICML", "doi": "10.1/A", "ee": "https://e/1", "type": "Conference and Workshop Papers", "authors": {"author": [{"text": "Ann A"}, {"text": ""}, {"text": "Bo B 0001"}]}}},
    {"info": {"key": "k2", "title": {"text": "Object title"}, "year": "n/a", "venue": ["A", "B"], "authors": {"author": {"text": "Solo"}}}},
    {"info": {"key": "k3", "title": "String author", "authors": {"author": "Plain"}}},
    {"info": {"key": "k4", "title": "   "}},
    {"info": {"key": "k5", "year": "2020"}},
]}}})
OPENALEX_PAGE = json.dumps({"results": [
    {"id": "W1", "display_name": "T1", "publication_year": 2024, "doi": "https://doi.org/10.1/a", "type": "article", "cited_by_count": 3, "authorships": [{"author": {"display_name": "Ann A"}}],
     "primary_location": {"landing_page_url": "https://l/1", "source": {"display_name": "NeurIPS"}}, "open_access": {"oa_url": "https://o/1"}, "abstract_inverted_index": {"x": [0]}},
    {"id": "W2", "display_name": "T2", "doi": None, "primary_location": None, "open_access": {"oa_url": None}, "abstract_inverted_index": None},
    {"id": "W3", "display_name": "T3", "primary_location": {"landing_page_url": "https://l/3", "source": {"display_name": None}}},
    {"id": "W4", "display_name": None},
    {"id": "W5", "display_name": ""},
]})
#: What ``offline`` has: 2,300 hits of one API, 650 works of each concept or search of the other.
HITS, WORKS = 2300, 650


def offline(url: str) -> str:
    """A page of either API, made up from its URL: for scans without a network."""
    q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
    if "dblp" in url:
        rows = range(int(q["f"]), min(HITS, int(q["f"]) + int(q["h"])))
        return json.dumps({"result": {"hits": {"hit": [{"info": {"key": f"{q['q']}/{i}", "title": f"Hit {i}.", "year": str(2000 + i % 25), "doi": f"10.1/{i}"}} for i in rows]}}})
    n, page = int(q["per_page"]), int(q["page"])
    what = q.get("filter", "").removeprefix("concepts.id:") or q.get("search", "")
    rows = range((page - 1) * n, min(WORKS, page * n))
    return json.dumps({"results": [{"id": f"{what}/{i}", "display_name": f"Work {i}", "publication_year": 2000 + i % 25, "doi": f"https://doi.org/10.2/{i}"} for i in rows]})


#: Milliseconds of twelve sorts, as text; with rows that the report passes over.
TIMES = [(m, "50000", x) for m, x in (("Tim", "2.274"), ("Comb", "4.065"), ("Selection", "953.159"), ("Tree", "14.497"), ("Pigeonhole", "2.729"), ("Bucket", "8.741"), ("Quick", "3.089"), ("Heap", "5.201"), ("Bitonic", "13.605"), ("Gnome", "1568.228"), ("Binary Insertion", "63.231"), ("Radix", "3.125"))]
TIMES += [("Tim", "5000", "2.0282"), ("Bad", "50000", "n/a"), ("Zero", "50000", "0"), ("None", "50000", None), ("Odd", "many", "3")]


def frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def sql_values(rows: list[tuple], names: str) -> str:
    """The same rows as a SQL table."""
    quote = lambda x: "null" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) as lit({names})"
