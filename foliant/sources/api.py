"""Search APIs as a Spark data source: ``spark.read.format("bib_api")``, one row per page of JSON.

Options: ``source`` (dblp, openalex), ``query``, ``max`` (rows; default 1000), ``concepts``
(comma-separated ids, openalex), ``from_date``, ``to_date``, ``mailto``, ``fallback_query``, ``fetcher``
(``module:function`` of a URL, giving the page's text; default HTTP), ``pause`` (seconds between requests).
"""

from __future__ import annotations

import importlib
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BASES = {"dblp": "https://dblp.org/search/publ/api", "openalex": "https://api.openalex.org/works"}
PAGE = {"dblp": 1000, "openalex": 200}
STRIDE = 1 << 16


def http(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:
        return r.read().decode("utf-8", "replace")


def fetcher(options: dict[str, str]) -> Callable[[str], str]:
    if "fetcher" not in options:
        return http
    module, _, name = options["fetcher"].partition(":")
    return getattr(importlib.import_module(module), name)


def concepts_of(text: str | None) -> list[str]:
    return [c for c in (x.strip() for x in (text or "").replace("[", "").replace("]", "").split(",")) if c]


def dblp_url(query: str, rows: int, offset: int) -> str:
    return BASES["dblp"] + "?" + urllib.parse.urlencode({"q": query, "format": "json", "h": rows, "f": offset})


def openalex_url(rows: int, page: int, concept: str | None = None, search: str | None = None, from_date: str | None = None, to_date: str | None = None, mailto: str | None = None) -> str:
    filters = [f"{k}:{x}" for k, x in (("concepts.id", concept), ("from_publication_date", from_date), ("to_publication_date", to_date)) if x]
    args = {"filter": ",".join(filters), "search": search, "per_page": rows, "page": page, "mailto": mailto}
    return BASES["openalex"] + "?" + urllib.parse.urlencode({k: x for k, x in args.items() if x}, safe=":,")


def count_items(source: str, body: str) -> int:
    import json

    try:
        x = json.loads(body)
        items = x["result"]["hits"]["hit"] if source == "dblp" else x["results"]
        return len(items) if isinstance(items, list) else 0
    except (ValueError, KeyError, TypeError):
        return 0


class Scan(InputPartition):
    """One query whose pages follow each other: they end with an empty page, an error or enough rows."""

    def __init__(self, nth: int, concept: str | None, search: str | None, most: int) -> None:
        self.nth, self.concept, self.search, self.most = nth, concept, search, most


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.source = options.get("source", "dblp").lower()
        if self.source not in BASES:
            raise ValueError(f"no such API: {self.source}")

    def partitions(self) -> list[Scan]:
        most = int(self.options.get("max", 1000))
        if self.source == "dblp":
            return [Scan(0, None, self.options.get("query", ""), most)]
        concepts = concepts_of(self.options.get("concepts"))
        most = most if most > 0 else 1000
        if not concepts:
            return [Scan(0, None, self.options.get("query") or self.options.get("fallback_query", "artificial intelligence"), most)]
        each = max(100, most // len(concepts))
        return [Scan(k, c, None, each) for k, c in enumerate(concepts)]

    def read(self, scan: Scan) -> Iterator[tuple]:
        fetch, pause = fetcher(self.options), float(self.options.get("pause", 0.1))
        rows, seen, page = min(scan.most, PAGE[self.source]), 0, 0
        while seen < scan.most:
            if self.source == "dblp":
                url = dblp_url(scan.search or "", rows, page * rows)
            else:
                url = openalex_url(rows, page + 1, scan.concept, scan.search, *(self.options.get(k) for k in ("from_date", "to_date", "mailto")))
            try:
                body = fetch(url)
            except Exception:  # a page that fails ends its scan with what there is
                return
            n = count_items(self.source, body or "")
            if not n:
                return
            yield self.source, scan.concept, scan.nth * STRIDE + page, body
            seen, page = seen + n, page + 1
            time.sleep(pause)


class BibApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bib_api"

    def schema(self) -> str:
        return "source string, concept string, page_ord long, body string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def pages(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(BibApi)
    return spark.read.format("bib_api").options(**{k: str(x) for k, x in options.items() if x is not None}).load()


def available(source: str, **options: str) -> bool:
    """Whether a request for one row gives a text."""
    url = dblp_url("test", 1, 0) if source.lower() == "dblp" else openalex_url(1, 1)
    try:
        return bool((fetcher(options)(url) or "").strip())
    except Exception:
        return False
