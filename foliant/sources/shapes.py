"""Pages of the two search APIs to records, over VARIANT values.

A page frame has ``body`` (JSON text) and, for the order, ``page_ord`` (long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import text as t, variant as v
from foliant.schema import as_records


def _items(pages: DataFrame, path: str) -> DataFrame:
    """(x, ord): the elements of the array under a path; none where it isn't an array or the body is no JSON."""
    found = v.elements(v.at(F.try_parse_json("body"), path))
    order = F.col("page_ord") if "page_ord" in pages.columns else F.lit(0)
    each = pages.select(order.cast("long").alias("p"), F.posexplode(found).alias("i", "x"))
    return each.select("x", (F.col("p") * (1 << 20) + F.col("i")).alias("ord"))


def _venue(df: DataFrame, venue: Column, more: tuple[str, ...]) -> DataFrame:
    named = F.when(~t.is_blank(venue), venue)
    conference = t.is_conference(named, more)
    return df.withColumns({"conference": F.when(conference, named), "journal": F.when(~conference, named)})


def dblp_records(pages: DataFrame, semantics: str = "compat") -> DataFrame:
    """Hits with a title.  A single author given as an object counts in ``strict`` semantics only."""
    info = _items(pages, "$.result.hits.hit").select(v.at(F.col("x"), "$.info").alias("x"), "ord")
    get = lambda path: v.text_value(v.at(F.col("x"), path))
    author = v.at(F.col("x"), "$.authors.author")
    many = F.filter(F.transform(v.elements(author), lambda a: F.try_variant_get(a, "$.text", "string")), lambda a: a != "")
    one = v.text_value(author) if semantics == "strict" else F.when(v.kind(author) == "STRING", F.try_variant_get(author, "$", "string"))
    r = info.select(
        "ord", get("$.key").alias("id"), get("$.title").alias("title"), F.when(v.is_array(author), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.coalesce(t.parse_int(get("$.year")), F.lit(0)).alias("year"), get("$.venue").alias("venue"), get("$.doi").alias("doi"), get("$.ee").alias("url"), get("$.type").alias("document_type"), F.lit("DBLP").alias("source"),
    ).where(~t.is_blank(F.col("title")))
    return as_records(_venue(r, F.col("venue"), ()))


def openalex_records(pages: DataFrame, semantics: str = "compat") -> DataFrame:
    """Works with a title.  In ``compat`` semantics JSON null is the text 'null' and a missing value ''; in ``strict`` both are NULL."""
    works = _items(pages, "$.results")
    read = v.as_text if semantics == "compat" else v.text_or_null
    get = lambda path: read(v.at(F.col("x"), path))
    names = F.transform(v.elements(v.at(F.col("x"), "$.authorships")), lambda a: read(F.try_variant_get(a, "$.author.display_name", "variant")))
    number = lambda path: F.coalesce(F.try_variant_get(F.col("x"), path, "int"), F.lit(0))
    places = v.at(F.col("x"), "$.primary_location").isNotNull(), v.at(F.col("x"), "$.open_access").isNotNull()
    missing = F.lit(None).cast("string")
    landing = F.when(places[0], F.nullif(get("$.primary_location.landing_page_url"), F.lit(""))).otherwise(missing)
    url = F.coalesce(F.nullif(F.when(places[1], get("$.open_access.oa_url")), F.lit("")), landing)
    r = works.select(
        "ord", get("$.id").alias("id"), get("$.display_name").alias("title"), F.filter(names, lambda a: a != "").alias("authors"), number("$.publication_year").alias("year"),
        get("$.primary_location.source.display_name").alias("venue"), t.strip_doi_prefix(get("$.doi")).alias("doi"), url.alias("url"),
        F.when(v.kind(v.at(F.col("x"), "$.abstract_inverted_index")).rlike("^OBJECT<.*:"), "Abstract available").alias("abstract_text"),
        get("$.type").alias("document_type"), number("$.cited_by_count").alias("citation_count"), F.lit("OPENALEX").alias("source"),
    ).where(~t.is_blank(F.col("title")))
    return as_records(_venue(r, F.col("venue"), ("neurips",)))
