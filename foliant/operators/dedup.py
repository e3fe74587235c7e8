"""Duplicate groups by DOI, then by title; the best record of each; unique records; statistics.

``compat`` semantics: records are equal if their identity keys (titles) are; the title pass leaves
out every record equal to one with a DOI, and unique records leave out every record equal to one
in a group.  ``strict``: only the record itself is meant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from foliant.functions import text as t


def keyed(records: DataFrame) -> DataFrame:
    """Records with doi_key, title_key, ident and score."""
    c = F.col
    return records.withColumns({
        "doi_key": t.normalize_doi(c("doi")),
        "title_key": t.normalize_title(c("title")),
        "ident": t.identity_key(c("title")),
        "score": t.completeness(c("title"), c("authors"), c("abstract_text"), c("keywords"), c("journal"), c("doi"), c("conference"), c("url")),
    })


#: Characters from which on a key is shortened.
SHORT = 64


def shortened(k: DataFrame) -> DataFrame:
    """Keyed records whose long title keys and identities are SHA-256 digests, for results that don't show them: only
    which are equal, or empty, counts.  Keys hold no ``#``, so a digest equals no short key."""
    short = lambda c: F.when(F.length(c) <= SHORT, F.col(c)).otherwise(F.concat(F.lit("#"), F.sha2(F.col(c), 256)))
    return k.withColumns({c: short(c) for c in ("title_key", "ident")})


def _identity(semantics: str) -> str:
    if semantics not in ("compat", "strict"):
        raise ValueError("semantics is compat or strict")
    return "ident" if semantics == "compat" else "ord"


def _groups(k: DataFrame, key: str, kind: str) -> DataFrame:
    """(kind, key, n, first): groups of two and more."""
    return k.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).where("n > 1").select(F.lit(kind).alias("kind"), "key", "n", "first")


def doi_groups(k: DataFrame) -> DataFrame:
    return _groups(k.where("doi_key is not null"), "doi_key", "doi")


def left_for_titles(k: DataFrame, semantics: str = "compat") -> DataFrame:
    """Records that the title pass looks at."""
    if semantics == "strict":
        return k.where("doi_key is null and title_key <> ''")
    with_doi = k.where("doi_key is not null").select(_identity(semantics)).distinct()
    return k.join(with_doi, _identity(semantics), "left_anti").where("title_key <> ''")


def title_groups(k: DataFrame, semantics: str = "compat") -> DataFrame:
    return _groups(left_for_titles(k, semantics), "title_key", "title")


def members(k: DataFrame, semantics: str = "compat") -> DataFrame:
    """Every record of every group, with kind, key, n and label (kind and the first member's place)."""
    by_doi = k.join(doi_groups(k), k.doi_key == F.col("key")).select(k["*"], "kind", "key", "n", "first")
    rest = left_for_titles(k, semantics)
    by_title = rest.join(title_groups(k, semantics), rest.title_key == F.col("key")).select(*[rest[c] for c in k.columns], "kind", "key", "n", "first")
    return by_doi.unionByName(by_title).withColumn("label", F.concat("kind", F.lit("_group_"), "first"))


def best(m: DataFrame) -> DataFrame:
    """(kind, key, ord): the member of the highest score, the first of equals."""
    return m.groupBy("kind", "key").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("ord"))


def unique(k: DataFrame, m: DataFrame, semantics: str = "compat") -> DataFrame:
    """The best of each group, and all records that are equal to no member."""
    chosen = k.join(best(m).select("ord"), "ord", "left_semi")
    return chosen.unionByName(k.join(m.select(_identity(semantics)).distinct(), _identity(semantics), "left_anti").select(*k.columns))


def stats(k: DataFrame, m: DataFrame, u: DataFrame) -> DataFrame:
    """One row: records, unique ones, members of groups, records by source, members in percent."""
    total = k.agg(F.count("*").alias("total_records"), F.count_if(F.col("source") == "DBLP").alias("dblp_records"), F.count_if(F.col("source") == "OPENALEX").alias("openalex_records"))
    return (
        total.crossJoin(u.agg(F.count("*").alias("unique_records")))
        .crossJoin(m.agg(F.count("*").alias("duplicates_found")))
        .withColumn("duplicate_percentage", F.coalesce(F.col("duplicates_found") / F.nullif(F.col("total_records"), F.lit(0)) * 100, F.lit(0.0)))
    )


def distinct_by_id(records: DataFrame) -> DataFrame:
    """One record of each id: the first with an abstract, else the first.  Without an id: the first of
    each title and first author.  ``place``: where the key came first, the order of the result."""
    from pyspark.sql import Window

    author = F.coalesce(F.get("authors", F.lit(0)), F.lit("unknown"))
    other = F.regexp_replace(F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("_"), author)), r"\s+", "_")
    no_id = t.is_blank(F.col("id"))
    w = Window.partitionBy("by_id", "key")
    r = records.withColumns({"by_id": ~no_id, "key": F.when(no_id, other).otherwise(F.col("id"))})
    rank = F.row_number().over(w.orderBy(F.when(F.col("by_id"), t.is_blank(F.col("abstract_text")).cast("int")).otherwise(0), "ord"))
    return r.withColumns({"rank": rank, "place": F.min("ord").over(w)}).where("rank = 1").select(*records.columns, "place")


@dataclass
class Unified:
    """All frames of one run over the same persisted records."""

    keyed: DataFrame
    members: DataFrame
    unique: DataFrame
    stats: DataFrame


def unify(records: DataFrame, semantics: str = "compat") -> Unified:
    k = keyed(records)
    m = members(k, semantics)
    u = unique(k, m, semantics)
    return Unified(k, m, u, stats(k, m, u))
