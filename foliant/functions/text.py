"""Text expressions of the record model; all stay in the JVM and are safe under ANSI mode.

``compat`` semantics follow a Java implementation to the letter where it is peculiar; the
docstrings say where.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VENUE_WORDS = ("proceedings", "workshop", "symposium", "conference")
VENUE_ACRONYMS = ("aaai", "acl", "cvpr", "eccv", "emnlp", "iccv", "iclr", "icml", "ijcai", "nips")
SOURCES = ("DBLP", "OPENALEX", "UNKNOWN")


def jtrim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends (SQL's trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(jtrim(c)) == 0, F.lit(True))


def normalize_doi(c: Column) -> Column:
    """Trimmed lower case; NULL where there is nothing."""
    t = F.lower(jtrim(c))
    return F.when(F.length(t) > 0, t)


def normalize_title(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between; '' for NULL."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def identity_key(c: Column) -> Column:
    """What makes records equal: the title's ASCII letters and digits, lower-case; '' for NULL."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9]", "")


def java_string_hash(c: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of an ASCII string, signed."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + F.ascii(x), F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def completeness(title: Column, authors: Column, abstract: Column, keywords: Column, journal: Column, doi: Column, conference: Column, url: Column) -> Column:
    """How many of the eight fields hold something; authors and keywords are arrays."""
    filled = [~is_blank(c) for c in (title, abstract, journal, doi, conference, url)]
    filled += [F.coalesce(F.size(c) > 0, F.lit(False)) for c in (authors, keywords)]
    score = F.lit(0)
    for c in filled:
        score = score + c.cast("int")
    return score


def parse_list(c: Column) -> Column:
    """Items between semicolons, not trimmed; empty ones at the end go; [] for blank."""
    body = F.regexp_replace(c, ";+$", "")
    return F.when(is_blank(c) | (body == ""), F.array().cast("array<string>")).otherwise(F.split(body, ";", -1))


def join_list(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ";"), F.lit(""))


def parse_int(c: Column) -> Column:
    """A trimmed decimal integer with an optional sign that fits 32 bits, else NULL."""
    t = jtrim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd``, else NULL; days 29 to 31 beyond the month's end become its last day."""
    ok = c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")
    first = F.concat(F.substring(c, 1, 7), F.lit("-01")).try_cast("date")
    day = F.substring(c, 9, 2).try_cast("int")
    return F.when(ok, F.date_add(first, F.least(day, F.day(F.last_day(first))) - 1))


def parse_source(c: Column) -> Column:
    """A source's name in any case, else UNKNOWN."""
    return F.when(F.upper(c).isin(*SOURCES), F.upper(c)).otherwise("UNKNOWN")


def is_conference(venue: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a venue's name is that of a conference; NULL is not.  ``more``: further acronyms."""
    pattern = "|".join(VENUE_WORDS) + r"|\b(" + "|".join((*VENUE_ACRONYMS, *more)) + r")\b"
    return F.coalesce(F.lower(venue).rlike(pattern), F.lit(False))


def word_set(c: Column) -> Column:
    """Distinct lower-case words between white space, of ASCII letters and digits only."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda x: F.regexp_replace(x, "[^a-zA-Z0-9]", ""))
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets: 0 for NULL or nothing, 1 for equal strings."""
    x, y = word_set(a), word_set(b)
    ratio = F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.coalesce(ratio, F.lit(0.0)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 for NULL, 1 for equal strings; case counts."""
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(ratio)


def strip_doi_prefix(c: Column) -> Column:
    return F.when(c.startswith("https://doi.org/"), F.substring(c, 17, 1 << 30)).otherwise(c)


def parse_id_list(c: Column) -> Column:
    """Comma-separated ids, with or without brackets around."""
    parts = F.transform(F.split(F.regexp_replace(c, r"[\[\]]", ""), r"\s*,\s*"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def put_field(fields: Column, key: Column, value: Column) -> Column:
    """A map with one more entry, which replaces one of the same key; a NULL map counts as empty, and a NULL key changes nothing."""
    old = F.coalesce(fields, F.from_json(F.lit("{}"), "map<string,string>"))
    new = F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(key, value))
    return F.when(key.isNull(), old).otherwise(new)


def fields_or_empty(fields: Column) -> Column:
    """The map, empty for NULL."""
    return F.coalesce(fields, F.from_json(F.lit("{}"), "map<string,string>"))


def record_text(title: Column, authors: Column, year: Column, source: Column) -> Column:
    """A record in one line, for people."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.format_string("%s (%s). %s [%s]", F.coalesce(F.array_join(authors, ", "), F.lit("-")), shown(year), shown(title), shown(source))


def display_name(source: Column) -> Column:
    """A source's name as shown."""
    return F.when(source == "OPENALEX", "OpenAlex").when(source == "UNKNOWN", "Unknown").otherwise(source)
