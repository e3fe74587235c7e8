"""JSON values where missing, null and text are different things."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at(v: Column, path: str) -> Column:
    """The value at a path, NULL where it is missing."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def as_text(v: Column) -> Column:
    """Scalars as text, JSON null as 'null', missing values and containers as ''."""
    scalar = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull(), "").when(F.is_variant_null(v), "null").when(is_object(v) | is_array(v), "").otherwise(F.coalesce(scalar, F.lit("")))


def text_or_null(v: Column) -> Column:
    """Scalars as text; NULL for null, missing and containers."""
    return F.when(v.isNull() | F.is_variant_null(v) | is_object(v) | is_array(v), F.lit(None).cast("string")).otherwise(F.try_variant_get(v, "$", "string"))


def text_value(v: Column) -> Column:
    """A string, or the string under ``text`` of an object; NULL for all else, numbers too."""
    inner = at(v, "$.text")
    string = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(is_object(v), string(inner))


def elements(v: Column) -> Column:
    """The elements of a JSON array; [] for all else."""
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
