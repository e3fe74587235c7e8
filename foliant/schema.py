"""The record model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_TYPES = {
    "string": "id title first_author abstract_text journal conference doi isbn issn document_type source affiliations country language publisher issue pages url",
    "array<string>": "authors keywords",
    "int": "year citation_count volume",
    "date": "publication_date",
    "map<string,string>": "additional_fields",
}
FIELDS = {name: kind for kind, names in _TYPES.items() for name in names.split()}
#: ``ord``: the place in the input, which decides ties.
RECORD_DDL = "ord long, " + ", ".join(f"{n} {k}" for n, k in sorted(FIELDS.items()))


def as_records(df: DataFrame) -> DataFrame:
    """All columns of the model, in order; those that are missing NULL, numbers 0."""
    cols = [F.col("ord").cast("long").alias("ord") if "ord" in df.columns else F.lit(None).cast("long").alias("ord")]
    for name, k in sorted(FIELDS.items()):
        c = F.col(name).cast(k) if name in df.columns else F.lit(None).cast(k)
        cols.append((F.coalesce(c, F.lit(0)) if k == "int" else c).alias(name))
    return df.select(*cols)
