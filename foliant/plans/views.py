"""The driver's tables as records; the same SQL for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions.text import parse_list
from foliant.schema import as_records

RECORDS = """select doc_id as ord, concat('doc/', doc_id) as id, split_part(text, chr(10), 1) as title,
 case when doc_id % 5 = 0 then '' else concat('Author ', doc_id % 50, ';Author ', doc_id % 7) end as authors,
 case when doc_id % 4 = 0 then null else 'Abstract available' end as abstract_text,
 case when doc_id % 8 = 0 then lang else '' end as keywords,
 case when doc_id % 2 = 0 then source end as journal,
 case when doc_id % 2 = 1 then concat('Proceedings of ', source) end as conference,
 2000 + doc_id % 25 as year,
 case when doc_id % 3 = 0 then null when doc_id % 2 = 0 then concat(' 10.1000/', upper(md5(text)))
      else concat('10.1000/', md5(text)) end as doi,
 case when doc_id % 6 = 0 then null else concat('https://example.org/', doc_id) end as url,
 case when lang = 'en' then 'DBLP' else 'OPENALEX' end as source
from documents"""
AUTHORS = "select distinct l_orderkey, s_name as author from lineitem join supplier on l_suppkey = s_suppkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(RECORDS.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))
    return as_records(raw.withColumns({c: parse_list(F.col(c)) for c in ("authors", "keywords")}))


def author_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, authors): a record per order line and supplier, of one author."""
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_name").alias("author")).distinct()
    return pairs.select("l_orderkey", F.array("author").alias("authors"))
