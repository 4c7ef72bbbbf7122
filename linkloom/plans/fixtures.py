"""Entity records derived from the table documents, in Spark and as SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION

_SPARK = PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
_BETWEEN = r"\s" + re.sub(r"(\W)", r"\\\1", PUNCTUATION)
_FIRST = rf"^(?:[{_BETWEEN}]*+[^{_BETWEEN}]++){{0,8}}+"
_DUCK = PUNCTUATION.replace("'", "''")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country, h): a third of the documents in each source, named by
    their first words; h tells equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # names and addresses need eight words; a word of the text ends at a space or a mark, which lower() makes no more of
    first = docs.select("doc_id", "lang", "n_chars", "text", F.regexp_extract("text", _FIRST, 0).alias("head"))
    words = first.selectExpr("doc_id", "lang", "n_chars", "text", f"filter(split(translate(lower(head), '{_SPARK}', repeat(' ', 32)), '\\\\s+'), x -> x <> '') as t")
    return words.selectExpr(
        "concat(case doc_id % 3 when 0 then 'S1-' when 1 then 'S2-' else 'S3-' end, doc_id) as entity_id",
        "concat(array_join(slice(t, 1, 4), ' '), case doc_id % 4 when 0 then ' Ltd.' when 1 then ', Inc' when 2 then ' GmbH' else '' end) as business_name",
        "case when doc_id % 13 = 0 then null else concat(n_chars % 97, ' ', array_join(slice(t, 5, 4), ' '), ' ', lpad(cast(n_chars as string), 5, '0')) end as business_address",
        "case when doc_id % 11 = 0 then null else upper(lang) end as country",
        "md5(cast(text as binary)) as h",
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reference records, and those of the other two sources as one bag."""
    ent = entities(spark, sf_dir)
    return ent.where("entity_id like 'S1-%'"), ent.where("entity_id not like 'S1-%'")


def truth(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, candidate_id) of records made from equal texts."""
    return s1.select(F.col("entity_id").alias("s1_id"), "h").join(candidates.select(F.col("entity_id").alias("candidate_id"), "h"), "h").select("s1_id", "candidate_id")


SQL = rf"""w as (select doc_id, lang, n_chars, text,
    list_filter(regexp_split_to_array(translate(lower(text), '{_DUCK}', repeat(' ', 32)), '\s+'), lambda x: x <> '') as t from documents),
  ent as (select (case doc_id % 3 when 0 then 'S1-' when 1 then 'S2-' else 'S3-' end) || doc_id as entity_id,
    array_to_string(t[1:4], ' ') || (case doc_id % 4 when 0 then ' Ltd.' when 1 then ', Inc' when 2 then ' GmbH' else '' end) as business_name,
    case when doc_id % 13 = 0 then null else (n_chars % 97) || ' ' || array_to_string(t[5:8], ' ') || ' ' || lpad(n_chars::varchar, 5, '0') end as business_address,
    case when doc_id % 11 = 0 then null else upper(lang) end as country, md5(text) as h from w)"""
DUCK_PUNCTUATION = _DUCK
