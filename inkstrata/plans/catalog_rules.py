"""Registered queries of single rules, each with SQL that fails if the rule is broken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import cleanup, protect

#: Terms that hold one another, begin alike, and begin within one another.
TERMS = ("the", "the in", "in", "in the", "in the in", "theth", "er in")


def _plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z]+", " ").alias("text"))


def longest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of terms that hold one another the longest that fits is protected, each at the first place that is left."""
    values = protect.spans(F.col("text"), TERMS)
    docs = _plain_words(spark, sf_dir)
    return docs.select("doc_id", F.size(values).cast("long").alias("n_terms"), F.array_join(values, "|").alias("terms"))


LONGEST_TERMS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'), '\b(?:{"|".join(sorted(TERMS, key=len, reverse=True))})\b') AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_terms, array_to_string(t, '|') AS terms FROM d"""


def code_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code marks that a translation put around terms go, but for terms that the source has so."""
    docs = _plain_words(spark, sf_dir)
    marked = F.regexp_replace("text", r"\b(the|in)\b", "`$1`")
    source = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit(" `the`"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.sha2(cleanup.without_code_terms(source, marked, TERMS), 256).alias("text_sha256"))


CODE_MARKS = r"""
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(t, '\b(the)\b', '`\1`', 'g') ELSE t END) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g') AS t FROM documents)"""

QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {longest_terms: LONGEST_TERMS, code_marks: CODE_MARKS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in QUERIES.items()}
