"""Registered queries over whole texts with several figures, each with its SQL from the base tables.

An order is a text, its items are images: the first two are a figure, so are the third and
fourth right after them, and the fifth and sixth have words between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.operators import figures

from .catalog_repairs import _items, _joined
from .catalog_sql import LI

PAIRS = 3


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The items and the texts (doc_id, text) that refer to them."""
    rows = _items(spark, sf_dir)
    label = F.when(F.col("i") % 2 == 0, F.when(F.col("l_partkey") % 3 == 0, "(a) part\n")).otherwise("")
    words = F.when(F.col("i") == 4, "words\n").otherwise("")
    image = F.concat(F.lit("![](images/a"), F.col("i"), F.lit(".jpg)\n"))
    return rows, _joined(rows, F.concat(image, F.coalesce(label, F.lit("")), words))


def figure_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a text folded at once: the text, whether it changed, and what became of each figure."""
    rows, texts = _texts(spark, sf_dir)
    pairs = rows.where(F.col("i") < 2 * PAIRS).groupBy(F.col("l_orderkey").alias("doc_id"), (F.floor(F.col("i") / 2) + 1).cast("int").alias("figure"))
    images = F.sort_array(F.collect_list(F.concat(F.lit("a"), F.col("i"), F.lit(".jpg"))))
    own = pairs.agg(images.alias("images")).where("size(images) = 2").withColumn("file", F.format_string("figure-%02d.jpg", F.col("figure")))
    told = F.array_join(F.transform("figures", lambda f: F.concat_ws(":", f["figure"], f["status"])), ";")
    return figures.fold(texts, own).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "changed", F.coalesce(told, F.lit("")).alias("statuses"))


FIGURE_FOLDS = rf"""
WITH {LI}, line AS (SELECT l_orderkey AS doc_id, i, '![](images/a' || i || '.jpg)' || chr(10) AS image,
  CASE WHEN i % 2 = 0 AND l_partkey % 3 = 0 THEN '(a) part' || chr(10) ELSE '' END AS label, CASE WHEN i = 4 THEN 'words' || chr(10) ELSE '' END AS words,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM li),
put AS (SELECT doc_id, i, n, CASE WHEN i < 4 AND i // 2 * 2 + 1 < n
  THEN CASE WHEN i % 2 = 0 THEN '![](images/figure-0' || (i // 2 + 1) || '.jpg)' || chr(10) || label ELSE chr(10) || label END
  ELSE image || label || words END AS text FROM line)
SELECT doc_id, sha256(string_agg(text, '' ORDER BY i)) AS text_sha256, max(n) > 1 AS changed,
  array_to_string(list_filter([CASE WHEN max(n) > 1 THEN '1:merged 2 panels -> images/figure-01.jpg' END, CASE WHEN max(n) > 3 THEN '2:merged 2 panels -> images/figure-02.jpg' END,
  CASE WHEN max(n) > 5 THEN '3:skip: unexpected content between panels (words)' END], lambda x: x IS NOT NULL), ';') AS statuses
FROM put GROUP BY doc_id"""


def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a text to images that its folder doesn't have."""
    rows, texts = _texts(spark, sf_dir)
    files = rows.where(F.col("l_suppkey") % 3 > 0).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("a"), F.col("i"), F.lit(".jpg")).alias("file"))
    return figures.unresolved(texts, files)


UNRESOLVED = f"""WITH {LI} SELECT l_orderkey AS doc_id, 'a' || i || '.jpg' AS file, 1::BIGINT AS n FROM li WHERE l_suppkey % 3 = 0"""

QUERIES: dict[Callable[[SparkSession, str], DataFrame], str] = {figure_folds: FIGURE_FOLDS, unresolved_references: UNRESOLVED}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in QUERIES.items()}
