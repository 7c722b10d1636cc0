"""The corpus pipeline: language ID, near-dedup, decontamination and packing, in this order.

Each stage works on all documents that the one before kept, written as Parquet in the
shared folder and read again. Rejected documents are gone for the stages after.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm import decontaminate, langid, pack, simhash
from inkstrata.llm.common import shared_folder, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, by a model of those that carry a label."""
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), "_contamination")
    return scanned.where(F.size(F.col("_contamination")["spans"]) == 0).drop("_contamination")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed by power-of-two decomposition."""
    import public_tokenizers

    return pack.report(pack.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", identify), ("simhash_dedup", dedup), ("decontaminate", decontaminated), ("pack", packed)]

#: Near-duplicates need XXH64 and packing a tokenizer, which SQL hasn't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What the others keep stays in the shared folder, as those rows are read from it."""
    work, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{name}")
        docs = spark.read.parquet(f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
