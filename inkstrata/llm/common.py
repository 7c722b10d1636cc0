"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset and Spark runs inside one process, as in tests, a temporary one; on a
    cluster a folder of the driver alone would be lost on the others, so that is refused.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(df: DataFrame, name: str, fn, ddl: str, *cols: Column) -> DataFrame:
    """Add (or replace) column ``name`` by an Arrow-batched function of ``cols``.

    Only ``cols`` travel to Python; the other columns of the row stay in the JVM. The
    function is marked non-deterministic so that a filter on its result can't make it
    run a second time.
    """
    return df.withColumn(name, F.arrow_udf(fn, ddl).asNondeterministic()(*cols))


def unused(df: DataFrame, base: str) -> str:
    """``base``, lengthened until it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def utf8(col: str) -> Column:
    """A text column as its bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


def bytes_of(array) -> Iterator[bytes]:
    """Values of an Arrow array of binaries one by one, null as empty bytes."""
    return (x.as_py() or b"" for x in array)
