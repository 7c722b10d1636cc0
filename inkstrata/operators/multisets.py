"""Differences of multisets kept as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, value_col: str = "value", id_col: str = "doc_id") -> DataFrame:
    """doc_id, value, lost, new: values that one side of a document has more often than the other, and by how much.

    Both sides are counted before they meet, so a frequent value is a row for each task. The
    sides are put together and summed with opposite signs, which is the full outer join by
    document and value in one shuffle. Null values are values; null ids are one document.
    """
    sides = [side.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"), F.lit(sign).cast("long").alias("n")) for side, sign in ((before, 1), (after, -1))]
    n = sides[0].unionByName(sides[1]).groupBy("doc_id", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return n.select("doc_id", "value", F.greatest("n", F.lit(0)).alias("lost"), F.greatest(-F.col("n"), F.lit(0)).alias("new"))


def array_difference(before: Column, after: Column) -> Column:
    """(value, lost, new) as of ``difference`` for two arrays of strings of one row; a null array has no values.

    Where both sides lie in their document's row, nothing moves: a document's values are counted beside it.
    """

    def counts(side: pa.ListArray) -> Iterator[Counter]:
        values, ends = side.values.to_numpy(zero_copy_only=False), side.offsets.to_numpy().tolist()
        return (Counter(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("value", pa.string()), ("lost", pa.int64()), ("new", pa.int64())]))
        for sides in batches:
            counted = zip(*map(counts, sides), strict=True)
            yield pa.array([[(v, n, 0) for v, n in (a - b).items()] + [(v, 0, n) for v, n in (b - a).items()] for a, b in counted], kind)

    return F.arrow_udf(run, "array<struct<value:string,lost:bigint,new:bigint>>")(*[F.coalesce(side, F.array().cast("array<string>")) for side in (before, after)])
