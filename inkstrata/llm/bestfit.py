"""Best-fit packing in bulk-synchronous rounds.

Documents are encoded once; only those longer than a sequence are cut, the short piece
first. Full pieces are sequences of their own. The others are placed largest first, as
best-fit decreasing does it, but a class of sizes at a time: a class (top/next] holds what
fits equally often into a sequence. In a round the class's pieces and the open gaps
are sorted together by range, large before small and gaps before pieces of their size. A
sweep over the sorted partitions counts +1 for a gap and -1 for a piece; with the totals of the
partitions before it, the count is a level of the whole order. Of the events of one level each piece takes the gap
right before it: the tightest one that no larger piece has taken. Pieces that want the same gap are told
apart by this rank alone. A gap that holds several pieces of the class whatever their sizes stands in
the order once for each. Gaps shrink, and the round is repeated until nothing matches; then the pieces left open new sequences,
consecutive ones together, by their rank.

A level has at most two events for each size, so no group grows with the data, whatever sizes are common.
Rounds read and write narrow tables (numbers alone) in the shared folder; their number depends on the sequence length, not on the data's size.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import byte_encoder
from .common import attach, shared_folder, shuffle_width

LENGTH = 1024
END = 2
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:binary>>"
EVENT = "part int, place long, level long, size int, bin long, gap int, row long"


def size_classes(length: int) -> list[tuple[int, int]]:
    """(top, below): the classes (below, top] from half a sequence down, by how often a sequence holds them, then by halves."""
    edges = sorted({length // m for m in range(2, 9)} | {(length // 8) >> b for b in range(length.bit_length())} | {0}, reverse=True)
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a > 0]


def piece_starts(n: int, length: int) -> list[int]:
    """Where the pieces of n tokens begin: full ones, but for the first."""
    first = n % length or length
    return [0, *range(first, n, length)]


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, ids (packed uint32, null unless kept) of every piece of every document."""
    end = np.asarray([end_id], "<u4")

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = byte_encoder(tokenizer_path)
        for texts in batches:
            rows, made = [0], []
            for found in coder.all(texts):
                ids = np.append(found, end)
                for k, at in enumerate(starts := piece_starts(len(ids), length)):
                    own = ids[at : starts[k + 1] if k + 1 < len(starts) else len(ids)].tobytes()
                    made.append((k, at, len(own) // 4, zlib.crc32(own), len(ids), own if keep_ids else None))
                rows.append(len(made))
            kinds = (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()))
            cols = list(zip(*made, strict=True)) or [()] * len(kinds)
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds]))

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return attach(narrow, "_pieces", cut, PIECES, F.col("_text")).select("doc_id", F.inline("_pieces"))


def _swept(events: DataFrame, width: int) -> DataFrame:
    """Events in the joint order with the running count within their partition: gaps +1, pieces -1 counted after themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            is_gap = b.column("row").is_null().to_numpy(zero_copy_only=False)
            count = at + np.cumsum(np.where(is_gap, 1, -1))
            # A piece stands at the level that it comes down from.
            level = pa.array(count + ~is_gap, pa.int64())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), level, b.column("size"), b.column("bin"), b.column("gap"), b.column("row")], [c.split()[0] for c in EVENT.split(", ")])
            place, at = place + n, int(count[-1]) if n else at

    order = [F.col("size").desc(), F.col("row").isNotNull(), F.coalesce("row", "bin"), F.col("slot")]
    return events.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(run, EVENT)


def _matched(swept: DataFrame) -> DataFrame:
    """bin, gap, row, size, level: each piece with the gap it takes (null if none), and gaps that nothing took (row null)."""
    step = F.when(F.col("row").isNull(), 1).otherwise(-1)
    # One row a partition of the sort, whatever the data.
    totals = {r["part"]: r["n"] for r in swept.groupBy("part").agg(F.sum(step).alias("n")).collect()}
    before = np.cumsum([0, *(totals.get(p, 0) for p in range(max(totals, default=0) + 1))]).tolist()
    order = W.partitionBy("level").orderBy("part", "place")
    near = swept.withColumn("level", F.col("level") + F.get(F.lit(before), F.col("part")))
    near = near.withColumn("_last", F.lag(F.struct("bin", "gap", F.col("row").isNull().alias("open"))).over(order)).withColumn("_taken", F.lead(F.col("row").isNotNull()).over(order))
    is_gap, last = F.col("row").isNull(), F.col("_last")
    kept = near.where(~(is_gap & F.coalesce("_taken", F.lit(False))))
    taken = F.coalesce(last["open"], F.lit(False))
    return kept.select(
        F.when(is_gap, F.col("bin")).when(taken, last["bin"]).alias("bin"),
        F.when(is_gap, F.col("gap")).when(taken, last["gap"]).alias("gap"),
        "row",
        F.when(~is_gap, F.col("size")).alias("size"),
        "level",
    )


def assign(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, sequence_id, offset for ``items`` (row long and unique, size int from 1 to ``length``): best fit, rounds as above.

    ``items`` is read in every round: give a written table. A sequence's id is the row of the piece that opened it,
    or a negative number where several did. Pieces lie in a sequence in the order of their rows.
    """
    spark, width = items.sparkSession, shuffle_width(items)
    work = f"{shared_folder(spark)}/bestfit-{uuid.uuid4().hex}"
    classes = size_classes(length)
    # As many counts as there are classes.
    of_class = F.coalesce(*[F.when(F.col("size") > below, k) for k, (_, below) in enumerate(classes)])
    sizes = {r["k"] for r in items.where(F.col("size") <= classes[0][0]).groupBy(of_class.alias("k")).count().collect()}
    alone = items.where(F.col("size") > classes[0][0]).select(F.col("row").alias("bin"), (length - F.col("size")).cast("int").alias("gap"), "row")
    gaps, placed, opened, step = alone.select("bin", "gap"), [], 0, 0
    for k, (top, below) in enumerate(classes):
        if k not in sizes:
            continue
        left = items.where((F.col("size") > below) & (F.col("size") <= top)).select("row", "size")
        while True:
            # A gap is one event for each piece that surely fits, the last with what the others leave.
            n = F.greatest(F.lit(1), F.floor(F.col("gap") / top)).cast("int")
            slots = gaps.where(F.col("gap") > below).select("bin", "gap", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("slot"))
            size = F.when(F.col("slot") < F.col("n"), F.lit(top)).otherwise(F.col("gap") - (F.col("n") - 1) * top).cast("int")
            events = slots.select(size.alias("size"), "bin", "gap", F.lit(None).cast("long").alias("row"), "slot")
            events = events.unionByName(left.select("size", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("gap"), "row", F.lit(0).alias("slot")))
            _swept(events, width).write.parquet(f"{work}/swept-{step}")
            seen = Observation()
            found = _matched(spark.read.parquet(f"{work}/swept-{step}"))
            hits, rest = F.count_if(F.col("row").isNotNull() & F.col("bin").isNotNull()), F.count_if(F.col("bin").isNull())
            found.observe(seen, hits.alias("hits"), rest.alias("rest")).write.parquet(f"{work}/matched-{step}")
            done = spark.read.parquet(f"{work}/matched-{step}")
            placed.append(f"{work}/matched-{step}")
            after = done.where("bin is not null").groupBy("bin").agg((F.max("gap") - F.coalesce(F.sum("size"), F.lit(0))).cast("int").alias("gap"))
            after = gaps.where(F.col("gap") <= below).unionByName(after)
            step += 1
            if seen.get["hits"] and seen.get["rest"]:
                after.write.parquet(f"{work}/gaps-{step}")
                gaps, left = spark.read.parquet(f"{work}/gaps-{step}"), done.where("bin is null").select("row", "size")
                continue
            if seen.get["rest"]:
                # The pieces left come down to levels 0, -1, -2, ... for the first time: their rank.
                together = length // top
                number = -(F.lit(opened) + F.floor(-F.col("level") / together)).cast("long") - 1
                done.where("bin is null").select(number.alias("bin"), F.lit(length).alias("gap"), "row", "size", "level").write.parquet(f"{work}/opened-{step}")
                placed.append(f"{work}/opened-{step}")
                fresh = spark.read.parquet(f"{work}/opened-{step}").groupBy("bin").agg((F.max("gap") - F.sum("size")).cast("int").alias("gap"))
                after = after.unionByName(fresh)
                opened += -(-seen.get["rest"] // together)
            after.write.parquet(f"{work}/gaps-{step}")
            gaps = spark.read.parquet(f"{work}/gaps-{step}")
            break
    whole = alone.select("bin", "row", (length - F.col("gap")).cast("int").alias("size"))
    if placed:
        whole = whole.unionByName(spark.read.parquet(*placed).where("bin is not null and row is not null").select("bin", "row", "size"))
    order = W.partitionBy("bin").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return whole.select("row", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    Null text counts as empty and gives the end id alone. Repeated rows, also of one id, are documents of their own. Other columns of
    ``docs`` are left out, so none can clash. An empty table gives no rows. Pieces are written to
    the shared folder and encoded once.
    """
    if length < 2:
        raise ValueError("a sequence holds two tokens or more")
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, length=length, end_id=end_id, keep_ids=keep_ids).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    made = spark.read.parquet(path)
    whole, parts = made.where(F.col("length") == length), made.where(F.col("length") < length)
    found = parts.join(assign(parts.select("row", F.col("length").cast("int").alias("size")), length), "row")
    return found.unionByName(whole.withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens, ids (packed uint32), pieces (doc_id, piece, start, length, offset): what a trainer reads."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("_p")
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), own)
    joined = F.aggregate("_p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return made.select("sequence_id", "tokens", joined.alias("ids"), F.transform("_p", lambda p: F.struct(*[p[c].alias(c) for c in ("doc_id", "piece", "start", "length", "offset")])).alias("pieces"))


def report(packed: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed.drop("ids")
