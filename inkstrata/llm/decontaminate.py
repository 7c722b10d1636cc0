"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item (a shorter item is one
window) is a pattern. Patterns of one length form a table set: a *shift table* over
blocks of two adjacent words says how far the search may jump, *suffix-hash buckets*
hold the patterns that end in the same words, and a bucket's members are compared
directly. Word numbers, not characters, are the alphabet; a word that no pattern has is
number 0, so two words that are rare together always allow the longest jump.

Documents never move: the tables are built and broadcast block by block, each of at most about
``max_windows`` windows, and the documents pass in one narrow stage. A text is split once for all the
tables of a group of ``at_once`` windows. A larger benchmark has several groups, each a job of its
own, so that a worker holds the tables of one group at a time: what the earlier groups find is
written, a row for each different text that is hit, and meets the documents as the last
group passes. The number of blocks follows the benchmark, so no broadcast grows with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bytes_of, cut_lineage, shared_folder, unused, utf8

WINDOW = 10
SUFFIX = 4
MAX_WINDOWS = 50_000  # of a table, which is what the driver holds at a time
AT_ONCE = 100_000  # windows held together by a worker, 150 MB
RESULT = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
RESULT_TYPE = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"
SALTS = 16

#: Word bytes after lower-casing A-Z are digits, a-z and everything beyond ASCII.
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Patterns:
    """Shift tables and suffix buckets of a block of windows."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[tuple[int, ...], list[str]]]] = {}
        for window, items in windows.items():
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.split(b" "))
            by_length.setdefault(len(ids), []).append((ids, items))
        self.base = len(self.number) + 1
        self.tables = [self._table(m, patterns) for m, patterns in sorted(by_length.items())]

    def _table(self, m: int, patterns: list) -> tuple:
        block = min(2, m)
        shift: dict[int, int] = {}
        buckets: dict[tuple[int, ...], list] = {}
        for ids, items in patterns:
            for j in range(block - 1, m):
                key = ids[j - 1] * self.base + ids[j] if block == 2 else ids[j]
                shift[key] = min(shift.get(key, m), m - 1 - j)
            buckets.setdefault(ids[-SUFFIX:], []).append((ids, items))
        return m, block, shift, buckets

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [first, last) that occurrences cover, and the items they are from."""
        number, base = self.number.get, self.base
        ids = [number(w, 0) for w in words]
        spans, found, n = [], set(), len(ids)
        for m, block, shift, buckets in self.tables:
            jump, i = m - block + 1, m - 1
            tail = min(SUFFIX, m)
            get = shift.get
            while i < n:
                s = get(ids[i - 1] * base + ids[i], jump) if block == 2 else get(ids[i], jump)
                if s:
                    i += s
                    continue
                for pattern, items in buckets.get(tuple(ids[i + 1 - tail : i + 1]), ()):
                    if tuple(ids[i + 1 - m : i + 1]) == pattern:
                        spans.append((i + 1 - m, i + 1))
                        found.update(items)
                i += 1
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(tables):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = [t.value for t in tables]
        for texts in batches:
            counts, spans, items = [], [], []
            for text in bytes_of(texts):
                words = words_of(text)
                hit, found = patterns[0].search(words)
                for p in patterns[1:]:
                    more, others = p.search(words)
                    hit, found = merged(hit + more), found | others
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in hit])
                items.append(sorted(found))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "spans", "items"],
            )

    return scan


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item) of all items; a null item id counts as the id ''."""

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([windows_of(words_of(t), window) for t in bytes_of(texts)], pa.list_(pa.binary()))

    narrow = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("text"))
    return attach(narrow, "windows", cut, "array<binary>", F.col("text")).select(F.explode("windows").alias("window"), "item").distinct()


def scan(docs: DataFrame, items: DataFrame, into: str = "contamination", *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, at_once: int = AT_ONCE) -> DataFrame:
    """Add struct column ``into`` (n_words, spans, items) to every row of ``docs``.

    ``spans`` are word ranges [first, last) inside occurrences of a benchmark window,
    merged where they touch; ``items`` the sorted ids of items with an occurring window.
    Null or empty text: no words, no spans. Repeated rows each get their result. Items
    without words have no window; repeated items count once. An empty benchmark leaves
    every document clean. A column of ``docs`` that is already called ``into`` is
    replaced; all others stay as they are.
    """
    spark = docs.sparkSession
    found = cut_lineage(benchmark_windows(items, window, item_col, item_text_col))
    blocks = max(1, -(-found.count() // max_windows))
    if blocks > 1:  # a block is read from its own partition of files
        folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
        found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    tables: list = []
    size, earlier, text = 0, None, utf8(text_col)
    for block in range(blocks):
        windows: dict[bytes, list[str]] = {}
        part = found if blocks == 1 else spark.read.schema("window binary, item string, block long").parquet(folder).where(F.col("block") == block)
        for row in part.toLocalIterator():
            windows.setdefault(bytes(row["window"]), []).append(row["item"])
        tables.append(spark.sparkContext.broadcast(Patterns(windows)))
        size += len(windows)
        if size >= at_once and block < blocks - 1:  # these tables are held together, and texts are split once for all of them
            hits = attach(docs.select(F.sha2(text, 256).alias("key"), text.alias("text")), "r", _scan(tables), RESULT, F.col("text"))
            hits = cut_lineage(hits.where(F.size(F.col("r")["spans"]) > 0).select("key", "r").dropDuplicates(["key"]))
            earlier = hits if earlier is None else earlier.unionByName(hits)
            for t in tables:
                t.unpersist()
            tables, size = [], 0
    if earlier is None:
        return attach(docs, into, _scan(tables), RESULT, text)
    # The last group meets what the others found, by the text's digest, since equal texts are hit alike. Rows of
    # one text may be a third of all, so texts that are hit are dealt out once for each salt.
    key, salt, own, more = (unused(docs, n) for n in ("_key", "_salt", "_scan", "_more"))
    grouped = earlier.groupBy(F.col("key").alias(key)).agg(F.collect_list("r").alias(more)).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = attach(docs, own, _scan(tables), RESULT, text).withColumns({key: F.sha2(text, 256), salt: F.spark_partition_id() % SALTS})
    rows = rows.join(grouped, [key, salt], "left")
    results = F.concat(F.array(F.col(own)), F.coalesce(F.col(more), F.array().cast(f"array<{RESULT_TYPE}>")))
    whole = attach(rows, own, _united, RESULT, results).withColumn(into, F.col(own))
    return whole.select(*docs.columns, *([into] if unused(docs, into) == into else []))


def _united(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Results of several groups of tables as one."""
    for batch in batches:
        rows = []
        for results in batch.to_pylist():
            spans = merged([(x["first"], x["last"]) for r in results for x in r["spans"]])
            rows.append({"n_words": results[0]["n_words"], "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted({i for r in results for i in r["items"]})})
        yield pa.array(rows, batch.type.value_type)


def report(scanned: DataFrame, id_col: str = "doc_id", column: str = "contamination") -> DataFrame:
    """One row per scanned document with its hit counts and the digest of its items."""
    c = F.col(column)
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return scanned.select(
        F.col(id_col),
        c["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (F.size(c["spans"]) > 0).alias("contaminated"),
    )
