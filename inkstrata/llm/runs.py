"""Periodic runs of words by Karp-Miller-Rosenberg naming.

The words of a batch of texts stand one after another. A name of level k stands for 2**k words:
equal names, equal words, and never across two texts. Names of a level come from pairs of
names of the level below; a name that occurs once stays out of all levels above, so prose is done
after a few. How far two places agree, forwards or backwards, is read off the names from
the highest level down, each level at most once.

A run of period q and at least 4 q words has words q apart equal over a stretch of 3 q or more, so
some place on the grid of step 2 q has the same name of the level of q as the place q after it.
Those places alone are extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions.text import let

from .common import attach
from .pack import _slices

LEAST, TIMES = 6, 4
FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def names_of(words: np.ndarray, text: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Names of all levels at which any occurs twice: int64, one more entry than places.

    ``words``: numbers of words; ``text`` and ``stop``: each place's text and the end of it. A name below zero is that of its place alone.
    """
    n = len(words)
    own = -1 - np.arange(n + 1)
    places, keys, span, levels = np.arange(n), text * (int(words.max(initial=0)) + 1) + words, 1, []
    while True:
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        if not twice.any():
            return levels
        level = own.copy()
        level[places[twice]] = number[twice]
        levels.append(level)
        places = places[twice]
        places = places[places + 2 * span <= stop[places]]
        places = places[level[places + span] >= 0]
        keys = level[places] * (len(count) + 1) + level[places + span]
        span *= 2


def agree_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` on are those from ``j`` on; i < j."""
    at = np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        at += (levels[k][i + at] == levels[k][j + at]).astype(np.int64) << k
    return at


def agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words right before ``i`` are those before ``j``; i < j."""
    at = np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        a = i - at - (1 << k)
        at += ((a >= 0) & (levels[k][a] == levels[k][a + (j - i)])).astype(np.int64) << k
    return at


def find_runs(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs in texts of ``words``, by start and period; text t is at edges[t] to edges[t + 1]."""
    n = len(words)
    size = np.diff(edges)
    levels = names_of(words.astype(np.int64), np.repeat(np.arange(len(size)), size), np.repeat(edges[1:], size))
    longest = int(size.max(initial=0)) // TIMES
    found = []
    for k, level in enumerate(levels):
        q = np.arange(1 << k, min(2 << k, longest + 1))
        many = np.maximum(-((q - n) // (2 * q)), 0)  # places i of the grid with i + q in the words
        if not many.sum():
            continue
        step = np.repeat(q, many)
        i = (np.arange(len(step)) - np.repeat(np.cumsum(many) - many, many)) * 2 * step
        same = level[i] == level[i + step]
        i, step = i[same], step[same]
        start, stop = i - agree_before(levels, i, i + step), i + step + agree_after(levels, i, i + step)
        long = stop - start >= np.maximum(LEAST, TIMES * step)
        found.append(np.unique(np.stack([start[long], stop[long], step[long]], 1), axis=0))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The same stretch under a multiple of its smallest period.
    first = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)) if len(rows) else np.zeros(0, bool)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _found(texts: pa.Array) -> pa.StructArray:
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    real = pc.not_equal(words, "")
    edges = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    words = words.filter(real)
    start, stop, period = find_runs(words.dictionary_encode().indices.to_numpy(), edges)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, stop, -1)
    keep = np.cumsum(dropped)[:-1] <= 0
    kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep))[edges], pa.int32()), words.filter(pa.array(keep)))
    begins = edges[:-1]
    own = np.searchsorted(edges, start, "right") - 1
    # An empty text has the same edge as the one after it: the last of them holds the run.
    lists = np.append(0, np.cumsum(np.bincount(own, minlength=len(texts))))
    rows = pa.StructArray.from_arrays([pa.array(start - begins[own], pa.int64()), pa.array(stop - start, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.array(np.diff(edges), pa.int64()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), rows), pc.binary_join(kept, " ")], ["n_words", "runs", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and collapsed of every row.

    A run is a stretch of words with smallest period q and at least 4 q and 6 words that no neighbour extends. ``collapsed``
    has the words that lie in no run after its first q words, joined by a space. Null and empty texts have no words and no runs;
    repeated rows stay apart, other columns are left out, an empty table gives no rows. One text is the
    largest thing held, with its names: 8 bytes a word for each level that has repeats.
    """

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_found(t) for t in _slices(texts)]
            yield pa.concat_arrays(parts) if parts else _found(texts)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    made = attach(narrow, "_found", find, FOUND, F.col("_text"))
    return made.select("doc_id", F.inline(F.array("_found")))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, the text repeated from some word on where the id's checksum ends in 0: a test bed with known answers in it."""
    text = F.col("text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def made(words: Column) -> Column:
        n = F.size(words)

        def repeated(x: Column) -> Column:
            return F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))

        a = g % n
        return F.array_join(let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), repeated), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    changed = F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, made)).otherwise(text)
    # Exploded, since a Python function can't take an expression with lambdas in it.
    return docs.select("doc_id", F.explode(F.array(changed)).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of the greatest exponent, and digests of all runs and of the collapsed text."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    # In order of start and period, so a later one has to be greater.
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    said = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("_best", best)
    b = F.col("_best")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[b[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * b["length"] / b["period"]).cast("long").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
