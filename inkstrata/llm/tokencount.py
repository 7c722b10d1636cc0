"""Token counts of the sections of a document by offset-mapped attribution.

A whole document is encoded once. A byte-level vocabulary gives tokens whose bytes put
together are the text, so running sums of their lengths are exact spans. The spans are
joined to the sections of the document by position, both being in order, and a token
that crosses a boundary is allocated by a stated rule:

* ``first``    to the section of its first byte;
* ``majority`` to the section with most of its bytes, the earlier one on a tie;
* ``share``    to every section it touches, by the share of its bytes.

Encoding is one narrow stage; the largest thing held is a document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

RULES = ("first", "majority", "share")

_loaded: dict[str, tuple] = {}


def encoder(path: str, pattern: str):
    """The encoding in file ``path`` and the byte length of each of its tokens."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            sizes[n] = len(token)
        _loaded[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those that go on past its end.

    ``ends`` are the tokens' byte ends, ``bounds`` the sections' byte bounds from 0 to the
    length of the text. Both ascend, so the join is a merge. A section without bytes has
    no tokens.
    """
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1]))
    own = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    crossing = np.zeros(n)
    over = np.flatnonzero(last > own)
    np.add.at(crossing, own[over], 1)
    if rule == "first" or not len(over):
        return np.bincount(own, minlength=n).astype(float), crossing
    counts = np.bincount(np.delete(own, over), minlength=n).astype(float)
    for t in over:
        parts = np.arange(own[t], last[t] + 1)
        inside = np.minimum(bounds[parts + 1], ends[t]) - np.maximum(bounds[parts], starts[t])
        if rule == "majority":
            counts[parts[np.argmax(inside)]] += 1
        else:
            counts[parts] += inside / inside.sum()
    return counts, crossing


def _attribute(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, sizes = encoder(path, pattern)
        for docs in batches:
            rows, cols = [0], [[] for _ in range(5)]
            for fields in docs.to_pylist():
                parts = ["" if f is None else f for f in fields or []]
                lengths = np.array([len(p) for p in parts], np.int64)
                blobs = [p.encode() for p in parts]
                bounds = np.concatenate(([0], np.cumsum([len(b) for b in blobs], dtype=np.int64)))
                ids = coder.encode_ordinary("".join(parts))
                ends = np.cumsum(sizes[ids]) if ids else np.zeros(0, np.int64)
                counts, crossing = allocate(ends, bounds, rule) if ids else (np.zeros(len(parts)), np.zeros(len(parts)))
                stop = np.cumsum(lengths)
                for col, values in zip(cols, (range(len(parts)), (stop - lengths).tolist(), stop.tolist(), counts.tolist(), crossing.astype(int).tolist()), strict=True):
                    col.extend(values)
                rows.append(len(cols[0]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["section", "start", "stop", "tokens", "crossing"])
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), flat)

    return run


def count(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", fields: list[str] | None = None, text_col: str = "text", rule: str = "first") -> DataFrame:
    """One row per document and section: doc_id, section, start, stop (characters), tokens, crossing.

    With ``fields`` (names of string columns), the document is those fields one after
    another and each is a section; otherwise it is ``text_col`` and its lines are the
    sections. Null is empty. An empty document has its empty section with no tokens, and
    so do empty fields. Repeated rows come back repeated; other columns are left out.
    ``crossing`` counts tokens that start in the section and end past it.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    if fields:
        parts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    else:
        lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
        # A line keeps the break that ends it; what follows the last break is a section only if it isn't empty.
        ended = F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
        parts = F.filter(ended, lambda x, i: (i == 0) | (x != ""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), parts.alias("_parts"))
    made = attach(narrow, "_s", _attribute(path, pattern, rule), "array<struct<section:bigint,start:bigint,stop:bigint,tokens:double,crossing:bigint>>", F.col("_parts"))
    return made.select("doc_id", F.explode("_s").alias("_s")).select("doc_id", *[F.col("_s")[c].alias(c) for c in ("section", "start", "stop", "tokens", "crossing")])
