"""Documents as blocks, parts and chunks.

A document stays one row until its pieces are exploded: everything between is array
functions within the row, so nothing is shuffled and no text travels but in its own row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.functions import markdown as M
from inkstrata.functions.protect import span_pattern
from inkstrata.functions.text import gaps_and_matches, is_blank, let, lines

MIN_CHUNK = 1000
PART = "array<struct<text:string,translatable:boolean>>"


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, line: lines in order, with their ends. Null and empty texts have none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines(F.col(text_col))).alias("n", "line"))


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blk, text: blocks in order; put together they are the document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(M.blocks(F.col(text_col))).alias("blk", "text"))


def _reference_scopes(heads: Column) -> Column:
    """Spans [start, stop) of block numbers after a reference heading and within its section.

    The last reference heading counts: its section ends at the next heading that isn't deeper.
    ``heads`` are (blk, level, ref) of all headings in order.
    """
    refs = F.filter(heads, lambda h: h["ref"])

    def span(r: Column) -> Column:
        # The next reference heading takes over with its own level, the next shallow heading ends the section.
        after = F.filter(heads, lambda h: (h["blk"] > r["blk"]) & (h["ref"] | (h["level"] <= r["level"])))
        return F.struct((r["blk"] + 1).alias("start"), F.coalesce(F.get(after, F.lit(0))["blk"], F.lit(2**31 - 1)).alias("stop"))

    return F.transform(refs, span)


def parts_of(text: Column, *, target_language: str = "zh-CN", translate_references: bool = False) -> Column:
    """(text, translatable) parts of a document in order; null has none.

    Not translatable: sections of references, front matter, blocks without words, and
    bodies of tables. The heading of references may be replaced; all else is lossless.
    """

    def with_heads(blocks: Column) -> Column:
        heads = F.filter(
            F.transform(blocks, lambda b, i: let(M.heading(b), lambda h: F.struct(i.alias("blk"), h["level"].alias("level"), (M.is_reference_title(h["title"]) & F.lit(not translate_references)).alias("ref")))),
            lambda h: h["level"].isNotNull(),
        )
        scopes = let(heads, _reference_scopes)
        return let(F.struct(heads.alias("heads"), scopes.alias("scopes")), lambda s: parts(blocks, s))

    def parts(blocks: Column, state: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            is_ref = F.exists(state["heads"], lambda h: (h["blk"] == i) & h["ref"])
            scoped = F.exists(state["scopes"], lambda s: (i >= s["start"]) & (i < s["stop"]))
            open_ = ~scoped & ~is_blank(b) & ~M.is_front_matter(b, i) & M.has_language(b)
            fixed = F.array(F.struct(F.when(is_ref, M.with_reference_title(b, target_language)).otherwise(b).alias("text"), F.lit(False).alias("translatable"))).cast(PART)
            return F.when(is_ref | ~open_, fixed).otherwise(M.table_segments(b).cast(PART))

        return F.flatten(F.transform(blocks, one))

    return let(M.blocks(text), with_heads)


def document_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, part_no, text, translatable."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts_of(F.col(text_col), **options)).alias("part_no", "_p"))
    return rows.select("doc_id", "part_no", F.col("_p")["text"].alias("text"), F.col("_p")["translatable"].alias("translatable"))


def greedy(sizes: list[int], free: list[bool], most: int) -> list[int]:
    """A chunk number for each part: filled up to ``most``; a part that isn't free stands alone."""
    out, chunk, held = [], -1, 0
    open_ = False
    for size, may in zip(sizes, free, strict=True):
        if not may:
            chunk, open_, held = chunk + 1, False, 0
        else:
            if not open_ or held + size > most:
                chunk, held = chunk + 1, 0
            held += size
            open_ = held < most
        out.append(chunk)
    return out


def chunk_numbers(sizes: Column, free: Column, most: int) -> Column:
    """``greedy`` as a column; each number depends on the one before, and a document is the largest thing held."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for s, f in batches:
            yield pa.array([None if a is None else greedy(a, b, most) for a, b in zip(s.to_pylist(), f.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(sizes, free)


def document_chunks(docs: DataFrame, max_chars: int = 12_000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, chunk_no, text, translatable: parts packed up to ``max_chars``; one larger part is a chunk of its own."""
    if max_chars < MIN_CHUNK:
        raise ValueError(f"max_chars is at least {MIN_CHUNK}")
    parts = F.col("_parts")
    split = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(parts_of(F.col(text_col), **options))).alias("_parts"))
    numbered = split.withColumn("_n", chunk_numbers(F.transform(parts, lambda p: F.length(p["text"])), F.transform(parts, lambda p: p["translatable"]), max_chars))
    # Parts of a chunk are neighbours: where a number first stands, and where the next one does.
    starts = F.filter(F.transform("_n", lambda c, i: F.when((i == 0) | (F.get(F.col("_n"), i - 1) != c), i)), lambda i: i.isNotNull())
    chunks = F.transform("_starts", lambda s, k: let(F.slice(parts, s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size(parts)) - s), lambda own: F.struct(F.array_join(F.transform(own, lambda p: p["text"]), "").alias("text"), own[0]["translatable"].alias("translatable"))))
    rows = numbered.select("doc_id", "_parts", F.explode(F.array(starts)).alias("_starts")).select("doc_id", F.posexplode(chunks).alias("chunk_no", "_c"))
    return rows.select("doc_id", "chunk_no", F.col("_c")["text"].alias("text"), F.col("_c")["translatable"].alias("translatable"))


# Where a text may be split, best first. White space without the separators of files and groups, which split nothing.
SPLITS = tuple(re.compile(p) for p in (r"\n[ \t]*\n", r"(?<=[.!?。！？])[^\S\x1C-\x1F]+", r"\n", r"[ \t]+"))
FILLED = re.compile(r"\S+")


def split_position(text: Column, min_side: int = 400) -> Column:
    """Characters before the best place to split a text near its middle, null if there is none.

    Blank lines come before ends of sentences, those before line ends and spaces. Neither
    side may have fewer than ``min_side`` characters without the white space at its ends, and no
    protected span is cut. Spans are matched in the JVM, by one pass; Python gets the lengths of
    them and of what lies between, and looks for a kind of places only where the kinds before it have none.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, lengths in batches:
            yield pa.array([None if t is None else nearest_split(t, list(accumulate(s)), min_side) for t, s in zip(texts.to_pylist(), lengths.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(text, F.transform(gaps_and_matches(text, span_pattern()), lambda p: F.length(p)))


def nearest_split(text: str, spans: list[int], least: int) -> int | None:
    """The first kind of places that has one where both sides are long enough and no span is open, and of it the nearest to the middle.

    ``spans`` are ends: of a gap and of a span in turn.
    """
    words = [m.span() for m in FILLED.finditer(text)]
    if not words or words[-1][1] - words[0][0] < 2 * least:
        return None
    first, last = [w[0] for w in words], [w[1] for w in words]
    starts, stops, middle = spans[0:-1:2], spans[1::2], len(text) // 2

    def fits(at: int) -> bool:
        # White space ends at every place, so that no word goes across one.
        before, opened = bisect_right(last, at), bisect_left(starts, at)  # words and spans that come before
        if not 0 < before < len(words):
            return least <= 0 and not (opened and at < stops[opened - 1])
        return last[before - 1] - first[0] >= least and last[-1] - first[before] >= least and not (opened and at < stops[opened - 1])

    for pattern in SPLITS:
        ends = [e for m in pattern.finditer(text) if 0 < (e := m.end()) < len(text)]
        below, above = bisect_left(ends, middle) - 1, bisect_left(ends, middle)
        while below >= 0 or above < len(ends):
            if above == len(ends) or (below >= 0 and middle - ends[below] <= ends[above] - middle):
                at, below = ends[below], below - 1
            else:
                at, above = ends[above], above + 1
            if fits(at):
                return at
    return None


def halves(texts: DataFrame, text_col: str = "text", min_side: int = 400) -> DataFrame:
    """Beside each row, where it is split and the two sides; null where it can't be."""
    at = F.col("split_at")
    out = texts.withColumn("split_at", split_position(F.col(text_col), min_side).cast("int"))
    return out.withColumns({"left": F.substring(F.col(text_col), F.lit(1), at), "right": F.substring(F.col(text_col), at + 1, F.length(text_col))})
