"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are powers of two:
as many full sequences as fit, then the binary digits of the rest from large to small.
A piece is a sequence of its own, and sequences of equal length form a bucket, so a
batch drawn from one bucket needs no padding and no sequence crosses documents.

How texts are encoded is read from the tokenizer's file. Where its normaliser and splitter
are of a kind by which white space always ends a token, a text's ids are those of its words
one after another: a worker encodes a word that it knows only once, and texts are put together
from them as arrays. With any other file whole texts are encoded. All of it is one narrow
stage: no shuffle. A batch of texts is worked through in slices, whose pieces are given out one
by one, and what a worker knows of words is bounded in bytes, so its memory follows neither the
number of texts nor how long or how different their words are.
"""

from __future__ import annotations

import json
import string
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, utf8

LENGTH = 2048
END = 1
KEEP_BYTES = 40 << 20  # of known parts, 200,000 or so of usual length
PART_BYTES = 130  # of a known part besides its text and ids: entry, number, place and size
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
AT_ONCE = 5_000
MARK = "\0"

# Fixed value: a splitter that gives runs of letters, single digits and runs of other characters, and drops white space.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-į]+"  # Latin letters whose lower case is one letter
PLAIN = LETTERS + "[!-/:-@\\[-`{-~]*$"

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = spec["normalizer"] or {}
        normal = normal.get("normalizers", [normal] if normal else [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = (
            all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normal)
            and (splits.get("type"), splits.get("pattern"), splits.get("behavior"), splits.get("invert")) == ("Split", {"Regex": SPLITTER}, "Removed", True)
            and bool(suffix)
        )
        self.lowers = any(n["type"] == "Lowercase" for n in normal)
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            mark = self._encode(MARK)
            self.mark = int(mark[0]) if len(mark) == 1 else None
            self.forget()

    def forget(self) -> None:
        self.known = {"": 0}  # a part's number
        self.held = 0  # bytes of all known parts, about
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0  # of all known parts, one after another
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, parts: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        n, used = len(self.known), self.used
        while len(self.first) < n + len(parts):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while len(self.ids) < used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[used : used + len(ids)] = ids
        self.used += len(ids)
        self.held += sum(map(sys.getsizeof, parts)) + PART_BYTES * len(parts) + ids.nbytes
        self.first[n : n + len(parts)] = used + starts
        self.size[n : n + len(parts)] = stops - starts
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _keep_each(self, parts: list[str]) -> None:
        for p in parts:
            ids = self._encode(p)
            self._keep([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _learn(self, simple: list[str], others: list[str]) -> None:
        """Encode new parts many at once: runs of one kind are told by the ends of their tokens, all else stands between marks."""
        for at in range(0, len(simple), AT_ONCE):
            some = simple[at : at + AT_ONCE]
            ids = self._encode(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                self._keep(some, ids, np.append(0, stops[:-1]), stops)
            else:
                self._keep_each(some)
        if self.mark is None or any(MARK in p for p in others):
            self._keep_each(others)
            return
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            ids = self._encode(f" {MARK} ".join(some))
            marks = np.flatnonzero(ids == self.mark)
            self._keep(some, ids, np.append(0, marks + 1), np.append(marks, len(ids)))

    def _numbers(self, parts: pa.Array, simple: bool) -> np.ndarray:
        coded = parts.dictionary_encode()
        values, known = coded.dictionary.to_pylist(), self.known
        if new := [p for p in values if p not in known]:
            self._learn(new, []) if simple else self._learn([], new)
        return np.fromiter(map(known.__getitem__, values), np.int64, len(values))[coded.indices.to_numpy()] if len(parts) else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty.

        A word is plain Latin letters with punctuation after them, which are two parts with
        the same ids, or else one part. Letters are lower-cased first if the tokenizer does so.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            for text in texts:
                yield self._encode(text.as_py())
            return
        if self.held > KEEP_BYTES:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, PLAIN)
        whole = words.filter(plain)
        stems, tails = pc.utf8_rtrim(whole, string.punctuation), pc.replace_substring_regex(whole, LETTERS, "")
        number = np.zeros((len(words), 2), np.int64)
        at = plain.to_numpy(zero_copy_only=False)
        number[at, 0] = self._numbers(pc.utf8_lower(stems) if self.lowers else stems, True)
        number[at, 1] = self._numbers(tails, True)
        number[~at, 0] = self._numbers(words.filter(pc.invert(plain)), False)
        places = number[coded.indices.to_numpy()].ravel()
        size = self.size[places]
        stops = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[places] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        edges = np.append(0, stops)[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield ids[a:b]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two that sum to the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Stretches of about ``most`` bytes; a longer text is one by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def _encoded(coder: Encoder, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[bytes]:
    for part in _slices(texts, most):
        yield from (ids.tobytes() for ids in coder.encode(part))


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed uint32), doc_tokens, bucket, sequence_id, offset.

    Null text counts as empty and gives the end id alone. Repeated documents give pieces
    of their own with other sequence ids. Other columns of ``docs`` are left out, so none
    can clash. An empty table gives no rows. ``length`` has to be a power of two. A sequence's
    id is its place in the table's layout, the same in every run over the same files. A worker
    encodes texts of about ``slice_bytes`` at a time.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(tokenizer_path)
        for part in (p for texts in batches for p in _slices(texts, slice_bytes)):
            rows, starts, sizes, ids, totals = [0], [], [], [], []
            for found in _encoded(coder, part, slice_bytes):
                all_ids = found + end
                at = 0
                for size in piece_lengths(len(all_ids) // 4, length):
                    starts.append(at)
                    sizes.append(size)
                    ids.append(all_ids[4 * at : 4 * (at + size)])
                    totals.append(len(all_ids) // 4)
                    at += size
                rows.append(len(ids))
            pieces = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], ["start", "length", "ids", "doc_tokens"])
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pieces)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    made = attach(narrow, "_pieces", cut, "array<struct<start:bigint,length:bigint,ids:binary,doc_tokens:bigint>>", F.col("_text"))
    p = F.col("_p")
    return made.select("doc_id", F.explode("_pieces").alias("_p")).select(
        "doc_id",
        p["start"].alias("start"),
        p["length"].alias("length"),
        p["ids"].alias("ids"),
        p["doc_tokens"].alias("doc_tokens"),
        p["length"].alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the sequences by bucket, so that a reader draws equal lengths together."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def report(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
