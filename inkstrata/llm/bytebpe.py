"""Byte-level BPE over whole texts, each different stretch of a batch encoded once.

The splitter of these files ends a token before white space and between a letter and a punctuation mark.
Cut there, a text falls into stretches (a gap and a word, or the marks after a word) whose
ids, one after another, are those of the text. The cuts are found on the bytes of a batch at
once, and a batch's different stretches are encoded side by side in one call.

Merges in the order of their ranks are what both libraries for these files do, so stretches of
Latin letters go to the faster one. Whatever rests on tables of characters (other scripts), added tokens, and files
of another kind are left to the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pack import _slices

# Fixed value: how these files split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = 0xC9  # the first byte of U+0240 to U+027F

_SPACE, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_loaded: dict[str, "ByteEncoder"] = {}


def _may_be_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that ends at these bytes is white space of another kind, or may be."""
    last, second, third = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    control = (last >= 0x1C) & (last <= 0x1F)
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    three = ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((third == 0xE3) & (second == 0x80))
    return control | ((last >= 0x80) & (two | three))


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's place among them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The stretches of all texts, and where each text's begin among them (one more edge at the end)."""
    data, offsets = _bytes(texts)
    opens = np.zeros(len(data), bool)
    opens[1:] = _LETTER[data[:-1]] & _MARK[data[1:]]
    space = _SPACE[data]
    cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    opens[cuts[~_may_be_space(data, cuts - 1)]] = True
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(opens)
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, offsets)


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in these files: itself where it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.by_stretch = (
            (splitter.get("type"), splitter.get("add_prefix_space"), splitter.get("use_regex")) == ("ByteLevel", False, True)
            and not spec["normalizer"]
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        if self.by_stretch:
            self._ranked(model)

    def _ranked(self, model: dict) -> None:
        import tiktoken

        names = _byte_names()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*names, *[a + b for a, b in pairs]]
        if len(set(tokens)) != len(tokens) or any(t not in model["vocab"] for t in tokens):
            self.by_stretch = False
            return
        spelled = [bytes(names[c] for c in t) for t in tokens]
        self.ids = np.array([model["vocab"][t] for t in tokens], "<u4")
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={s: k for k, s in enumerate(spelled)}, special_tokens={})

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _table(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and where each part's begin and how many they are."""
        data, offsets = _bytes(parts)
        size = np.diff(offsets)
        plain = np.zeros(len(parts), bool)
        if len(parts):
            plain = _SPACE[data[offsets[:-1]]] & ~_SPACE[data[offsets[1:] - 1]] & (np.maximum.reduceat(data, offsets[:-1]) <= LATIN)
        joined = data[np.repeat(plain, size)].tobytes().decode()
        ranks = np.asarray(self.ranked.encode_to_numpy(joined, disallowed_special=()), np.int64)
        reached, ends = np.cumsum(self.lengths[ranks]), np.cumsum(size[plain])
        stops = np.searchsorted(reached, ends) + 1
        if len(ends) and not np.array_equal(reached[np.minimum(stops, len(reached)) - 1], ends):  # a token across two parts: not one of these files
            plain[:], ranks, stops = False, ranks[:0], stops[:0]
        others = self._each(parts.filter(pa.array(~plain)).to_pylist())
        sizes = np.zeros(len(parts), np.int64)
        sizes[plain], sizes[~plain] = np.diff(stops, prepend=0), [len(o) for o in others]
        first = np.zeros(len(parts), np.int64)
        first[plain] = stops - sizes[plain]
        first[~plain] = len(ranks) + np.cumsum(sizes[~plain]) - sizes[~plain]
        return np.concatenate([self.ids[ranks], *others]), first, sizes

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if not self.by_stretch or special.all():
            yield from (self._each([t.as_py()])[0] for t in texts)
            return
        parts, edges = stretches(texts)
        coded = parts.dictionary_encode()
        table, first, sizes = self._table(coded.dictionary)
        places = coded.indices.to_numpy()
        size = sizes[places]
        stops = np.cumsum(size)
        ids = table[np.repeat(first[places] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.append(0, stops)[edges]
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield self._each([texts[k].as_py()])[0] if special[k] else ids[a:b]

    def all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """As ``encode``, a few megabytes of text at a time."""
        for part in _slices(texts):
            yield from self.encode(part)


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]
