"""Language identification, words first and character n-grams for words never seen.

A text's score in a language is the sum over its words of the word's log frequency there.
A word that no training text has falls back to its character n-grams (the word between
two boundary marks): 4-grams where they are known, else the 3-gram, 2-gram or single
character at that place; the word then counts the mean over its places.

The model is fitted on a bounded sample: ``max_rows`` expected rows of each language,
taken by a hash of the id, whole texts and all their words. The bound is a parameter, so
what is broadcast does not grow with the corpus. Prediction is one narrow stage over every
text; the scores of words that a worker remembers are bounded in bytes.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, unused
from .pack import PART_BYTES, SLICE_BYTES, _slices

UNKNOWN = "und"
GRAMS = 4
KEEP_BYTES = 32 << 20  # of remembered words, 140,000 or so of usual length in a few languages
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def grams_of(word: str) -> list[list[str]]:
    """N-grams of the marked word by place, longest first."""
    marked = f"<{word}>"
    return [[marked[at : at + size] for size in range(min(GRAMS, len(marked) - at), 0, -1)] for at in range(len(marked))]


class Model:
    """Log probabilities of words and n-grams: a row number for each, and a row of numbers by language."""

    def __init__(self, counts: dict[str, dict[str, int]], alpha: float = 0.5):
        self.langs = sorted(counts)
        k, lists = len(self.langs), []  # by language: words, then n-grams of 1, 2, ... characters
        for lang in self.langs:
            tables: list[Counter] = [Counter(counts[lang]), *(Counter() for _ in range(GRAMS))]
            for word, n in counts[lang].items():
                for place in grams_of(word):
                    for g in place:
                        tables[len(g)][g] += n
            lists.append(tables)
        self.numbers: list[dict[str, int]] = []
        rows = []
        for size in range(GRAMS + 1):
            number = {g: i for i, g in enumerate(sorted(set().union(*(t[size] for t in lists))))}
            seen = np.array([[t[size][g] for t in lists] for g in number], dtype=float).reshape(len(number), k)
            total = seen.sum(axis=0) + alpha * (len(number) + 1)
            rows.append(np.log((np.vstack([seen, np.zeros((1, k))]) + alpha) / total))
            self.numbers.append(number)
        self.words = rows[0]
        first = np.cumsum([0, *(len(r) for r in rows[1:])])
        self.grams = {g: first[size - 1] + i for size in range(1, GRAMS + 1) for g, i in self.numbers[size].items()}
        self.no_gram = int(first[1] - 1)
        self.rows = np.vstack(rows[1:])
        self.numbers = self.numbers[:1]
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.known = np.zeros((0, len(self.langs)))
        self.held = 0  # bytes of both, about

    def learn(self, words: list[str]) -> None:
        """Remember the scores of words that weren't met before."""
        out, flat, first, backed = np.zeros((len(words), len(self.langs))), [], [], []
        number, grams = self.numbers[0].get, self.grams
        for i, w in enumerate(words):
            if (row := number(w)) is not None:
                out[i] = self.words[row]
                continue
            backed.append(i)
            first.append(len(flat))
            for place in grams_of(w):
                flat.append(next((grams[g] for g in place if g in grams), self.no_gram))
        if backed:
            sums = np.add.reduceat(self.rows[flat], first, axis=0)
            out[backed] = sums / np.diff([*first, len(flat)])[:, None]
        start = len(self.seen)
        self.seen.update(zip(words, range(start, start + len(words)), strict=True))
        self.known = np.concatenate([self.known, out])
        self.held += sum(map(sys.getsizeof, words)) + PART_BYTES * len(words) + out.nbytes

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        found = []
        for at in range(0, len(texts), 200):
            part = [words_of(t) for t in texts[at : at + 200]]
            if self.held > KEEP_BYTES:
                self.forget()
            if self.langs and (new := list(set().union(*part).difference(self.seen))):
                self.learn(new)
            for words in part:
                if not self.langs or not has_letter(words):
                    found.append((UNKNOWN, 0.0))
                    continue
                total = self.known[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))].sum(axis=0)
                odds = np.exp(total - total.max())
                best = int(np.argmax(odds))
                found.append((self.langs[best], float(min(1.0, odds[best] / odds.sum()))))
        return found


def fit(docs: DataFrame, labelled: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 500) -> Model:
    """A model of the rows where ``labelled`` holds and neither text nor language is null.

    Every language that a row is labelled with is learned. No labelled row: a model that knows
    no language and calls every text ``und``.
    """
    rows = docs.where(labelled & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    # One literal, whatever the number of languages.
    shares = json.dumps({lang: min(1.0, max_rows / n) for lang, n in sizes.items()})
    share = F.from_json(F.lit(shares), "map<string,double>")[F.col("lang")]
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.setdefault(lang, Counter()).update(words_of(text))
            flat = [(lang, w, n) for lang, c in got.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in counted.toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model, into: str = "language", text_col: str = "text") -> DataFrame:
    """Add struct column ``into`` (lang, score) from the whole text alone.

    Null, empty and letterless texts: ``und`` with score 0. Ties go to the language that
    sorts first. A column already called ``into`` is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            got = [x for part in _slices(texts, SLICE_BYTES) for x in m.predict([t or "" for t in part.to_pylist()])]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["lang", "score"])

    return attach(docs, into, run, "lang string, score double", F.col(text_col).cast("string"))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is identified: not ``und`` and with a score of ``min_score`` at least."""
    named = unused(docs, "_language")
    return predict(docs, model, named).where((F.col(named)["lang"] != UNKNOWN) & (F.col(named)["score"] >= min_score)).drop(named)
