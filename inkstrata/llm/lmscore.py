"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model with Dirichlet smoothing, order by order: after a history h a
word w has probability (c(h w) + k p(w | h')) / (c(h) + k), where h' is h without its first
word and p(w) the smoothed unigram. As an automaton every seen pair and every word (and the
start of a text) is a state and the root is one; a seen n-gram is an arc with its log
probability, and every state has a failure arc with weight k / (c(h) + k) to the state of
h', so that a miss falls from pair to word to root. One left-to-right traversal of a text
carries the state and adds up weights.

Nothing of the model is gathered in one place, since it grows with the corpus. Texts are
dealt into blocks of about ``block_bytes`` and travel to them compressed, once. A block sends
each of its different n-grams once, as a 64-bit hash with its count in the block's training
texts, to the partition of the hash; there the counts of all blocks are added. Back goes,
in the order in which the block sent its hashes, only what the other blocks add to each,
along with the partition's share of N and V. With them the block builds the automaton that
its own texts can reach. So what is shuffled are the different n-grams of blocks, not the
places of the text, and no n-gram has more rows than there are blocks.

``STRENGTHS`` are the k of pairs and of triples. On the first 6,000 test documents (20 MB)
a k of 10 for triples gives the texts outside the training fold the highest likelihood of
1, 3, 10, 30, ..., and a k over 3,000 for pairs adds less than 0.01 a token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

START_KEY, END_KEY = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"")  # no word has these bytes
STRENGTHS = (3000.0, 10.0)
BLOCK_BYTES = 16 << 20
KEYS_BYTES = 10 << 20
HELD_BYTES = 32 << 20
STRETCH = 200_000
ORDERS = (0, 1, 2)  # words, pairs, triples


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _word_keys(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    raw = words.buffers()[2].to_pybytes() if len(words) else b""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(words))


class Block:
    """The texts of a block as places with their word, the pair that ends there and, but for a text's first place, the triple.

    Words, pairs and triples are numbered in ascending order of their hashes (``keys``).
    """

    def __init__(self, texts: pa.Array, learns: np.ndarray):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = split.flatten()
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        counted = np.append(0, np.cumsum(filled))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        hashes = np.append(_word_keys(coded.dictionary), np.array([START_KEY, END_KEY], np.uint64))
        order = np.argsort(hashes)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.start, end = number[-2], number[-1]

        self.lengths = np.diff(counted) + 1
        self.stops = np.cumsum(self.lengths)
        n = int(self.stops[-1]) if len(texts) else 0
        self.word, self.triple = np.full(n, end), np.full(n, -1, np.int32)
        last = np.zeros(n, bool)
        last[self.stops - 1] = True
        self.word[~last] = number[coded.indices.to_numpy(zero_copy_only=False)]
        del flat, split, coded
        pa.default_memory_pool().release_unused()
        taught = np.repeat(learns, self.lengths)

        hashes = hashes[order]
        at = _mixed(hashes[self._before(0, n, self.stops - self.lengths)], hashes[self.word])
        pairs, found = np.unique(at, return_inverse=True)
        self.pair = found.astype(np.int32)
        inner = np.flatnonzero(~last) + 1  # all places but the first of a text
        at = _mixed(at[inner - 1] ^ np.uint64(0x5851F42D4C957F2D), hashes[self.word[inner]])
        triples, found = np.unique(at, return_inverse=True)
        self.triple[inner] = found
        del at, found
        self.keys = (hashes, pairs, triples)
        self.counts = [np.bincount(x[taught & (x >= 0)], minlength=len(k)) for x, k in zip((self.word, self.pair, self.triple), self.keys, strict=True)]
        self.counts[0][self.start] = int(learns.sum())

    def _before(self, a: int, b: int, firsts: np.ndarray) -> np.ndarray:
        """The word before each of the places from ``a`` to ``b``, of which ``firsts`` begin a text."""
        words = np.append(self.start, self.word[a : b - 1])[: b - a] if b > a else self.word[:0]
        words[firsts - a] = self.start
        return words

    def score(self, total: int, distinct: int, strengths: tuple[float, float]) -> Iterator[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base, score) of each text, once ``counts`` are those of all blocks."""
        (n1, n2, n3), (k2, k3) = self.counts, strengths
        at = 0
        while at < len(self.stops):  # stretches of texts, so that few places have their weights laid out at a time
            begin = int(self.stops[at] - self.lengths[at])
            to = max(at + 1, int(np.searchsorted(self.stops, begin + STRETCH, "right")))
            end = int(self.stops[to - 1])
            firsts = self.stops[at:to] - self.lengths[at:to]
            word, pair, triple, before = self.word[begin:end], self.pair[begin:end], self.triple[begin:end], self._before(begin, end, firsts)
            arc1 = np.log10((n1[word] + 0.5) / (total + 0.5 * (distinct + 1)))
            fall1 = np.log10(k2 / (n1[before] + k2))
            p2 = (n2[pair] + k2 * 10**arc1) / (n1[before] + k2)
            arc2 = np.where(n2[pair] > 0, np.log10(p2), np.nan)
            past = np.append(0, n2[pair[:-1]])  # count of the pair before
            fall2 = np.log10(k3 / (past + k3))
            seen = np.where(triple >= 0, n3[triple] if len(n3) else 0, 0)
            arc3 = np.where(seen > 0, np.log10((seen + k3 * p2) / (past + k3)), np.nan)
            known = np.append(0, np.cumsum(n1[word] > 0))
            for a, b in zip((firsts - begin).tolist(), (self.stops[at:to] - begin).tolist(), strict=True):
                arcs = [x[a:b].tolist() for x in (arc3, fall2, arc2, fall1, arc1)]
                yield b - a, int(known[b] - known[a]), math.fsum(arcs[4]), walked(*arcs)
            at = to


def walked(arc3: list[float], fall2: list[float], arc2: list[float], fall1: list[float], arc1: list[float]) -> float:
    """The weight of a text's path through the automaton: at each place the arcs of pair, word and root and the failure arcs between.

    The state is the last pair if it was ever seen, else the last word. An arc that isn't there is no number.
    """
    score, paired = 0.0, False
    for of_pair, leave_pair, of_word, leave_word, of_root in zip(arc3, fall2, arc2, fall1, arc1, strict=True):
        if paired:
            if of_pair == of_pair:
                score += of_pair
                continue
            score += leave_pair
        paired = of_word == of_word
        score += of_word if paired else leave_word + of_root
    return score


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, as many as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(n: int, blob: bytes) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[: blob[0]] = np.frombuffer(pa.decompress(blob[1:], decompressed_size=n * blob[0], codec="zstd", asbytes=True), np.uint8).reshape(blob[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash range of each part begins and ends in ascending keys."""
    bounds = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)])).astype(np.int64)


def _bundles(blocks: int):
    """Rows as bundles of a block: ids, learns, lengths, and texts in one. Equal rows of a batch go to different blocks."""

    def bundled(held: list[pa.RecordBatch], places: list[np.ndarray]) -> pa.RecordBatch:
        table, block = pa.Table.from_batches(held), np.concatenate(places)
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        ids, texts, learns = (c.combine_chunks() for c in table.take(pa.array(order)).select(["doc_id", "text", "learns"]).columns)
        edges = np.append(first, len(order)).astype(np.int32)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.append(0, np.cumsum(size))
        raw = b"".join(texts.to_pylist())
        blobs = [pa.compress(raw[stops[a] : stops[b]], codec="zstd", asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (ids, learns, pa.array(size))]
        return pa.RecordBatch.from_arrays([pa.array(found), *lists, pa.array(blobs, pa.binary())], ["block", "ids", "learns", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            order = np.argsort(h, kind="stable")
            new = np.append(True, np.diff(h[order]) != 0)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            held.append(batch)
            places.append((h % blocks + rank) % blocks)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield bundled(held, places)
                held, places, size = [], [], 0
        if held:
            yield bundled(held, places)

    return run


def _block(table: pa.Table) -> tuple[Block, pa.Array, np.ndarray]:
    """A block with the ids of its texts and which of them are learned from."""
    sizes = table.column("sizes").combine_chunks()
    raw = [pa.decompress(b.as_py(), decompressed_size=sum(s.as_py()), codec="zstd", asbytes=True) for b, s in zip(table.column("texts"), sizes, strict=True)]
    lengths, ids, learns = (table.column(c).combine_chunks().flatten() for c in ("sizes", "ids", "learns"))
    offsets = np.append(0, np.cumsum(lengths.to_numpy())).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(b"".join(raw)))
    learns = learns.to_numpy(zero_copy_only=False).astype(bool)
    return Block(texts, learns), ids, learns


def _block_keys(parts: int):
    """A row for each part: the block's keys there, as gaps, with their counts, by section."""

    def run(table: pa.Table) -> pa.Table:
        block, _, _ = _block(table)
        columns: dict[str, list] = {"part": list(range(parts)), "block": [table.column("block")[0].as_py()] * parts}
        for i, (keys, counts) in enumerate(zip(block.keys, block.counts, strict=True)):
            edges = _edges(keys, parts).tolist()
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            columns |= {f"n{i}": [b - a for a, b in spans], f"keys{i}": [_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], f"counts{i}": [_packed(counts[a:b]) for a, b in spans]}
        return pa.table(columns)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """For each block what all others have of its keys, and the part's share of N and V."""
    columns: dict[str, list] = {"part": table.column("part").to_pylist(), "block": table.column("block").to_pylist()}
    for i in ORDERS:
        sizes = table.column(f"n{i}").to_pylist()
        keys = np.concatenate([np.cumsum(_unpacked(n, k.as_py()), dtype=np.uint64) for n, k in zip(sizes, table.column(f"keys{i}"), strict=True)])
        own = np.concatenate([_unpacked(n, c.as_py()) for n, c in zip(sizes, table.column(f"counts{i}"), strict=True)])
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) != 0)[: len(keys)]
        sums = np.add.reduceat(own[order], np.flatnonzero(new)) if len(keys) else own
        if not i:
            words = sums[keys[order][np.flatnonzero(new)] != np.uint64(START_KEY)]
            columns |= {"total": [int(words.sum())] * len(sizes), "distinct": [int(np.count_nonzero(words))] * len(sizes)}
        others = np.empty(len(keys), np.uint64)
        others[order] = sums[np.cumsum(new) - 1] if len(keys) else sums
        others -= own
        stops = np.cumsum(sizes).tolist()
        columns |= {f"n{i}": sizes, f"others{i}": [_packed(others[b - n : b]) for n, b in zip(sizes, stops, strict=True)]}
    return pa.table(columns)


SENT = "part long, block long, " + ", ".join(f"n{i} long, keys{i} binary, counts{i} binary" for i in ORDERS)
BACK = "part long, block long, total long, distinct long, " + ", ".join(f"n{i} long, others{i} binary" for i in ORDERS)
SCORED = "learns boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(strengths: tuple[float, float]):
    def run(table: pa.Table, sums: pa.Table) -> pa.Table:
        block, ids, learns = _block(table)
        sums = sums.sort_by("part")
        block.counts = [own + np.concatenate([_unpacked(n, x.as_py()) for n, x in zip(sums.column(f"n{i}").to_pylist(), sums.column(f"others{i}"), strict=True)]).astype(np.int64) for i, own in enumerate(block.counts)]
        total, distinct = pc.sum(sums.column("total")).as_py(), pc.sum(sums.column("distinct")).as_py()
        rows = list(block.score(total, distinct, strengths))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        n_tokens, n_known, base, score = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))
        return pa.table([ids, pa.array(learns), n_tokens, n_known, pa.array([total] * len(ids), pa.int64()), base, score], names=["doc_id", *(c.split()[0] for c in SCORED.split(", "))])

    return run


def score(docs: DataFrame, learns: Column, *, id_col: str = "doc_id", text_col: str = "text", strengths: tuple[float, float] = STRENGTHS, block_bytes: int = BLOCK_BYTES, keys_bytes: int = KEYS_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are words between ASCII white space, A-Z lower-cased, and an end. Learns from the
    rows where ``learns`` holds (null: not). Null and empty texts are the end token alone.
    Repeated rows count, and come back, as often as they are there. With nothing to learn
    from, every token is unknown and N is 0. Scores are log10. ``block_bytes`` of text make a
    block and the n-grams of ``keys_bytes`` of text a part; they decide how the work is
    dealt out and not what comes out. Blocks times parts are the rows exchanged, so both grow
    with executors that have more memory. Other columns are left out, so none can clash.
    """
    text = F.coalesce(utf8(text_col), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    blocks, parts = -(-size // block_bytes), -(-size // keys_bytes)
    kind = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit((1 << 62) - 1)))
    dealt = hashed.mapInArrow(_bundles(blocks), f"block long, ids array<{kind}>, learns array<boolean>, sizes array<long>, texts binary")
    sent = dealt.groupBy("block").applyInArrow(_block_keys(parts), SENT)
    back = sent.groupBy("part").applyInArrow(_add_up, BACK)
    scored = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score_block(strengths), f"doc_id {kind}, {SCORED}")
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
