"""SimHash near-duplicates, candidates by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at
most 3 bits, then from some segment on every chain of consecutive segments stays within
its proportional share of the differences: 0 in the first segment, at most 1 in the first
two, 2 in the first three, 3 in all (floor of l * 3 / 4). The first two links are made an
equality key: the start segment as it is, and the next one with one of its 16 bits blanked
out. Fingerprints that agree on such a key are candidates; the third link prunes them and
the full Hamming distance decides.

Exact copies share a fingerprint and are folded before anything else moves. Candidates of a
key come sorted, and a run of equal keys gives a spanning forest of its links, never all
pairs. A run of more than ``max_run`` different fingerprints is dealt out anew with the third link in the
key as well (two of the next 32 bits blanked out), which bounds a run by 2**18 values
whatever the number of copies. Classes are found by alternating large-star and small-star
steps over the link table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bytes_of, cut_lineage, shuffle_width, unused, utf8

SHINGLE = 3
BROADCAST_KEYS = 200_000  # of about 60 bytes
DISTANCE = 3
SEED = 42
MAX_RUN = 20_000


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles with repeats; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1
    first = np.concatenate(([0], ends))[: len(last)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), 65_536):
        spans = zip(first[at : at + 65_536].tolist(), last[at : at + 65_536].tolist(), strict=True)
        packed = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(packed.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint_of(t) for t in bytes_of(texts)], pa.int64())


def fingerprints(docs: DataFrame, into: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """``docs`` with its fingerprint as a (signed) long; null text counts as empty."""
    return attach(docs, into, _fingerprints, "long", utf8(text_col))


def _rotated(fp: Column, i: int) -> Column:
    return fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))


def chain_keys(prints: DataFrame) -> DataFrame:
    """(key, fp, start): 64 keys for each fingerprint, from the first two links of the four chains.

    Fingerprints are few bytes each, so they are dealt out to all tasks before they become 64.
    """
    fp, keys = F.col("fp"), []
    for i in range(4):
        head = F.shiftrightunsigned(_rotated(fp, i), 32)
        for j in range(16):
            keys.append(head.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))).bitwiseOR(F.lit((16 * i + j) << 32)))
    dealt = prints.select("fp").repartition(shuffle_width(prints))
    return dealt.select("fp", F.posexplode(F.array(*keys)).alias("n", "key")).select("key", "fp", (F.col("n") / 16).cast("int").alias("start"))


def refined_keys(crowded: DataFrame) -> DataFrame:
    """Keys for members of long runs from the first three links: two of 32 bits blanked out."""
    masks = F.array(*[F.lit(0xFFFFFFFF ^ (1 << a) ^ (1 << b)) for a, b in combinations(range(32), 2)])
    fp, start = F.col("fp"), F.col("start")
    turned = F.when(start == 0, _rotated(fp, 0)).when(start == 1, _rotated(fp, 1)).when(start == 2, _rotated(fp, 2)).otherwise(_rotated(fp, 3))
    spread = crowded.select("fp", "start", turned.alias("turned"), F.posexplode(masks).alias("n", "mask"))
    low = F.shiftrightunsigned("turned", 16).bitwiseAND(F.col("mask"))
    # Start segment (16 bits), masked 32 bits, mask number (9 bits), start (2 bits): 59 bits, so no two keys meet.
    key = F.shiftleft(F.shiftrightunsigned("turned", 48), 43).bitwiseXOR(F.shiftleft(low, 11)).bitwiseXOR(F.col("n").cast("long") * 4 + start)
    return spread.select(key.alias("key"), "fp", "start")


def links_of(values: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among different fingerprints of one run, as two columns."""
    turn = np.uint64(16 * start)
    ring = values if start == 0 else (values << turn) | (values >> np.uint64(64 - 16 * start))
    roots, members, rest = [values[:0]], [values[:0]], np.arange(len(values))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        open_ = [root]
        while open_ and len(rest):
            x = ring[rest] ^ ring[open_.pop()]
            chain = np.bitwise_count(x >> np.uint64(16)) <= 2
            near = chain.copy()
            near[chain] = np.bitwise_count(x[chain]) <= DISTANCE
            found = rest[near]
            if len(found):
                roots.append(np.full(len(found), values[root]))
                members.append(values[found])
                open_ += found.tolist()
                rest = rest[~near]
    return np.concatenate(roots), np.concatenate(members)


def _rows(a: np.ndarray, b: np.ndarray, start: int) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), start, np.int32))], ["a", "b", "start"])


def _run_links(max_run: int):
    """Links (a, b, -1) of sorted runs of equal keys; members of runs over ``max_run`` come back as (fp, fp, start).

    The last run of a batch waits for the next batch, but no more than ``max_run`` of it are
    held: what goes beyond is given out as it comes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, held, size = None, 0, [], 0  # the run that may go on

        def ended() -> Iterator[pa.RecordBatch]:
            if 1 < size <= max_run:
                yield _rows(*links_of(np.concatenate(held), start), -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints, starts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = np.ascontiguousarray(prints).view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes, pairs = np.diff(edges), []
            for k in np.union1d(np.flatnonzero(sizes > 1), [0, len(sizes) - 1]):
                run, at = prints[edges[k] : edges[k + 1]], edges[k]
                if 0 < k < len(sizes) - 1 and len(run) <= max_run:
                    pairs.append(links_of(run, int(starts[at])))
                    continue
                if key is None or keys[at] != key:
                    yield from ended()
                    key, start, held, size = keys[at], int(starts[at]), [], 0
                held.append(run.copy())
                size += len(run)
                if size > max_run:
                    for part in held:
                        yield _rows(part, part, start)
                    held = []
            if pairs:
                yield _rows(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), -1)
        yield from ended()

    return scan


def _linked(keyed: DataFrame, max_run: int) -> DataFrame:
    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(_run_links(max_run), "a long, b long, start int")


def links(prints: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """Links (a, b) that join all fingerprints at 3 or fewer differing bits into their classes.

    ``prints`` has a column ``fp`` of distinct fingerprints. The links of a run are a
    spanning forest, so their number stays below that of the keys.
    """
    first = cut_lineage(_linked(chain_keys(prints), max_run).distinct())
    found = first.where("start < 0").select("a", "b")
    crowded = first.where("start >= 0").select(F.col("a").alias("fp"), "start")
    if not crowded.isEmpty():
        found = found.unionByName(_linked(refined_keys(crowded.distinct()), 1 << 18).select("a", "b")).distinct()
    return found


def classes(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) other than the roots; root is the least node of its class.

    Alternates large-star and small-star steps. Each step joins the link table with the
    least neighbour of each node, an aggregate that is combined before it moves; nothing of
    the table reaches the driver but its count and a checksum.
    """
    def star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut_lineage(star(edges))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("link table did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row.

    Null or empty text, or white space only: fingerprint zero, linked like any other.
    Texts below three words are one shingle. Repeated rows come back repeated. Rows with
    a null id keep it and take the least id of their component (null if it has none).
    Other columns are left out, so none can clash. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    printed = cut_lineage(fingerprints(narrow, "fp").select("doc_id", "fp"))
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = classes(links(distinct.select("fp"), max_run))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(best, "root").select("fp", "component_id")
    return printed.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: the one with the least id.

    Rows are told by id and text, so rows that share an id are in components of their own
    texts. A null id comes after all others, and among equal ids the least digest of the text
    first. Of rows with the same id and text one stays.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.md5(utf8(text_col))).alias("digest")))
    named = components(keyed, id_col=key, text_col=text_col, max_run=max_run).select(F.col("doc_id").alias(key), (F.col("component_id") == F.col("doc_id")).alias("_stays"))
    # Decided on keys alone. Whole rows meet only the keys that go, or that stand for several rows.
    decided = cut_lineage(named.groupBy(key).agg(F.first("_stays").alias("_stays"), F.count("*").alias("_n")).where("NOT _stays OR _n > 1"))
    few = decided.count() <= BROADCAST_KEYS
    rest = keyed.join(F.broadcast(decided) if few else decided, key, "left_anti")
    repeated = decided.where("_stays").select(key)
    once = keyed.join(F.broadcast(repeated) if few else repeated, key, "left_semi").dropDuplicates([key])
    return rest.unionByName(once).drop(key)
