"""Best-fit packing, periodic runs and the prefix trie against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkstrata.llm import bestfit, bytebpe, queries, runs, trie

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_stretches_give_the_ids_of_whole_texts():
    kinds = ["a", "Zb", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", " ", "　", " ", "\x85", "\x1c", "​", "日本", "ß", "1", "23", ".", ",", "!?", "<|endoftext|>", "<|endof", "ф", "́", "٣", "ª", "\r\n", "Ω", "😀", "``", "͸"]
    odd = ["".join(RNG.choices(kinds, k=RNG.randint(0, 30))) for _ in range(3000)] + [None, "", "x" * 5000, "y z, " * 4000]
    own, coder = Tokenizer.from_file(BYTE_BPE), bytebpe.ByteEncoder(BYTE_BPE)
    assert coder.by_stretch
    for text, ids in zip(odd, coder.all(pa.array(odd, pa.string())), strict=True):
        assert ids.tolist() == own.encode(text or "", add_special_tokens=False).ids
    whole = bytebpe.ByteEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not whole.by_stretch
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [i.tolist() for i in whole.all(pa.array(odd[:50], pa.string()))] == [other.encode(t or "", add_special_tokens=False).ids for t in odd[:50]]


def best_fit_decreasing(sizes, length):
    gaps, opened = [0] * (length + 1), 0
    for s in sorted(sizes, reverse=True):
        g = next((g for g in range(s, length + 1) if gaps[g]), None)
        if g is None:
            opened, g = opened + 1, length
        else:
            gaps[g] -= 1
        gaps[g - s] += 1
    return opened


@pytest.mark.parametrize("many", [600, 0])
def test_bulk_best_fit_uses_as_few_sequences(spark, many):
    length = 32
    sizes = [RNG.choice([11, RNG.randint(1, 5), RNG.randint(1, 32)]) for _ in range(many)]
    items = spark.createDataFrame([(7 * k, s) for k, s in enumerate(sizes)], "row long, size int")
    got = bestfit.assign(items, length).toPandas()
    by_row = dict(zip((7 * k for k in range(len(sizes))), sizes, strict=True))
    assert sorted(got["row"]) == sorted(by_row)
    held = defaultdict(list)
    for r in got.itertuples():
        held[r.sequence_id].append((r.offset, by_row[r.row]))
    for own in held.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    assert len(held) <= best_fit_decreasing(sizes, length) * 1.02 + 1


def test_best_fit_pieces_are_those_of_whole_texts(spark):
    texts = ["a b c", None, "", "word " * 3000, "word " * 3000, "ünï, cödé!", "w" * 200, " \n "]
    rows = [(k // 2, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")
    packed = bestfit.pack(docs, BYTE_BPE, length=16)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    got = packed.collect()
    own = Tokenizer.from_file(BYTE_BPE)
    want = defaultdict(list)
    for k, t, _, _ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 16 or 16
        cuts = [0, *range(first, len(ids), 16), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[k, n].append((a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()), len(ids)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    read = bestfit.sequences(packed).collect()
    assert sum(r["tokens"] for r in read) == sum(r["length"] for r in got)
    for r in read:
        assert r["tokens"] <= 16 and len(r["ids"]) == 4 * r["tokens"]
        for p in r["pieces"]:
            assert zlib.crc32(bytes(r["ids"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])]) in {x["ids_crc32"] for x in got}
    assert bestfit.pack(docs.limit(0), BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        bestfit.pack(docs, BYTE_BPE, length=1)


def slow_runs(w):
    """All maximal runs by trying each period, smallest first."""
    n, found, known = len(w), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and (s, e) not in known:
                known.add((s, e))
                found.append((s, e - s, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_report(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = slow_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.fixture(scope="module")
def repeats():
    made = [None, "", " \t ", "a", "a a a a a", "a a a a a a", "x a b a b a b a b c", "a b c a b c a b c a b c a", "\x0bq\x0c" * 9, "a " * 700, "a b a a b a a b a a b a a b a b a a b a b a b a b"]
    for _ in range(150):
        base = [RNG.choice("abc") for _ in range(RNG.randint(1, 7))]
        made.append(" ".join([*RNG.choices("abcd", k=RNG.randint(0, 9)), *(base * RNG.randint(2, 9)), *RNG.choices("abcd", k=RNG.randint(0, 60)), *(base * RNG.randint(1, 6))]))
    long = [f"w{k}" for k in range(90)]
    return [*made, " ".join(long * 5), " ".join(["u", *long * 4, "v"]), made[20]]


def test_runs_equal_all_periods_tried(spark, repeats):
    rows = [(k, t, 1, "x") for k, t in enumerate(repeats)] + [(None, "a " * 20, 1, "x"), (3, repeats[20], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    want = sorted((slow_report(k, t) for k, t, _, _ in rows), key=repr)
    assert sum(r[1] for r in want) > 150
    got = [tuple(r) for r in runs.report(runs.runs(runs.planted(docs))).collect()]
    assert sorted(got, key=repr) == want
    assert runs.runs(docs.limit(0)).count() == 0


def test_runs_of_the_small_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(words_of(r["text"])) < 1500}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for k, text in docs.items():
        assert got[k] == slow_report(k, text)


def slow_trie(rows, graft):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    if graft:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        turns = {c: turns.get(c - c % 100, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = sum(len(p) == len(path) + 1 for p in below)
        childless = sum(not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in own if len(turns[c]) == len(path))
        out.append((own[0], len(path), members[path[:-1]][0] if path else None, len(own), kids, childless, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


ORDER = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("graft", [False, True])
def test_trie_equals_all_prefixes(spark, graft, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(None, 1, "user", "nobody's")]
    for c in range(60):
        path = [RNG.choice(["hi", "hello", "ﬁ x", None, ""]) for _ in range(RNG.randint(1, 7))]
        rows += [(c + 70, None if k == 0 and c % 5 == 0 else k, ["user", "assistant", None][k % 3], t) for k, t in enumerate(path)]
    rows += [(c, k, "user", f"shared {k}") for c in (300, 301, 502) for k in range(11)]  # longer than a block, two of a family
    rows += [(400, 5, "user", "same")] * 9
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS node")
    got = sorted(tuple(r) for r in trie.build(table, graft).select(ORDER).collect())
    assert got == slow_trie(rows, graft)


def test_trie_of_one_conversation_and_of_none(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(5, 2, "user", "b"), (5, 1, None, "a")]
    assert sorted(tuple(r) for r in trie.build(spark.createDataFrame(rows, kinds)).select(ORDER).collect()) == slow_trie(rows, False)
    assert trie.build(spark.createDataFrame([], kinds)).count() == 0


def test_trie_query_equals_its_sql(spark):
    own = duckdb.connect()
    own.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    want = own.sql(trie.TRIE_SQL).select(", ".join(ORDER)).fetchall()
    assert sorted(tuple(r) for r in queries.op13_prefix_trie(spark, SF).select(ORDER).collect()) == sorted(want)
