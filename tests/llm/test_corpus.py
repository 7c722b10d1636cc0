"""Corpus operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inkstrata.llm import chat, decontaminate, langid, licenses, lmscore, media, pack, queries, simhash, sitetree, tokencount

SF = "/root/testdata/sf0.001"
RNG = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(40)] + ["Ärger", "naïve", "x.y"]


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(RNG.randint(1, 60)) for _ in range(60)]
    texts = base + [None, "", " \n\t ", base[0], base[0], base[1] + " tail", "1 2", prose(4000)]
    rows = [(i, t, "en", "s", 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, words int, fp int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontaminate(spark, docs, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = words_of(texts[67])
    items = [(1, " ".join(own[50:75])), (2, "w1 w2"), (None, " ".join(own[:9])), (3, ""), (4, None), (5, " ".join(own[100:110]).upper()), (5, " ".join(own[100:110])), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    for blocks, at_once in ((50_000, 100_000), (5, 100_000), (5, 8)):
        got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.scan(docs, bench, max_windows=blocks, at_once=at_once)).collect()}
        for k, text in texts.items():
            w, hit, found = words_of(text), set(), set()
            for window, ids in windows.items():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        found |= ids
            want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
            assert tuple(got[k])[1:] == want, k
    # Several groups of tables: every row comes back, repeated ones too, with its own columns and one that is replaced.
    groups = {"max_windows": 5, "at_once": 8}
    many = decontaminate.scan(docs.withColumns({"_key": F.lit(1), "r": F.lit(2)}), bench, "SOURCE", **groups)
    assert many.columns == [*docs.columns, "_key", "r"] and many.count() == docs.count()
    assert decontaminate.scan(docs, bench, "c", **groups).columns == [*docs.columns, "c"] and decontaminate.scan(empty, bench, "c", **groups).count() == 0
    assert decontaminate.report(decontaminate.scan(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.scan(empty, bench, "words").columns == docs.columns
    assert decontaminate.scan(docs, bench, "words").count() == docs.count()


def sections_by_hand(coder, parts, rule):
    """Tokens and crossings of each part, token by token."""
    spans, at = [], 0
    for p in parts:
        spans.append((at, at + len(p.encode())))
        at = spans[-1][1]
    tokens, crossing, at = [0.0] * len(parts), [0] * len(parts), 0
    for token in coder.encode_ordinary("".join(parts)):
        a, at = at, at + len(coder.decode_single_token_bytes(token))
        inside = [max(0, min(at, y) - max(a, x)) for x, y in spans]
        first = next(i for i, n in enumerate(inside) if n)
        crossing[first] += sum(n > 0 for n in inside) > 1
        if rule == "share":
            tokens = [t + n / (at - a) for t, n in zip(tokens, inside)]
        else:
            tokens[first if rule == "first" else inside.index(max(inside))] += 1
    return tokens, crossing


def test_section_tokens(spark, docs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coder, _ = tokencount.encoder(path, pattern)
    rng = random.Random(6)
    odd = ["a\n\n b\n", "\n", "tail", "Ärger\r\nnaïve 日本語\n🙂\n", "x" * 20_000 + "\n" + "y" * 50, "word \n  word\n\n\nmore", None, ""]
    texts = odd + ["".join(rng.choices(["a", " ", "\n", "the ", "é", "🙂", "12"], k=60)) for _ in range(20)]
    rows = [(i if i % 5 else None, t, "x", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, section string, tokens int")
    got = Counter((r["doc_id"], r["section"], r["start"], r["stop"], r["tokens"], r["crossing"]) for r in tokencount.count(table, path, pattern).collect())
    want = Counter()
    for doc_id, text, _, _ in [*rows, rows[1]]:
        parts = (text or "").split("\n")
        parts = [p + "\n" for p in parts[:-1]] + parts[-1:]
        parts = [p for i, p in enumerate(parts) if not i or p]
        at = 0
        for i, (p, n, c) in enumerate(zip(parts, *sections_by_hand(coder, parts, "first"))):
            want[doc_id, i, at, at + len(p), n, c] += 1
            at += len(p)
    assert got == want
    fields = spark.createDataFrame([(i, *("".join(rng.choices(["ab", "c", " ", "é", "don", "'t", "12"], k=rng.randint(0, 4))) for _ in range(4))) for i in range(40)] + [(40, None, None, None, None)], "doc_id int, a string, b string, c string, d string")
    by_id = {r["doc_id"]: ["" if x is None else x for x in list(r)[1:]] for r in fields.collect()}
    for rule in tokencount.RULES:
        rows = tokencount.count(fields, path, pattern, fields=["a", "b", "c", "d"], rule=rule).collect()
        for k, parts in by_id.items():
            tokens, crossing = sections_by_hand(coder, parts, rule)
            own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["section"])
            assert [r["tokens"] for r in own] == pytest.approx(tokens) and [r["crossing"] for r in own] == crossing
    assert tokencount.count(empty, path, pattern).count() == 0
    with pytest.raises(ValueError):
        tokencount.count(docs, path, pattern, rule="other")


def test_lm_score(spark, docs, empty):
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, 1, 1)] * 9, docs.schema)).withColumn("block", F.lit("x")).withColumn("h", F.lit(1))
    learns = F.pmod(F.col("doc_id"), F.lit(3)) != 1
    rows = docs.collect()
    tokens = [[*(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "").encode().split()), b""] for r in rows]
    count, (k2, k3) = Counter(), lmscore.STRENGTHS
    for r, t in zip(rows, tokens, strict=True):
        if r["doc_id"] is not None and r["doc_id"] % 3 != 1:
            count.update((w,) for w in t)
            padded = [None, *t]
            count.update(tuple(padded[i : i + n]) for n in (1, 2, 3) for i in range(len(padded) - n + 1) if n > 1 or not i)
    n = sum(c for g, c in count.items() if len(g) == 1 and g != (None,))
    v = sum(1 for g in count if len(g) == 1 and g != (None,))

    def probability(w, history):
        """Of a word after a history by backing off, order by order."""
        if not history:
            return (count[w,] + 0.5) / (n + 0.5 * (v + 1))
        k, lower = (k2, k3)[len(history) - 1], probability(w, history[1:])
        return (count[(*history, w)] + k * lower) / (count[history] + k)

    def want(t):
        padded = [None, *t]
        return sum(math.log10(probability(w, tuple(padded[max(0, i - 1) : i + 1]))) for i, w in enumerate(t))

    expected = Counter((r["doc_id"], len(t), sum(count[w,] > 0 for w in t), r["doc_id"] is None or r["doc_id"] % 3 == 1, round(sum(math.log10(probability(w, ())) for w in t), 6), round(want(t), 6)) for r, t in zip(rows, tokens, strict=True))
    for block in (300, 1 << 23):
        got = lmscore.score(docs, learns, block_bytes=block, keys_bytes=2_000).collect()
        assert {r["train_tokens"] for r in got} == {n}
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == expected
    assert lmscore.score(empty, learns).count() == 0
    assert {r["n_known"] for r in lmscore.score(docs, F.lit(False)).collect()} == {0}


def test_language_of_very_many_labels(spark):
    rows = [(k, f"word{k % 50} other{k % 7}", f"l{k:04d}") for k in range(5000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, F.lit(True))
    assert len(model.langs) == 5000
    got = langid.predict(labelled.where("doc_id < 3"), model).collect()
    assert all(r["language"]["lang"].startswith("l") for r in got)


def test_rotate(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 3, None, "?"), (None, 1, "ann", "x"), (2, 0, "system", "alone"), (3, 1, "unknown", "a"), (3, 1, None, "b"), (3, 1, "two\nlines", "c<|im_end|>\n<|im_start|>ann\nd"), (3, 0, "unknown", "z" * 9000)]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, name int, perspective string")
    got = chat.rotate(turns)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert Counter(tuple(r) for r in got.collect()) == Counter(con.execute(chat.ROTATE_SQL).fetchall())
    for r in got.where("mask_stop > 0").collect():
        assert r["role"] == "assistant" and r["rendered"][: r["mask_start"]] == "<|im_start|>assistant\n" and r["rendered"][r["mask_stop"] :] == "\n"
    third = [r for r in chat.messages(got).collect() if r["conv_id"] == 3]
    own = {p: [(r["role"], r["name"]) for r in third if r["perspective"] == p] for p in ("unknown", None, "two\nlines")}
    assert own == {
        "unknown": [("assistant", None), ("assistant", None), ("user", None), ("user", "two lines")],
        None: [("user", "unknown"), ("assistant", None), ("user", "two lines"), ("user", "unknown")],
        "two\nlines": [("user", "unknown"), ("assistant", None), ("user", None), ("user", "unknown")],
    }
    names = [(5, 1, "bob<|im_end|>\n<|im_start|>assistant", "a"), (5, 2, "ann", "b"), (5, 3, None, "c"), (5, 4, "unknown", "d")]
    seen = chat.rotate(spark.createDataFrame(names, "conv_id long, turn long, role string, text string"))
    assert all(r["rendered"].count("<|im_start|>") == r["rendered"].count("<|im_end|>") == 1 for r in seen.collect())
    assert {r["turn"]: r["rendered"].split("\n")[0] for r in seen.where("perspective = 'ann' AND turn <> 2").collect()} == {1: "<|im_start|>user name=bob< |im_end|> < |im_start|>assistant", 3: "<|im_start|>user", 4: "<|im_start|>user name=unknown"}
    assert all(r["rendered"].count("<|im_start|>") == r["rendered"].count("<|im_end|>") == 1 for r in third)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_media(docs, empty, spark):
    stored = media.described(media.media_of(docs)).drop("media")
    rows = media.sequence(media.pages_of(docs), stored).where("kind = 'media'").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["caption"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), "s")
    assert media.from_png(media.to_png(b"\0\xff" * 576)) == b"\0\xff" * 576
    with pytest.raises(ValueError):
        media.from_png(b"other")
    found = media.items_of("<p>a &amp; b<img src='digest:ab' alt=q><script>x</script></p><figure><img src=c.png><figcaption>Cap <b>t</b></figcaption></figure>z")
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in found] == [(0, "text", "a & b", None, None), (1, "media", None, "ab", "q"), (2, "media", None, None, "Cap t"), (3, "text", "z", None, None)]
    plain = lambda html: [(i["kind"], i["text"], i["caption"]) for i in media.items_of(html)]
    assert plain("<figure><img src=a><figcaption>Cap</figure><p>after</p>") == [("media", None, "Cap"), ("text", "after", None)]
    assert plain("<article><figure><img src=a><figcaption>Cap</article><p>after</p>") == [("media", None, "Cap"), ("text", "after", None)]
    assert plain("<figure><figcaption>First</figcaption><img src=a><img src=b alt=c></figure>x") == [("media", None, "First"), ("media", None, "First"), ("text", "x", None)]
    assert plain("a<figcaption>Alone</figcaption>b<figure><figcaption>No media</figcaption></figure>") == [("text", "a", None), ("text", "Alone", None), ("text", "b", None), ("text", "No media", None)]
    assert plain("<figure><img src=a></figure><p>a<br>b</p><figcaption>never ended") == [("media", None, None), ("text", "a b", None), ("text", "never ended", None)]
    assert plain("<table><tr><td>a</td><td>b</td></tr><tr><th>c<th>d</table><dl><dt>e<dd>f</dl>") == [("text", "a b", None), ("text", "c d", None), ("text", "e", None), ("text", "f", None)]
    assert plain("<figure><img src=a alt=q><figcaption>One</figcaption><figcaption>two</figcaption></figure>") == [("media", None, "One two")]
    assert plain("<figure><figcaption>One</figcaption><figcaption>two</figcaption><img src=a><figcaption>three</figcaption></figure>") == [("media", None, "One two three")]
    kept = stored.withColumns({"position": F.lit(99), "caption": F.lit("the store's")})
    taken = media.sequence(spark.createDataFrame([(1, f"<p>x</p><img src='digest:{hashlib.sha256(b'').hexdigest()}' alt=own>", 7, 8)], "id int, html string, _item int, _items int"), kept)
    assert [(r["position"], r["caption"], r["media_position"], r["media_caption"], r["_item"], r["_items"]) for r in taken.orderBy("position").collect()] == [(0, None, None, None, 7, 8), (1, "own", 99, "the store's", 7, 8)]
    clash = docs.withColumn("media", F.lit(b"x")).withColumn("position", F.lit(5)).withColumn("digest", F.lit("y"))
    assert media.sequence(media.pages_of(clash), stored).where("kind = 'media'").count() == docs.count()
    mixed = spark.createDataFrame([(1, f"<p>one</p><img src='digest:{hashlib.sha256(b'').hexdigest()}' alt=none><p>two</p><figure><img src='digest:00'><figcaption>lost</figcaption></figure>three", "x", 3)], "id int, html string, media string, payload_bytes int")
    assert [(r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"]) for r in media.sequence(mixed, stored).orderBy("position").collect()] == [(0, "text", "one", None, None), (1, "media", None, "none", 576), (2, "text", "two", None, None), (3, "media", None, "lost", None), (4, "text", "three", None, None)]
    assert media.media_of(empty).count() == 0 and media.items(spark.createDataFrame([(1, None, 5)], "id int, html string, text int")).count() == 0


def test_site_tree(spark):
    frame = "<html><head><title>t</title></head><body><nav>Home</nav><div class='legal'>All rights</div><article><h1>Title {0}</h1><p>Body &amp; {0}<br>more</p></article><footer>f</footer></body></html>"
    plain = "<div class=a>Same words on each page</div><div class=b>Text {0}</div>"
    rows = [(i, f"http://a.org/{i}", frame.format(i)) for i in range(20)] + [(100 + i, f"https://B.org/{i}", plain.format(i)) for i in range(20)]
    rows += [(200, "http://one.org", plain.format(1)), (201, None, None), (202, "x", ""), (203, "http://a.org/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in sitetree.extract(pages).collect()}
    assert got[3]["text"] == "Title 3 Body & 3 more" and got[107]["text"] == "Text 7"
    assert got[200]["text"] == "Same words on each page Text 1" and got[201]["text"] == got[202]["text"] == ""
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert sitetree.extract(pages.limit(0)).count() == 0
    assert sitetree.extract(pages.union(spark.createDataFrame([(5, "u", "<" * 40_000)], pages.schema))).count() == len(rows) + 1


def main_text(html):
    """The text of a page that is alone on its host: what presentation speaks against goes."""
    low = {n for b in sitetree.blocks_of(html) if b.out for n in sitetree.chain_of(b.path)[-1:]} - {n for b in sitetree.blocks_of(html) if not b.out for n in sitetree.chain_of(b.path)}
    return sitetree.text_of(html, low, set())


def test_site_tree_keeps_pages_with_names_of_parts():
    assert main_text("<body class='has-sidebar'><p>Whole text</p><footer>f</footer></body>") == "Whole text"
    assert main_text("<body><main class='content with-sidebar'><p>Whole text</p><div class='sidebar'>s</div></main></body>") == "Whole text"
    assert main_text("<body><article class='post comments-open'><p>Whole text</p></article></body>") == "Whole text"
    assert main_text("<body><form><fieldset><div class='page-with-menu'><main><p>Whole text</p></main></div></fieldset></form></body>") == "Whole text"
    assert main_text("<body><form><div><p>Whole text of a page</p></div></form><div>small print</div></body>") == "Whole text of a page small print"
    assert main_text("<body><nav>n</nav><div class='no-sidebar'><p>Whole text</p><aside>a</aside></div><footer>f</footer></body>") == "Whole text"
    assert main_text("<body><article><p>Text of an article</p><form>Search</form><div class='share'>Share</div></article></body>") == "Text of an article"
    assert main_text("<html><head><title>t</title></head><body><nav>n</nav></body></html>") == ""


def test_site_tree_names_that_say_more():
    """A name that says more than a part's gives way where the element holds most of the page."""
    for name in ("content search-results", "notice-of-results", "comments-on-war"):
        assert main_text(f"<div class='{name}'><p>The whole text of this page</p></div><div class='cookie-banner'>Take it</div>") == "The whole text of this page"
        assert main_text(f"<article><section id='{name}'><p>The whole text</p></section></article>") == "The whole text"
    assert main_text("<p>The longer text of the page itself</p><div class='search-results'>a b</div><div id='comments'><p>" + "c " * 99 + "</p></div>") == "The longer text of the page itself"


def test_site_tree_against_brute_force(spark):
    """Importance of every node of merged pages, worked out by hand from the blocks, and what it removes."""
    rng = random.Random(4)
    frames = ["<nav><ul><li><a href=a>{m}</a></li></ul></nav><div class='box'><div class='x'>{a}</div><p>{b}</p></div><div class='go'><a href=1>x</a> <a href=2>{d}</a>{e}</div><div class='legal'>{c}</div>", "<article><h1>{a}</h1><p>{b}</p></article><div class='legal'>{c}</div><footer>{m}</footer>"]
    rows = [(i, f"http://h{i % 3}.org/{i}", frames[rng.random() < 0.4].format(m=rng.choice("abc"), a=f"head {rng.randint(0, 9)}", b=f"body {rng.randint(0, 30)} of the page", c=rng.choice(["same", "same", "same", f"n{i}"]), d=rng.randint(0, 9), e=rng.choice(["", "", " pq"]))) for i in range(120)]
    pages = spark.createDataFrame([*rows, rows[5]], "page_id long, url string, html string")
    counts = {}

    def even(values, n):
        return -sum(c / n * math.log2(c / n) for c in values.values()) / math.log2(n) if n > 1 else 1.0

    for host in range(3):
        said = {}
        for _, url, html in rows:
            if f"//h{host}." in url:
                blocks = sitetree.blocks_of(html)
                by_path = {b.path: [x.text for x in blocks if x.path == b.path] for b in blocks}
                out = {p: all(b.out for b in blocks if b.path == p) for p in by_path}
                form = {p: (("a a -", 0.125) if "pq" in html else ("a a", 1.0)) if p.endswith("div.go") else ("a" if p.endswith("/li") else "-", 0.0) for p in by_path}
                body = repr(sorted((p, t) for p, t in by_path.items() if p in sitetree._body({p: "\n".join(t) for p, t in by_path.items() if not out[p]})))
                for p, t in by_path.items():
                    said.setdefault(p, {}).setdefault(("\n".join(t), body), []).append((out[p], *form[p]))
        for p, by_text in said.items():
            n, texts = len(by_text), Counter(t for t, _ in by_text)
            entropy = even(texts, n)
            styles = Counter(min(o[1] for o in x) for x in by_text.values())
            linked = sum(min(o[2] for o in x) for x in by_text.values()) / n
            counts[f"h{host}.org", p] = n, 1 - sum(min(o[0] for o in x) for x in by_text.values()) / n, 1 - linked * (1 - (n * even(styles, n) + 4) / (n + 4)), (n * entropy + 1) / (n + 1)
    found = {(r["host"], tuple(r["chain"])): (r["pages"], r["presented"], r["form"], r["content"]) for r in sitetree.leaves(sitetree.said_of(pages)).collect()}
    assert found.keys() == {(h, tuple(sitetree.chain_of(p))) for h, p in counts}
    for (h, p), want in counts.items():
        assert found[h, tuple(sitetree.chain_of(p))] == pytest.approx(want)
    tree = {(r["host"], r["node"]): (r["best"], r["importance"]) for r in sitetree.nodes(sitetree.leaves(sitetree.said_of(pages))).collect()}
    for key, got in tree.items():
        below = [c for (h, p), c in counts.items() if h == key[0] and key[1] in sitetree.chain_of(p)]
        n = sum(c[0] for c in below)
        assert got == pytest.approx((max(c[1] * c[2] for c in below), sum(c[0] * c[1] * c[2] * c[3] for c in below) / n))
    whole = sorted(tuple(r) for r in sitetree.extract(pages).collect())
    assert whole == sorted(tuple(r) for r in sitetree.extract(pages, broadcast_entries=0).collect()) and len(whole) == 121
    assert all(f"body {re.search('body ([0-9]+)', r[2])[1]} of the page" in t[2] and not re.search(r"\b[abc]\b", t[2]) for r, t in zip(sorted([*rows, rows[5]]), whole))


def test_site_tree_forms(spark):
    """Menus of one form go whatever their names and words are, and text beside parts that go stays."""
    wrapped = "<h1>Head {0}</h1><div class=wrap><nav>a</nav><aside>b {0}</aside><div class=text>Text {0} of this page</div></div>"
    menu = "<div class=top><a href=a>Home{0}</a> <a href=b>About</a>\n<a href=c>More{0}</a></div><div class=text><p>Text {0} <a href=x>with</a> <a href=y>links</a></p></div><div class=end>Rights {0}</div>"
    linked = "<h1><a href=a>Head</a> <a href=b>{0}</a></h1><article><p><a href=c>One</a> <a href=d>{0}</a></p></article>"
    rows = [(f"{host}{i}", f"http://{host}.org/{i}", frame.format(i)) for host, frame, n in (("a", wrapped, 20), ("b", menu, 20), ("c", menu, 2), ("d", linked, 20)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(pages.withColumns({"text": F.lit("clash"), "host": F.lit(1), "nodes": F.lit(2), "said": F.lit(3)})).collect()}
    for i in range(20):
        assert got[f"a{i}"] == f"Head {i} Text {i} of this page" and got[f"b{i}"] == f"Text {i} with links Rights {i}" and got[f"d{i}"] == f"Head {i} One {i}"
    assert got["c1"] == "Home1 About More1 Text 1 with links Rights 1"  # two pages prove little


def test_site_tree_raw_elements():
    for raw in ("<video-js>v</video-js>", "<svg-icon>v</svg-icon>", "<object-list>v</object-list>", "<math-field>v</math-field>"):
        assert main_text(f"<p>One</p>{raw}<p>two</p>") == "One v two"
    for raw in ("<svg viewBox='0 0 1 1'/>", "<math />", "<video src=a>", "<iframe src=a>", "<noscript>", "<object data='a>b'>", "</svg>"):
        assert main_text(f"<p>One</p>{raw}<p>two</p>") == "One two", raw
    assert main_text("<p>One</p><svg/><p>two</p><svg><text>s</text><svg>t</svg>u</svg><p>three</p>") == "One two three"
    assert main_text("<p>One</p><video><p>two</p><video>v</video><p>three</p><script>var a = '</p><svg>';</script ><style>s") == "One two three"
    assert main_text("<p>One</p><textarea>a <b <textarea></textarea><p>two</p><script>s <p>t</p>") == "One two"
    assert main_text("<p>One</p><iframe src=a><p>two</p><iframe src=b>b</iframe>") == "One two"
    assert main_text("<p>One</p>" + "<svg>" * 100_000 + "<p>two</p>") == "One two"


def test_site_tree_text_outside_articles():
    cards = "".join(f"<article class='card'><p>Card {i}</p></article>" for i in range(3))
    assert main_text(f"<div class='content'><p>The main text of this page is here</p></div>{cards}") == "The main text of this page is here Card 0 Card 1 Card 2"
    article = "<article><p>The text of the article itself, which is longer</p></article>"
    assert main_text(f"<div class='legal'>All rights</div><h1>Headline</h1><div>By A</div>{article}<div>after</div>") == "Headline By A The text of the article itself, which is longer"
    assert main_text(f"<div class='lead'>Lead</div><p>Second</p>{article}<p>after</p>") == "Lead Second The text of the article itself, which is longer"
    for name in ("headline", "public", "client"):
        assert main_text(f"<div class='{name}'><h2><a href='/a'>Linked</a></h2></div><p>text</p>") == "Linked text"
    assert main_text("<ul><li class='a'><a href='/a'>Linked</a></li><li><div><a href='/a'>Linked</a></div></li></ul><p>text</p>") == "text"


def test_site_tree_copies_of_one_body(spark):
    article = "<div class='legal'>All rights</div><article><h1>Title {0}</h1><div class='date'>day {0}</div><p>{1}</p></article>"
    plain = "<h1>Title {0}</h1><div class='text'>{1}</div>"
    shared = [("Shared words of the body", i) for i in range(180)] + [(f"Own words of body {i}", i) for i in range(180, 200)]
    rows = [(f"{host}{i}", f"http://{host}.org/{i}", frame.format(i, body)) for host, frame in (("a", article), ("b", plain)) for body, i in shared]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for body, i in shared:
        assert got[f"a{i}"] == f"Title {i} day {i} {body}" and got[f"b{i}"] == f"Title {i} {body}"
    notice = [(i, "http://c.org/", f"<div class='a'>{'Own words' if i == 7 else 'Notice'}</div><div class='b'>Text {i}</div>") for i in range(100)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(notice, "page_id long, url string, html string")).collect()}
    assert got[7] == "Own words Text 7" and got[8] == "Text 8"


def test_license_scan(spark):
    grant = licenses.TEMPLATES["MIT-permission"]
    near = grant.replace("charge", "costs", 1)
    texts = [prose(30) + " " + grant + " " + prose(9), near, grant, grant + " " + grant, None, "", "four words are short", licenses.TEMPLATES["CC-BY-4.0"], "x " * 3000 + grant, grant.replace(" of ", " or ")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == sorted(con.execute(licenses.scan_sql()).fetchall())
    assert licenses.scan(docs).where("doc_id in (0, 2, 3, 8) and license = 'MIT-permission' and containment = 1").count() == 4
    assert licenses.scan(docs.limit(0)).count() == licenses.scan(docs, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "a b"})


def test_license_texts_changed_and_cut(spark):
    """Whole licenses with words changed, put in, doubled and cut, in rows that repeat ids, against SQL over every window."""
    rng, rows = random.Random(7), []
    for i in range(60):
        body = rng.choice(list(licenses.TEXTS.values())).split()
        rate = rng.choice([0, 0.01, 0.04])
        body = ["zz" if rng.random() < rate else x for x in body]
        body = rng.choice([body, body, body + body, body[: len(body) * 9 // 10], body[:40] + ["put", "in"] + body[40:]])
        rows.append((rng.choice([None, i, i // 2]), " ".join(["the", "software"] * rng.randint(0, 20) + body + ["is"] * rng.randint(0, 9))))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("h", F.lit(1))
    con = duckdb.connect()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": [t for _, t in texts]}))  # each row by itself
    want = {}
    for row, name, part, first in con.execute(licenses.scan_sql()).fetchall():
        key = (texts[row][0], name)
        want[key] = max(want.get(key, (0, 0)), (part, -first))
    assert {(r[0], r[1]): (r[2], -r[3]) for r in licenses.scan(docs).collect()} == want
    assert licenses.scan(docs).where("doc_id is null and license like '%-text'").count() > 0


def test_license_templates_of_thousands_of_words(spark):
    long = " ".join(f"q{i}" for i in range(6000))
    docs = spark.createDataFrame([(1, "x y " + long + " z"), (2, long[:9000])], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(docs, {"long": long}).collect()] == [(1, "long", 1.0, 2)]
    with pytest.raises(ValueError):
        licenses.scan(docs, {"longer": " ".join(f"q{i}" for i in range(licenses.MAX_SHINGLES + 5))})


def test_language(spark, empty):
    found = queries.op8_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
    share = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share >= 0.95
    model = langid.Model({"aa": {"tick": 3, "tock": 1}, "bb": {"ping": 2}})
    got = model.predict(["tick", "PING pong", "", "12 34 !", "tic"])
    assert [g[0] for g in got] == ["aa", "bb", "und", "und", "aa"] and all(0 <= g[1] <= 1 for g in got)
    none = langid.predict(empty, langid.fit(empty, F.lit(True)), "lang")
    assert none.count() == 0 and none.columns == empty.columns
    nothing = langid.Model({})
    assert nothing.predict(["abc"]) == [("und", 0.0)]


def test_language_ties_repeats_and_long_texts(spark):
    model = langid.Model({"bb": {"same": 2, "ping": 1}, "aa": {"same": 2, "pong": 1}})
    rows = [(1, "same", 5, "x"), (1, "same", 5, "x"), (None, "ping " * 200_000, 5, "x"), (2, "pong" * 50_000, 5, "x"), (3, None, None, None), (None, "", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language int, _language string")
    got = langid.predict(docs, model).select("doc_id", "language.lang", "language.score", "_language").collect()
    assert [(r[0], r[1]) for r in got] == [(1, "aa"), (1, "aa"), (None, "bb"), (2, "aa"), (3, "und"), (None, "und")]
    assert got[0][2] == got[1][2] == 0.5 and got[4][2] == got[5][2] == 0 and [r[3] for r in got] == ["x"] * 4 + [None, "x"]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4


def test_language_against_brute_force(spark):
    """Scores worked out from the definition: known words by their log frequency, others by the mean of their longest known n-grams."""
    rng = random.Random(8)
    spoken = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(30)] for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "éñab"))}
    rows = [(i, " ".join(rng.choices(spoken[lang], k=20)), lang) for i, lang in enumerate(rng.choices([*spoken], k=60))]
    rows += [(None, "abc abc", "aa"), (90, "x" * 3, None), (91, None, "bb")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, F.lit(True))
    words = {lang: Counter(w for _, t, x in rows if x == lang and t for w in t.split()) for lang in spoken}
    grams = {lang: [Counter() for _ in range(5)] for lang in spoken}
    for lang, counted in words.items():
        grams[lang][0] = counted
        for w, n in counted.items():
            marked = f"<{w}>"
            for size in range(1, 5):
                for i in range(len(marked) - size + 1):
                    grams[lang][size][marked[i : i + size]] += n

    def log(lang, size, g):
        known = set().union(*(grams[x][size] for x in spoken))
        return math.log((grams[lang][size][g] + 0.5) / (sum(grams[lang][size].values()) + 0.5 * (len(known) + 1)))

    def word(lang, w):
        if any(grams[x][0][w] for x in spoken):
            return log(lang, 0, w)
        marked, places = f"<{w}>", []
        for i in range(len(marked)):
            size = next((k for k in range(min(4, len(marked) - i), 0, -1) if any(grams[x][k][marked[i : i + k]] for x in spoken)), 1)
            places.append(log(lang, size, marked[i : i + size]))
        return sum(places) / len(places)

    texts = ["abc", "zzz", " ".join(spoken["aa"][:3] + ["éé", "cdx"]), spoken["bb"][0] * 3, "ñandú abc", "a-b_c 12 é", "ab " * 5000, "", None, "1 2"]
    tested = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, language string, lang int")
    got = {r["doc_id"]: r["language"] for r in langid.predict(tested, model).collect()}
    assert got[len(texts)] == got[0]
    for i, text in enumerate(texts):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            assert tuple(got[i]) == ("und", 0.0)
            continue
        sums = {lang: sum(word(lang, w) for w in found) for lang in spoken}
        best = min(spoken, key=lambda x: (-sums[x], x))
        assert got[i]["lang"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel=1e-6)


def test_pack(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = pack.Encoder(path)
    odd = ["a,b. c", "it's 'S don't", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト。", "é É İi ǅ", "a b　c\x0bd e", "x" * 5000, "1234,5.6", "...", "ﬁ ½ Ⅷ", "\0a \0", "a​b", "🙂👍🏽 ok", "ß SS ẞ"]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    cased = json.loads(Path(path).read_text())
    cased["normalizer"]["normalizers"] = cased["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    for coder in (coder, pack.Encoder(str(tmp_path / "cased.json")), pack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))):
        for text, raw in zip(texts, pack._encoded(coder, pa.array(texts)), strict=True):
            whole = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert raw == b"".join(i.to_bytes(4, "little") for i in whole), text
    assert coder.by_word is False and pack.Encoder(path).by_word and list(pack._encoded(coder, pa.array([], pa.string()))) == []
    rows = pack.pack(docs, path).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, own in by_doc.items():
        ends = sorted((r["start"], r["start"] + r["length"]) for r in own)
        if k != 3:  # the row that is there twice
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == own[0]["doc_tokens"]
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0 for r in own)
    assert len(by_doc) == docs.select("doc_id").distinct().count() and pack.pack(empty, path).count() == 0
    pack.write_buckets(pack.pack(docs, path), str(tmp_path / "buckets"))
    stored = spark.read.parquet(str(tmp_path / "buckets"))
    assert Counter((r["bucket"], r["ids"]) for r in stored.collect()) == Counter((r["length"], r["ids"]) for r in rows)
    clashing = docs.withColumn("_text", F.lit("x")).withColumn("_pieces", F.lit(1)).withColumn("start", F.lit(2))
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in pack.pack(clashing, path).collect()) == sorted((r["doc_id"], r["start"], r["ids"]) for r in rows)
    with pytest.raises(ValueError):
        pack.pack(docs, path, length=1000)


def test_known_words_take_bounded_memory(spark, monkeypatch):
    """However many words there are and however long, what is kept of them is a fixed number of bytes; results are the same for any bound and slices."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) + "語é"[k % 2] * (k % 60) for k in range(12_000)]
    texts = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
    counts = {"a": {"some": 2, "words": 1}, "b": {"others": 3}}
    ids, named = list(pack._encoded(pack.Encoder(path), pa.array(texts))), langid.Model(counts).predict(texts)
    for module in (pack, langid):
        monkeypatch.setattr(module, "KEEP_BYTES", 1 << 18, raising=False)
    coder, model, most = pack.Encoder(path), langid.Model(counts), [0, 0]
    for text, raw, lang in zip(texts, ids, named, strict=True):
        assert list(pack._encoded(coder, pa.array([text]))) == [raw] and model.predict([text]) == [lang]
        held = sum(map(sys.getsizeof, coder.known)) + coder.ids[: coder.used].nbytes, sum(map(sys.getsizeof, model.seen)) + model.known.nbytes
        most = list(map(max, most, held))
    assert max(most) < 1 << 19, most  # the bound and one text's words
    docs = spark.createDataFrame(list(enumerate([None, "", *texts[:20]])), "doc_id long, text string").coalesce(1)
    small, large = (pack.pack(docs, path, slice_bytes=n).collect() for n in (10, 1 << 30))
    assert small == large and {r["doc_id"] for r in small} == set(range(22))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Least id reachable over links of three bits or fewer, by comparing all pairs."""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in ids}


def test_simhash(docs, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: fingerprint(t) for k, t in texts.items()}
    got = simhash.components(docs).collect()
    near = classes(want)
    assert len(got) == docs.count() and all((r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", near[r["doc_id"]]) for r in got)
    kept = simhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(near.values())) and kept.columns == docs.columns
    assert simhash.components(empty).count() == simhash.keep_first(empty).count() == 0


def test_simhash_keeps_one_row_of_each_component(spark):
    texts = [f"{name} stands alone among all of the other texts of this table {name}" for name in ("first", "second", "third", "fourth")]
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() > 3 for a in texts for b in texts if a != b)
    rows = [(1, texts[0], "a"), (2, texts[0], "b"), (2, texts[1], "c"), (None, texts[2], "d"), (None, texts[2], "d"), (None, texts[1], "e"), (3, texts[3], "f"), (3, texts[3], "f"), (None, None, "g"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["_key"] for r in kept.collect()) == Counter("acdfg")


@pytest.mark.parametrize("max_run", [20_000, 4])
def test_simhash_links(spark, max_run):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:25]:
        for _ in range(6):
            p ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
            prints.add(p)
    crowd = rng.getrandbits(32) << 32
    prints |= {crowd | rng.getrandbits(32) for _ in range(60)} | {crowd | (1 << a) for a in range(32)}
    ids = dict(enumerate(sorted(prints)))
    signed = {k: p - (1 << 64) if p >> 63 else p for k, p in ids.items()}
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed.values()], "fp long"), max_run)
    back = {p: k for k, p in signed.items()}
    roots = {r["node"]: r["root"] for r in simhash.classes(edges).collect()}
    mine = {}
    for k, p in signed.items():
        mine.setdefault(roots.get(p, p), set()).add(k)
    want = {}
    for k, r in classes(ids).items():
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and len(back) == len(ids)


def test_pipeline(spark, docs, tmp_path):
    """Every piece of every document that is left, and no other, by brute force at each stage; ids may be null."""
    import corpus_pipeline

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    alone = "a text without an id that is like no other one of this table"
    rows = rows.union(spark.createDataFrame([(None, alone, "en", "s", 60), (None, alone, "en", "s", 60), (None, None, None, None, None)], rows.schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect() if r["doc_id"] is not None}
    item = words_of(texts[67])[20:40]
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    letters = {k: t for k, t in texts.items() if any(c.isalpha() for c in t or "")}
    prints = {k: fingerprint(t) for k, t in letters.items()}
    assert all((fingerprint(alone) ^ p).bit_count() > 3 for p in prints.values())
    windows = {tuple(item[i : i + 10]) for i in range(11)}
    own = {k: words_of(letters[k]) for k in set(classes(prints).values())}
    clean = {k: letters[k] for k, w in own.items() if not any(tuple(w[i : i + 10]) in windows for i in range(len(w)))} | {None: alone}
    assert 67 in own and 67 not in clean and 0 in clean
    coder, want = pack.Encoder(path).tokenizer, []
    for k, text in clean.items():
        ids, start = [*coder.encode(text, add_special_tokens=False).ids, 1], 0
        sizes = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]
        for n in sizes:
            piece = b"".join(i.to_bytes(4, "little") for i in ids[start : start + n])
            want.append((k, start, n, zlib.crc32(piece), len(ids)))
            start += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == Counter(want)
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    kept = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == rows.columns
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), str(tmp_path)).count() == 0
