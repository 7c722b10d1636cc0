"""Blocks, parts, chunks, protection, repairs and checks of Markdown."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import cleanup, markdown as M, protect as P, pseudocode, text as T, validate
from inkstrata.operators import segment

PAPER = """# A Study

Intro with token and $a_1$, `code` and [link](https://e.org/x).

![](images/a1.jpg)

Table 1. Sizes.

<table><caption>Rows **here**</caption><tr><td>1</td></tr></table>

```python
x = 1

y = 2
```

## REFERENCES

[1] Someone. A title.

### Sub

more refs

## APPENDIX

Final words.
"""


def by_hand_blocks(text):
    """An independent scanner: lines, fence state, blank runs."""
    out, buf, fence, blank = [], "", False, False
    for line in text.splitlines(keepends=True):
        s = line.strip()
        if not fence and blank and s:
            out.append(buf)
            buf, blank = "", False
        buf += line
        if fence:
            fence = not re.fullmatch(r"`{3,}|~{3,}", s)
        elif re.match(r"```|~~~", s):
            fence = True
        elif not s:
            blank = True
    return [*out, buf] if buf else out


def test_blocks_agree_with_a_scanner(values):
    rng = random.Random(5)
    texts = ["", "\n\n", "a", "a\n\n\nb\n", "```\nx\n\ny", "~~~\nx\n```\n\nz", "  ```x```\n\nq\n```\n\nr", PAPER, "a\r\n\r\nb", "x \n \t \n\ny"]
    bits = ["a", "```", "~~~", "\n", "\n", "\n\n", " ", "````", "b|c", "\r\n", " ", "```py"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(400)]
    for text, got in zip(texts, values(M.blocks, *texts), strict=True):
        assert got == by_hand_blocks(text), text
        assert "".join(got) == text
    for text, got in zip(texts, values(T.lines, *texts), strict=True):
        assert got == text.splitlines(keepends=True)


def test_long_texts_do_not_exhaust_the_stack(values):
    long = ["$" + "a" * 60_000 + "$", "`" * 3 + "\n" + "x\n" * 40_000, "word " * 40_000, "|a|\n" * 20_000, "x\n\n" * 20_000, "{" * 50_000]
    assert ["".join(b) == t for b, t in zip(values(M.blocks, *long), long, strict=True)] == [True] * len(long)
    assert all(r["text"] is not None for r in values(P.protect, *long))
    assert values(M.table_spans, *long)[0] == []


def test_headings_and_predicates(values):
    assert [tuple(x) if x else None for x in values(M.heading, "## Title ##\nx", " # A", "#no", "text", "#  \n")] == [(2, "Title"), (1, "A"), None, None, (1, "")]
    assert values(M.is_reference_title, "REFERENCES", "7 References", "参考文献", "Bibliography:") == [True, False, True, True]
    assert values(M.is_separator, "|---|:---:|", "--- | ---", "|--|--|", "|---|", " | --- | --- | ") == [True, True, False, False, True]
    assert values(M.is_table_row, "a|b", "  ", "ab") == [True, False, False]
    assert values(M.has_language, "![](a.jpg)", "```\ncode\n```", "a", "<b></b> -- ", "$x$") == [False, False, True, False, True]
    assert values(M.heading_levels, "# a\n text\n  ### b\n####### c\n") == [[1, 3]]
    assert values(M.strong_is_even, "**a**", "a ** b", None) == [True, False, None]


def spans(text):
    return M.table_segments(text)


def test_tables(values):
    pipe = "x\n\n|a|b|\n|---|---|\n|1|2|\n|3|4|\n\nend\n"
    html = "a <table><caption>cap</caption><tr><td>|x|</td></tr></table> b"
    got = values(spans, pipe, html, "none", "|a|b|\n|---|---|")
    assert ["".join(p["text"] for p in g) for g in got] == [pipe, html, "none", "|a|b|\n|---|---|"]
    assert [(p["text"], p["translatable"]) for p in got[0]] == [("x\n\n", True), ("|a|b|\n|---|---|\n|1|2|\n|3|4|\n", False), ("\nend\n", True)]
    assert [p["text"] for p in got[1] if p["translatable"]] == ["a ", "cap", " b"]
    assert [tuple(s) for s in values(M.table_spans, "p|q\n" + pipe)[0]] == [(7, 35)]


def test_parts_of_a_paper(values):
    parts = values(lambda c: segment.parts_of(c), PAPER)[0]
    assert "".join(p["text"] for p in parts) == PAPER.replace("REFERENCES", "参考文献")
    free = "".join(p["text"] for p in parts if p["translatable"])
    assert "Intro" in free and "Rows **here**" in free and "Final words" in free and "# A Study" in free
    assert not any(x in free for x in ("Someone", "more refs", "x = 1", "images/a1", "<td>"))
    kept = values(lambda c: segment.parts_of(c, translate_references=True), PAPER)[0]
    assert "Someone" in "".join(p["text"] for p in kept if p["translatable"]) and "".join(p["text"] for p in kept) == PAPER
    front = values(lambda c: segment.parts_of(c), "---\ntitle: x\n---\n\nbody")[0]
    assert [p["translatable"] for p in front] == [False, True]


def test_chunks(spark):
    text = "".join(f"word{i} " * 40 + "\n\n" for i in range(20)) + "```\ncode\n```\n\ntail"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = segment.document_chunks(docs, 1000).orderBy("doc_id", "chunk_no").collect()
    assert "".join(r["text"] for r in rows if r["doc_id"] == 1) == text and {r["doc_id"] for r in rows} == {1}
    assert all(len(r["text"]) <= 1000 for r in rows) and [r["translatable"] for r in rows][-2:] == [False, True]
    assert segment.greedy([400, 700, 300, 50, 2000, 10], [True, True, True, False, True, True], 1000) == [0, 1, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        segment.document_chunks(docs, 10)


def test_split_position(values):
    text = "A sentence here. " * 30 + "\n\n" + "Other words. " * 30
    at = values(lambda c: segment.split_position(c, 100), text, "short", "x" * 900, "a $" + "b " * 400 + "$ c")
    assert at[0] == text.index("\n\n") + 2 and at[1:] == [None, None, None]


SAMPLES = ["Use $x$ and `c` with ![](a.png) **bold** [l](http://e.org/a) <b>t</b> &amp; https://e.org/path, token tokens", "", "__MDT_", "$$a$$ \\(b\\) \\[c\\] <!-- d --> ~~~\nq\n~~~ mailto:x@y.z）尾", r"\$5 and \** $a\$b$"]


def test_protect_and_restore(values):
    got = values(lambda c: P.protect(c, ("token",)), *SAMPLES)
    first = [r["value"] for r in got[0]["replacements"]]
    assert first == ["$x$", "`c`", "![](a.png)", "**", "**", "http://e.org/a", "<b>", "</b>", "&amp;", "https://e.org/path,", "token"]
    assert [r["value"] for r in got[0]["replacements"] if not r["ordered"]] == ["$x$", "`c`", "token"]
    assert [r["value"] for r in got[3]["replacements"]] == ["$$a$$", "\\(b\\)", "\\[c\\]", "<!-- d -->", "~~~\nq\n~~~", "mailto:x@y.z"]
    assert [r["value"] for r in got[4]["replacements"]] == [r"$a\$b$"]
    back = values(lambda c: P.restore(P.protect(c, ("token",))["text"], P.protect(c, ("token",))), *SAMPLES)
    assert [b["text"] for b in back] == SAMPLES and all(b["error"] is None for b in back)

    def swapped(c):
        from pyspark.sql import functions as F

        p = P.protect(c)
        a, b = p["replacements"][0]["placeholder"], p["replacements"][1]["placeholder"]
        return P.restore(F.concat(b, F.lit(" "), a), p)

    moved = values(swapped, "$a$ `b`", "<b> <i>")
    assert moved[0]["text"] == "`b` $a$" and moved[1]["error"] == "ordered placeholders moved"


def test_gaps_and_matches_in_turn(values):
    texts = ["a1b22c", "1", "", "x", "1\x01a2", "\x01", "$1\\2$", None]
    got = values(lambda c: T.gaps_and_matches(c, "[0-9]+"), *texts)
    assert got == [["a", "1", "b", "22", "c"], ["", "1", ""], [""], ["x"], ["", "1", "\x01a", "2", ""], ["\x01"], ["$", "1", "\\", "2", "$"], None]
    back = values(lambda c: P.restore(P.protect(c)["text"], P.protect(c)), "a \x01 $x$ <b>", "$x$$y$")
    assert [b["text"] for b in back] == ["a \x01 $x$ <b>", "$x$$y$"]


def test_multiset_difference(spark):
    from inkstrata.operators import multisets

    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (None, "x"), (1, None)], "doc_id long, value string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z"), (1, None), (1, None)], "doc_id long, value string")
    assert sorted((r["doc_id"] or 0, r["value"] or "", r["lost"], r["new"]) for r in multisets.difference(a, b).collect()) == [(0, "x", 1, 0), (1, "", 0, 1), (1, "x", 1, 0), (1, "y", 0, 1)]
    assert multisets.difference(a, a).count() == multisets.difference(a.limit(0), b.limit(0)).count() == 0


def test_multiset_difference_within_rows(spark):
    """Arrays of one row differ as rows of values do, and nothing is exchanged for it."""
    from inkstrata.operators import multisets

    docs = spark.createDataFrame([(1, ["x", "x", "y", None], ["x", "y", "y", None, None]), (2, ["z"], ["z"]), (3, None, ["a"]), (4, [], None)], "doc_id long, a array<string>, b array<string>")
    out = docs.select("doc_id", F.explode(multisets.array_difference(F.col("a"), F.col("b"))).alias("x")).select("doc_id", "x.*")
    rows = multisets.difference(docs.select("doc_id", F.explode("a").alias("value")), docs.select("doc_id", F.explode("b").alias("value")))
    key = lambda r: (r["doc_id"], r["value"] or "", r["lost"], r["new"])
    assert sorted(map(key, out.collect())) == sorted(map(key, rows.collect())) == [(1, "", 0, 1), (1, "x", 1, 0), (1, "y", 0, 1), (3, "a", 0, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_placeholders_are_put_back(spark):
    """20,000 ordered spans of one text: each is found by its number, not among all (this took minutes)."""
    import time

    text = "<b> x </b> " * 10_000
    rows = spark.createDataFrame([(text,)], "text string").select("text", F.explode(F.array(P.protect(F.col("text")))).alias("p"))
    turned = F.concat(F.substring("p.text", 25, 10**9), F.substring("p.text", 1, 24))
    began = time.time()
    got = rows.select(P.restore(F.col("p.text"), F.col("p")).alias("b"), P.restore(turned, F.col("p")).alias("t"), F.col("p.replacements")[19_999]["placeholder"].alias("last")).first()
    assert got["b"]["text"] == text and got["b"]["error"] is None and got["t"]["error"] == "ordered placeholders moved" and got["last"].endswith("_19999__")
    assert time.time() - began < 30


def test_prefix_avoids_collisions(values):
    import hashlib

    assert values(P.prefix_of, "abc")[0] == "__MDT_" + hashlib.sha256(b"abc").hexdigest()[:10].upper() + "_"


def test_repairs(values):
    assert values(cleanup.without_outer_fence, "```markdown\nx\n```", "x ```a```") == ["x", "x ```a```"]
    assert values(cleanup.with_outer_space, ("\n a \n\n", "b"), ("  ", "b"), ("a", " b ")) == ["\n b \n\n", "  b", "b"]
    assert values(lambda s, t: cleanup.without_code_terms(s, t, ["tok$en"]), ("tok$en", "a `tok$en` b"), ("`tok$en`", "`tok$en`")) == ["a tok$en b", "`tok$en`"]
    urls = values(
        cleanup.with_url_ends,
        ("see https://e.org/a and https://e.org/ab.", "https://e.org/a中文 https://e.org/ab.x"),
        ("https://arxiv. https://arxiv.org/abs/1.", "https://arxiv.org/abs/1. https://arxiv.org/abs/1.the"),
        ("none", "https://q.r"),
    )
    assert urls == ["https://e.org/a 中文 https://e.org/ab. x", "https://arxiv.org/abs/1. https://arxiv.org/abs/1. the", "https://q.r"]
    assert values(cleanup.with_strong_space, ("**A.** b **c**", "**甲。**乙**丙**"), ("**a** b", "x"), ("a ** ** b", "a****b")) == ["**甲。** 乙 **丙**", "x", "a ** ** b"]


def test_failures(values):
    def check(s, t):
        return validate.failures(s, t, ("token",))

    assert values(check, ("# a $x$", "# b $x$"), ("# a", "## a"), ("a", "__MDT_1"), ("a", "a ** b"), ("$x$", "$y$"), ("<b> <i>", "<i> <b>"), ("<tr>", "<tr><tr>"), ("token", "token token **x**")) == [
        [], ["headings"], ["placeholder left"], ["strong marks unpaired"], ["protected values"], ["protected order"], ["table marks", "protected values", "protected order"], [],
    ]


def test_captions(values):
    before = "![](a.jpg)\n\n图 3 一个图\n表 4 正文说明\n表 5. 名\n(a) 左\n图 6 右\n图7：已\n"
    after = "![](a.jpg)\n\n图3：一个图\n表 4 正文说明\n表5：名\n(a) 左\n图6：右\n图7：已\n"
    assert values(M.caption_openers, before, after, "", "plain\n") == [after, after, "", "plain\n"]
    odd = ["(a) x\n \n\t\n  图 1  名", "![](a)\n(b)\n表 2 名\n表 3 名", "![](a) b\n图 1 名", "图 1\u3000．名", "![](a)\n图 12", "![](a)\n\n图 3.5 名\n"]
    assert values(M.caption_openers, *odd) == ["(a) x\n \n\t\n图1：名", "![](a)\n(b)\n表2：名\n表 3 名", odd[2], "图1：名", odd[4], "![](a)\n\n图3：5 名\n"]


def test_captions_and_splits_of_long_texts(values):
    import time

    text = "![](a.jpg)\n\n图 3 说明\n正文 一行。\n" * 5_000
    began = time.time()
    assert values(M.caption_openers, text)[0].count("图3：说明") == 5_000
    assert values(lambda c: segment.split_position(c, 100), text)[0] is not None
    assert time.time() - began < 30


def test_listings(values):
    block = (
        'x <div class="doc-algorithm">Algorithm 1 Sort<br>1: for $i \\in S$ do<br>2: if $x_{12} \\leq \\frac{a}{b}$ then<br>3: \\mathbf{return} &amp;amp; y<br>'
        "4: else<br>5: z<sup>2</sup><br>6: end if<br>7: end for</div> y <div>keep</div>"
    )
    got = values(pseudocode.plain_listings, block, "plain", None, '<div class="a-algorithm"> </div>')
    assert got[0]["blocks"] == 1
    assert got[0]["text"] == (
        "x **Algorithm 1 Sort**\n\n```text\n1: for i ∈ S do\n2:     if x_12 ≤ (a) / (b) then\n3:         return & y\n4:     else\n5:         z^(2)\n6:     end if\n7: end for\n``` y <div>keep</div>"
    )
    assert (got[1]["text"], got[1]["blocks"], got[2]) == ("plain", 0, None) and got[3]["blocks"] == 0
    assert values(pseudocode.plain_listings, got[0]["text"])[0]["text"] == got[0]["text"]
    assert values(pseudocode.plain_line, r"\hat{x}_{a+b} ^{2} \unknown \{s\} f (x ) < a >", "\t a") == ["hat(x)_(a+b) ^2 unknown {s} f(x) <a>", "     a"]
    assert pseudocode.decoded("&amp;amp;lt;&nbsp;") == "< "
    lines = [r"a \Leftrightarrow b \Longleftrightarrow c", r"\sqrt{\frac{\hat{\mathbf{x}}}{\text{n m}}} \quad y", r"\left( a \right) \, b\\alpha \\_ \$5 $x$", "x_{a b}^{12}y^{n}_{k}", r"\leq\leqslant  , z ( )", "<  a b  >"]
    want = ["a ⇔ b ⇔ c", "sqrt((hat(x)) / (n m)) y", "(a) bα _ $5 x", "x_(a b)^(12)y^n_k", "≤leqslant, z()", "<a b>"]
    assert values(pseudocode.plain_line, *lines) == want
    odd = {
        r"\in\mathbb{R} \in\mathbf{\log x} \text\text{a}": "inR ∈log x texta", r"\frac{a} \frac{1}{\sqrt{x_{12}}}": "frac{a} frac{1}{sqrt{x_12}}", r"x_{a_{b}} \text{a{b}}": "x_{a_b} text{a{b}}",
        r"\hat \foo} {\alpha": "hat foo} {α", r"\text {a \% b": "text {a % b", r"\_{ab} ^{ab} _{} \\quad \;": "_ab ^(ab) _{}", "": "", " \t ": "",
    }
    assert values(pseudocode.plain_line, *odd) == list(odd.values())
    assert values(pseudocode.plain_tags, "a<br/>b<P>c<SUP class=x>2</sup><sub>i<b>j</b></sub><span>d</span>") == ["a\nb\nc^(2)_(ij)d"]


def test_paths(values):
    assert values(T.percent_decode, "a%20b+c", "%zz", "a%zz%20b%", "%C3%BC%2B") == ["a b+c", "%zz", "a%zz b%", "ü+"]
    assert values(T.percent_encode, "a b/ü*+~") == ["a%20b/%C3%BC%2A%2B~"]


def test_references_without_a_semicolon(spark, tmp_path):
    """HTML decodes some; the query, as its SQL, only those that are closed."""
    import hashlib

    from inkstrata.plans import catalog

    pages = [(1, "a &amp&amp; b &copy &middot;&amp</p>"), (2, "&amp;amp;lt; &amp;ampx; &#39;&amp;#39;"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.html_sha256 for r in catalog.entity_decode(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in ((1, "a &amp& b &copy ·&amp</p>"), (2, "< &ampx; ''"), (3, ""))}
    assert pseudocode.decoded(pages[0][1]) == "a && b © ·&</p>"


def test_split_looks_for_spans_alone_in_the_jvm(spark):
    """Words and places are found once in Python, kind by kind; ten more passes over the text made most of the time."""
    docs = spark.createDataFrame([(1, "`a b` ww. ww\nww ww")], "doc_id long, text string")
    plan = segment.halves(docs, min_side=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<=[.!?" not in plan and "[^\\s\\x1C-\\x1F]+" not in plan
    assert [segment.nearest_split(t, [len(t)], n) for t, n in (("ww. ww\nww", 2), ("ww ww\nww", 2), ("ww\n\nww. ww", 2), ("ww ww", 3), (" \n ", 0))] == [4, 6, 4, None, None]
    assert segment.nearest_split("`a b` ww", [0, 5, 8], 2) == 6


def test_long_lines_of_several_scripts(values):
    """A line is read in runs of ASCII; however often scripts change, nothing is lost, and words are seen beside any mark."""
    line = "aé中 " * 60_000
    assert values(lambda c: M.blocks(c), f"{line}\n\n{line}\x1f x")[0] == [f"{line}\n\n", f"{line}\x1f x"]
    assert values(lambda c: M.has_language(c), "**-- __", "a", "é--", "<b></b> *", "`x`", "\x1c　", "![a](b)", "~~~\nx~~~") == [False, True, True, False, True, False, False, False]


def test_running_sums_of_few_and_many(values):
    """Few values are folded one by one, more by blocks: the same sums."""
    sizes = [0, 1, T.FEW - 1, T.FEW, T.FEW + 1, 200]
    got = values(lambda c: T.running(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b), *[",".join(str(k * k) for k in range(n)) for n in sizes])
    assert got == [[sum(k * k for k in range(m)) for m in range(n + 1)] for n in sizes]


def test_plain_paths_are_not_taken_apart(values):
    """Paths without codes or odd steps stay as they are; all others come out as by the whole way."""
    from inkstrata.operators import assets

    odd = ["a/b.c", "", "/", ".", "..", "a/..", "a/../b", "./a", "a//b", "a/", "/a", "a/.b", "a/..b", "...", "a/...", "../a", "a\n/b", None]
    assert values(assets.normalised, *odd) == [None if p is None else assets.steps_to(p) for p in odd]
    assert values(T.percent_decode, "a+b", "a%20b", "%zz+", "", None) == ["a+b", "a b", "%zz+", "", None]
    assert values(T.percent_encode, "a/b:c@d~e-._1", "a b", "é*", "+\n", "", None) == ["a/b:c@d~e-._1", "a%20b", "%C3%A9%2A", "%2B%0A", "", None]


def test_failures_of_a_text_given_back(values):
    """A text given back breaks what it breaks by itself, as with a space after it, and nothing else."""
    texts = ["# a\n<b>x</b> $y$", "** a", f"{P.PREFIX}x ** b", "", "a **b** `c`"]
    got = values(lambda c: F.array(validate.failures(c, c), validate.failures(c, F.concat(c, F.lit(" ")))), *texts)
    assert [g[0] for g in got] == [g[1] for g in got] == [[], ["strong marks unpaired"], ["placeholder left", "strong marks unpaired"], [], []]
