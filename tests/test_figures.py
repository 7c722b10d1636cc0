"""Spans in linear time, folding of all figures of a text, and checks by reference."""

import time

from pyspark.sql import functions as F

from inkstrata.functions import markdown as M
from inkstrata.functions import text as T
from inkstrata.operators import figures


def test_running_folds(values):
    def run(c):
        return T.running(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b)

    many = list(range(1, 60))
    got = values(run, "", "5", "1,2,3", ",".join(map(str, many)))
    assert got == [[0], [0, 5], [0, 1, 3, 6], [sum(many[:k]) for k in range(60)]]
    assert [[tuple(p) for p in x] for x in values(lambda c: T.places(c, "[0-9]+"), "a1b22", "x", "")] == [[(1, 2, "1"), (3, 5, "22")], [], []]


def test_spans_of_very_many_tables(values):
    n = 20_000
    text = "".join(f"<table><tr><td>{k}</td></tr></table>\n\na|b\n---|---\n{k}|x\n\n" if k % 2 else "<table>\na|b\n-----|---\nx|y</table>\n" for k in range(n))
    began = time.time()
    spans = values(M.table_spans, text)[0]
    assert time.time() - began < 60
    # An HTML and a pipe table in turn, or one in the other.
    assert len(spans) == n // 2 * 3 and all(a["stop"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert {text[s["start"] : s["start"] + 2] for s in spans} == {"<t", "a|"} and text[spans[-1]["start"] : spans[-1]["stop"]].endswith(f"{n - 1}|x\n")


NAMES = "doc_id long, figure int, images array<string>, file string"


def test_all_figures_of_a_text_fold_at_once(spark):
    a, b, c, d, e = (f"![](images/{x}{x}.jpg)" for x in "abcde")
    texts = [
        (1, f"x\n{a}\n(a) l\n{b}\n{c}\n{d}\nend"),
        (2, f"{a}\n{b}\n{c}"),
        (3, None),
        (4, "no figure"),
        (5, f"{a}\nprose\n{b}\n\n{c}\n{d}"),
        (6, f"ü{e}\n{a}\n{b}"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(k, f, [f"{x}{x}.jpg" for x in xs], f"figure-0{f}.jpg") for k, f, xs in ((1, 1, "ab"), (1, 2, "cd"), (2, 1, "ab"), (2, 2, "bc"), (3, 1, "ab"), (5, 1, "ab"), (5, 2, "cd"), (6, 3, "ba"), (6, 4, "zz"), (9, 1, "ab"))]
    own = spark.createDataFrame(rows, NAMES)
    got = {r["doc_id"]: r for r in figures.fold(docs, own).collect()}
    assert got[1]["text"] == "x\n![](images/figure-01.jpg)\n(a) l\n\n![](images/figure-02.jpg)\n\nend" and got[1]["changed"]
    assert got[2]["text"] == f"![](images/figure-01.jpg)\n\n{c}" and [s["status"][:13] for s in got[2]["figures"]] == ["merged 2 pane", "skip: already"]
    assert (got[3]["text"], got[3]["changed"], got[3]["figures"][0]["status"]) == (None, False, figures.GONE)
    assert (got[4]["text"], got[4]["changed"], got[4]["figures"]) == ("no figure", False, [])
    assert got[5]["text"] == f"{a}\nprose\n{b}\n\n![](images/figure-02.jpg)\n" and "(prose)" in got[5]["figures"][0]["status"]
    assert got[6]["text"] == f"ü{e}\n![](images/figure-03.jpg)\n" and 9 not in got
    # Each figure as it is folded alone, and nothing on a second run.
    again = figures.fold(figures.fold(docs, own).select("doc_id", "text"), own)
    assert again.where("changed").count() == 0
    assert figures.fold(docs, own.limit(0)).where("changed").count() == 0


def test_references_that_do_not_resolve_are_failures(spark):
    docs = spark.createDataFrame([(1, "![](images/figure-01.jpg) ![](../images/b.png) ![](images/b.png)"), (2, "![](images/figure-01.jpg)"), (3, None)], "doc_id long, text string")
    files = spark.createDataFrame([(1, "figure-01.jpg"), (2, "figure-01.jpg"), (2, "figure-01.jpg")], "doc_id long, file string")
    assert [tuple(r) for r in figures.unresolved(docs, files).collect()] == [(1, "b.png", 2)]
    plans = spark.createDataFrame([(k, 1, "figure-01.jpg", 10, 10, [("aa.jpg",), ("bb.jpg",)]) for k in (1, 2, 3)], "doc_id long, figure int, file string, width_px long, height_px long, panels array<struct<img:string>>")
    crops = spark.createDataFrame([(k, "figure-01.jpg", 10, 11) for k in (1, 2)], "doc_id long, file string, width_px long, height_px long")
    none = spark.createDataFrame([], "doc_id long, figure int")
    got = {r["doc_id"]: (r["status"], r["failures"]) for r in figures.verify(plans, docs, crops, none, files=files).collect()}
    assert got == {1: ("merged", ["references of the text do not resolve"]), 2: ("merged", []), 3: ("no reference", ["neither the crop nor its panels are referred to"])}


def test_a_secret_across_the_cut_is_blanked(values):
    got = values(lambda c, s: T.redact(c, s), ("x" * 590 + " sk-abcdefghijklmnop tail", "sk-abcdefghijklmnop"), ("a\n b", ""))
    assert "sk-" not in got[0] and got[0].endswith(" <redacted") and len(got[0]) <= 600 and got[1] == "a b"
