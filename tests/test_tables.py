"""Figures, tables, assets, jobs, archives and translation over small tables."""

import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import markdown, pseudocode
from inkstrata.operators import assets, figures, jobs, tables
from inkstrata.plans import translate as T
from inkstrata.sources import readers, remote
from inkstrata.streaming import jobs as live


def item(i, kind, page, caption=None, box=(100, 100, 200, 200), text=None):
    return (1, i, kind, page, [float(x) for x in box], f"images/{i:02x}.jpg", text, [caption] if caption else [])


CONTENT = "doc_id long, i int, type string, page_idx int, bbox array<double>, img_path string, text string, captions array<string>"


def test_figure_groups(spark):
    rows = [
        item(0, "image", 0), item(1, "chart", 0, "(a) left"), item(2, "image", 0, "Figure 3. Both", (200, 100, 400, 300)),
        item(3, "text", 0, text="words"), item(4, "image", 0, "Fig. 4: alone"), item(5, "image", 0), item(6, "image", 1, "Figure 5. next page"),
        item(7, "image", 1), item(8, "table", 1, "图 6：表"), item(9, "table", 1), item(10, "image", 1, "Figure 7."),
    ]
    got = {r["figure"]: [p["i"] for p in r["panels"]] for r in figures.figure_groups(spark.createDataFrame(rows, CONTENT)).collect()}
    assert got == {3: [0, 1, 2], 6: [7, 8]}
    assert figures.figure_groups(spark.createDataFrame([], CONTENT)).count() == 0


def test_geometry(spark):
    rows = [item(0, "image", 0, None, (100, 100, 200, 200)), item(1, "image", 0, "Figure 1. x", (200, 100, 400, 300)), item(2, "text", 0, None, (390, 290, 500, 400), " over ")]
    content = spark.createDataFrame(rows, CONTENT)
    pages = spark.createDataFrame([(1, 0, 1000.0, 1000.0)], "doc_id long, page_idx int, width double, height double")
    lines = spark.createDataFrame([(1, 0, 150.0, 302.0, 250.0, 312.0)], "doc_id long, page_idx int, x0 double, y0 double, x1 double, y1 double")
    plan = figures.crop_plans(figures.figure_groups(content), pages, lines)
    got = plan.first()
    assert tuple(got["box"]) == (95.0, 95.0, 405.0, 301.5) and got["width_px"] == round(310 * 300 / 72) and got["file"] == "figure-01.jpg"
    assert [(r["i"], r["area"], r["text"]) for r in figures.text_overlaps(plan, content).collect()] == [(2, round(15 * 11.5, 1), "over")]
    ink = spark.createDataFrame([(1, 1, "top", p, c) for p, c in enumerate([9, 9, 0, 0])] + [(1, 1, "right", p, 9) for p in range(3)] + [(1, 1, "left", 0, 0)], "doc_id long, figure int, edge string, pos int, count int")
    box = figures.ink_clamped(plan, ink, 72).first()["box"]
    assert (box["x0"], box["y0"], box["x1"]) == (95.0, 97.0, 400.0)
    sheet = figures.sheet_layout(spark.createDataFrame([(1, "a", 100, 50), (1, "b", 100, 100)], "doc_id long, file string, width_px long, height_px long")).orderBy("file").collect()
    assert [(r["sheet_y"], r["sheet_height"]) for r in sheet] == [(40.0, 450.0), (530.0, 900.0)]


def test_rewrite(values):
    def run(text):
        return figures.rewrite(text, F.array(F.lit("aa.jpg"), F.lit("bb.jpg")), F.lit("figure-01.jpg"))

    good = "x\n![](images/aa.jpg)\n(a) one\n\n![](../images/bb.jpg)\nFigure 1"
    got = values(run, good, "![](images/aa.jpg)", good.replace("(a) one", "prose"), good.replace("(a) one", "![](images/cc.jpg)"))
    assert got[0]["text"] == "x\n![](images/figure-01.jpg)\n(a) one\n\nFigure 1" and got[0]["status"].startswith("merged 2 panels")
    assert [g["status"][:22] for g in got[1:]] == ["skip: already merged o", "skip: unexpected conte", "skip: panel refs are n"] and got[1]["text"] is None
    assert values(run, got[0]["text"])[0]["status"].startswith("skip: already merged")


def test_tables_to_images(spark):
    body = "<table><caption>Cap</caption><tr><td>1</td></tr></table>"
    docs = spark.createDataFrame([(1, f"a {body} b {body}"), (2, body), (3, "none"), (4, None)], "doc_id long, text string")
    content = [(1, "l1", 0, "table", body, "images/a b.jpg"), (1, "l2", 0, "table", body, "images/a%20b.jpg"), (1, "l2", 1, "table", body, "images/c.jpg"), (2, "l1", 0, "table", body, "../out.jpg"), (2, "l1", 1, "table", body, "http://e.org/x.jpg")]
    files = spark.createDataFrame([(1, "images/a b.jpg"), (1, "images/c.jpg"), (2, "out.jpg")], "doc_id long, path string")
    images = tables.table_images(spark.createDataFrame(content, "doc_id long, list string, i int, type string, table_body string, img_path string"), files)
    got = {r["doc_id"]: r for r in tables.tables_to_images(docs, images, "image").collect()}
    assert got[1]["text"] == "a Cap\n\n![](images/a%20b.jpg)\n b Cap\n\n![](images/c.jpg)\n" and got[1]["content_list"] == "l2"
    assert got[2]["text"] is None and got[2]["table_error"] and got[3]["text"] == "none" and got[4]["text"] is None and not got[4]["table_error"]
    auto = {r["doc_id"]: r for r in tables.tables_to_images(docs, images, "auto").collect()}
    assert auto[2]["text"] == body and auto[2]["table_mode"] == "html"


def test_assets(spark):
    docs = spark.createDataFrame([(1, '![a](<im/a b.png>) ![](im/c.png?v=1 "t") <img src="im/d.png"> ![](../up.png) ![](http://e.org/x.png) ![](im/gone.png) <img src=\'im/d.png\'>')], "doc_id long, text string")
    files = spark.createDataFrame([(1, "im/a b.png", "1"), (1, "im/c.png", "2"), (1, "im/d.png", "3")], "doc_id long, path string, sha256 string")
    refs = assets.resolve(assets.asset_references(docs), files)
    assert {(r["raw"], r["resolved"]) for r in refs.collect()} == {("im/a b.png", True), ("im/c.png?v=1", True), ("im/d.png", True), ("../up.png", False), ("im/gone.png", False)}
    out = assets.shared_paths(docs, refs).first()
    assert out["text"].startswith('![a](<../im/a%20b.png>) ![](../im/c.png?v=1 "t") <img src="../im/d.png"> ![](../up.png)') and out["text"].endswith("<img src='../im/d.png'>") and out["shared_assets"] == 3
    assert sorted(r["path"] for r in assets.copy_plan(assets.asset_references(docs), files, files.where("path = 'im/c.png'")).collect()) == ["im/a b.png", "im/d.png"]
    tree = spark.createDataFrame([(1, "o/full.md", "a"), (1, "o/x.md", "b"), (1, "o/images/p.jpg", "c"), (1, "images/p.jpg", "c"), (1, "q/images/z.jpg", "d"), (1, "images/z.jpg", "e"), (1, "o/1_content_list.json", "f"), (1, "o/1_content_list_v2.json", "g")], "doc_id long, path string, sha256 string")
    plan = {r["path"]: r["action"] for r in assets.slim_plan(tree).collect()}
    assert plan == {"o/full.md": "keep", "o/x.md": "drop", "o/images/p.jpg": "same", "images/p.jpg": "keep", "q/images/z.jpg": "conflict", "images/z.jpg": "conflict", "o/1_content_list.json": "keep", "o/1_content_list_v2.json": "drop"}


def test_paths_of_one_pass(spark):
    """References found, resolved and rewritten beside the text are those of the longer way, on odd ones too; what a document has is not broadcast."""
    odd = """![](<a b.png?x#y>) ![](c%20d.png) ![](+%zz.png) ![](../out.png) ![](q/../r.png "t") <IMG alt='' SRC = 's/./t.png#f'> <img src="u.png?a\nb"> <imgx src="r.png"> ![](http://e.org/r.png) ![](#r) ![](<<r.png>)"""
    docs = spark.createDataFrame([(1, odd), (2, "![](r.png)"), (3, None), (4, "")], "doc_id long, text string")
    files = spark.createDataFrame([(1, p) for p in ("a b.png", "c d.png", "+%zz.png", "out.png", "r.png", "s/t.png", "u.png")] + [(1, "r.png"), (3, "r.png")], "doc_id long, path string")
    whole = assets.shared_files(docs, files, "up dir")
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["text"], r["shared_assets"]) for r in whole.collect()}
    assert got == {r["doc_id"]: (r["text"], r["shared_assets"]) for r in assets.shared_paths(docs, assets.resolve(assets.asset_references(docs), files), "up dir").collect()}
    near, far = assets.resolved_references(docs, files), assets.resolve(assets.asset_references(docs), files)
    assert near.exceptAll(far).count() == far.exceptAll(near).count() == 0 and near.where("resolved").count() == 6 and "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    led = """![](<up%20dir/a%20b.png?x#y>) ![](up%20dir/c%20d.png) ![](up%20dir/%2B%25zz.png) ![](../out.png) ![](up%20dir/r.png "t") <IMG alt='' SRC = 'up%20dir/s/t.png#f'> <img src="u.png?a\nb"> <imgx src="r.png"> ![](http://e.org/r.png) ![](#r) ![](<<r.png>)"""
    assert got == {1: (led, 5), 2: ("![](r.png)", 0), 3: (None, 0), 4: ("", 0)}


POLLS = "job_id long, ts timestamp, state string, result_url string, err_msg string"


def polls(spark):
    return spark.sql(f"""SELECT * FROM VALUES (1L, timestamp'2026-01-01 00:00:00', 'pending', null, null), (1L, timestamp'2026-01-01 00:00:03', 'pending', null, null), (1L, timestamp'2026-01-01 00:01:00', 'done', 'u1', null),
      (2L, timestamp'2026-01-01 00:00:00', 'running', null, null), (2L, timestamp'2026-01-01 00:20:00', 'done', 'u2', null), (3L, timestamp'2026-01-01 00:00:00', 'done', null, null), (4L, timestamp'2026-01-01 00:00:00', 'failed', null, 'bad')
      AS t({", ".join(c.split()[0] for c in POLLS.split(", "))})""")


def test_jobs(spark, values):
    assert sorted((r["job_id"], r["state"]) for r in jobs.state_changes(polls(spark)).collect()) == [(1, "done"), (1, "pending"), (2, "done"), (2, "running"), (3, "done"), (4, "failed")]
    assert {r["job_id"]: (r["outcome"], r["result_url"], r["error"]) for r in jobs.outcomes(polls(spark)).collect()} == {1: ("done", "u1", None), 2: ("timeout", None, None), 3: ("no result", None, None), 4: ("failed", None, "bad")}
    assert [tuple(x) for x in values(lambda m, t: jobs.mode_of(m, t, F.lit("image"), F.lit(True)), ("auto", "tok"), ("auto", ""), ("precise", ""))] == [("precise", None), ("agent", "images of tables need the precise mode and table recognition"), ("precise", "the precise mode needs a token")]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_job_stream_of_a_job_past_its_time(spark, tmp_path, zone):
    """A job times out once, its later polls are ignored, and times are the same in any time zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2026-01-01 00:00:00", 1, "pending"), ("2026-01-01 01:00:00", 2, "pending"), ("2026-01-01 01:00:30", 2, "pending"), ("2026-01-01 02:00:00", 1, "done"), ("2026-01-01 04:00:00", 3, "pending")]
        for n, (at, job, state) in enumerate(rows):
            one = spark.sql(f"SELECT {job} AS job_id, to_timestamp('{at}Z') AS ts, '{state}' AS state, 'u' AS result_url")
            one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"late_{zone[:3]}"
        query = live.watch(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        got = sorted((r["job_id"], r["at"], r["state"], r["outcome"]) for r in spark.table(name).select("job_id", F.unix_timestamp("ts").alias("at"), "state", "outcome").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = 1767225600
    assert got == [(1, start, "pending", None), (1, start + 900, "pending", "timeout"), (2, start + 3600, "pending", None), (2, start + 4500, "pending", "timeout"), (3, start + 14400, "pending", None)]


def test_job_stream(spark, tmp_path):
    polls(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(polls(spark).schema).parquet(str(tmp_path / "in"))
    query = live.watch(stream).writeStream.format("memory").queryName("job_watch").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["job_id"], r["state"], r["outcome"]) for r in spark.table("job_watch").collect()}
    assert {(1, "pending", None), (1, "done", "done"), (2, "running", None), (2, "done", "timeout"), (3, "done", "no result"), (4, "failed", "failed")} <= got


def test_readers(spark, values, tmp_path):
    (tmp_path / "a.md").write_text("# hi\n")
    (tmp_path / "b.md").write_text(" \n")
    (tmp_path / "c.txt").write_text("no")
    assert [r["text"] for r in readers.markdown_files(spark, str(tmp_path)).collect()] == ["# hi\n"]

    def archive(*members):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, data in members:
                z.writestr(name, data)
        return raw.getvalue()

    files = spark.createDataFrame([(1, archive(("d/full.md", "x"), ("i.jpg", "y"))), (2, archive(("ok", "1"), ("../escape", "2"))), (3, b"junk"), (4, None)], "doc_id long, content binary")
    got = sorted((r["doc_id"], r["member"], bytes(r["bytes"]) if r["bytes"] is not None else None, bool(r["error"])) for r in readers.zip_members(files).collect())
    assert got == [(1, "d/full.md", b"x", False), (1, "i.jpg", b"y", False), (2, None, None, True), (3, None, None, True), (4, None, None, True)]
    assert [(r["doc_id"], r["error"]) for r in readers.zip_members(files.where("doc_id = 1"), most=0).collect()] == [(1, "member too large: d/full.md")]
    items = spark.createDataFrame([(1, "l", '[{"type": "image", "page_idx": "2", "bbox": [1, 2, 3, 4], "img_path": "a", "image_caption": "[\\"Figure 1. x\\", \\" \\"]"}, {"type": "table", "table_caption": "plain"}]'), (2, "l", '{"a": 1}'), (3, "l", None)], "doc_id long, list string, json string")
    assert [(r["page_idx"], r["captions"]) for r in readers.content_items(items).where("doc_id = 1").orderBy("i").collect()] == [(2, ["Figure 1. x"]), (None, ["plain"])]
    assert values(readers.term_list, "# t\n\n- `token`\n* a b \n- token\nno") == [["token", "a b"]]
    assert values(readers.glossary_lines, '{"row": "行", "n": 1}', " raw ", '{"row": ', None) == ["- row => 行\n- n => 1", "raw", '{"row":', None]
    assert [tuple(g) for g in values(readers.glossary, " raw ", None)] == [("raw", hashlib.sha256(b"raw").hexdigest()), ("", "")]
    with pytest.raises(Exception, match="has to be an object"):
        values(readers.glossary_lines, '["row"]')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b_content_list.json").write_text("[]")
    (tmp_path / "in" / "a_content_list.json").write_text('[{"type": "text"}]')
    assert sorted((r["list"], r["json"]) for r in readers.content_lists(spark, str(tmp_path / "in")).collect()) == [("a_content_list.json", '[{"type": "text"}]'), ("b_content_list.json", "[]")]
    (tmp_path / "a.pdf").write_bytes(b"12345")
    assert [(r["length"], bytes(r["content"]), r["refused"]) for r in readers.binary_files(spark, str(tmp_path)).collect()] == [(5, b"12345", False)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setitem(readers.LIMITS, "agent", 4)
        assert [(r["length"], r["content"], r["refused"]) for r in readers.binary_files(spark, str(tmp_path), mode="agent").collect()] == [(5, None, True)]
    assert values(readers.secret_in, "a sk-abcdefghijklm b", "export MY_TOKEN='abc'\n", "# head\n`value-of-some-length`", "short") == ["sk-abcdefghijklm", "abc", "value-of-some-length", None]


def test_members_that_cannot_be_read_are_told_apart(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("good", "locked", "spoilt", "odd", "last"):
            z.writestr(name, name * 50)
    data = bytearray(raw.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        at = {m.filename: m.header_offset for m in z.infolist()}
    heads, k = {}, data.index(b"PK\x01\x02")
    for name in at:
        heads[name] = k
        k = data.find(b"PK\x01\x02", k + 1)
    for place in (at["locked"] + 6, heads["locked"] + 8):
        data[place] |= 1
    for place in (at["odd"] + 8, heads["odd"] + 10):
        data[place] = 99
    data[at["spoilt"] + 30 + len("spoilt") + 1] ^= 0xFF
    files = spark.createDataFrame([(1, bytes(data)), (2, bytes(data[:40]))], "doc_id long, content binary")
    got = {(r["doc_id"], r["member"]): (r["bytes"] and len(r["bytes"]), r["error"]) for r in readers.zip_members(files).collect()}
    unread = {"locked": "encrypted member", "spoilt": "damaged member", "odd": "member packed by an unknown method"}
    assert got == {(1, "good"): (200, None), (1, "last"): (200, None), (2, None): (None, "no archive"), **{(1, k): (None, v) for k, v in unread.items()}}


def test_archives_are_read_by_ranges(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, size in (("d/", 0), ("first", 10), ("large", 3_000_000), ("last", 5)):
            z.writestr(name, b"x" * size)
    (tmp_path / "b.zip").write_bytes(b"junk")
    paths = spark.createDataFrame([(k, f"{tmp_path}/{n}") for k, n in enumerate(("a.zip", "b.zip", "none.zip"))] + [(3, None), (4, f"file://{tmp_path}/a.zip")], "k int, path string")
    got = sorted((r["k"], r["member"] or "", r["bytes"] and len(r["bytes"]), (r["error"] or "")[:16]) for r in readers.zip_members_at(paths).collect())
    whole = [("first", 10, ""), ("large", 3_000_000, ""), ("last", 5, "")]
    assert got == sorted([*((k, *m) for k in (0, 4) for m in whole), (1, "", None, "no archive"), (2, "", None, "FileNotFoundErro"), (3, "", None, "FileNotFoundErro")])

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.most += len(data)
            return data

    members = readers.members_of(Counted((tmp_path / "a.zip").read_bytes()))
    assert next(members)[0] == "first" and Counted.most < 70_000


def test_translate(spark, tmp_path):
    text = "# Head\n\nSome **bold** words with $x$ and token.\n\n```\ncode\n```\n\nMore words here.\n"
    long = "".join(f"Sentence number {i} is here. " for i in range(30)) + "\n\n" + "".join(f"Other words {i} follow. " for i in range(30)) + "\n"
    docs = spark.createDataFrame([(1, text), (2, text), (3, long)], "doc_id long, text string")

    def upper(prompts, texts):
        """Breaks the placeholders of long chunks, so that they have to be split."""
        return [("broken ** text" if len(t) > 1000 else t.replace("words", "WORDS"), 10, 5) for t in texts]

    s = T.Settings(terms=("token",), max_chars=2000, tries=2, min_side=100)
    out, counts = T.translate(docs, str(tmp_path), upper, s)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == text.replace("words", "WORDS") == got[2]["text"] and got[3]["text"] == long.replace("words", "WORDS")
    assert all(r["failures"] == [] for r in got.values())
    assert counts["adaptive_splits"] == 1 and counts["api_calls"] == 3 + 1 + 2 and counts["cache_hits"] == 0
    again, counts = T.translate(docs.where("doc_id < 3"), str(tmp_path), upper, s)
    assert counts["api_calls"] == 0 and counts["cache_hits"] == counts["chunks"] == 4 and {r["text"] for r in again.collect()} == {got[1]["text"]}
    assert T.usage(spark.read.parquet(str(tmp_path / "usage"))).first().asDict() == {"prompt_tokens": 60, "completion_tokens": 30, "total_tokens": 90}
    assert T.model_name(" DS-v4-pro") == T.MODELS["ds-v4-pro"] and T.model_name("other") == "other"
    for url in ("http://e.org", "http://localhost:80@evil.example/", "localhost", "ftp://localhost", "https://", ""):
        with pytest.raises(ValueError):
            T.Settings(base_url=url)
    assert [T.checked_url(u) for u in ("https://e.org/v1/ ", "http://[::1]:8080", "http://LOCALHOST")] == ["https://e.org/v1", "http://[::1]:8080", "http://LOCALHOST"]
    assert T.output_suffix("pt BR") == "pt-BR" and T.language_name("zh-CN") == "Simplified Chinese"


class Refused(Exception):
    def __init__(self, code):
        super().__init__(f"state {code} with key-1\n  and more")
        self.code = code


def test_remote_calls():
    def failing(*errors):
        left, waits, seen = list(errors), [], []

        def call(x):
            seen.append(x)
            if left:
                raise left.pop(0)
            return x * 2

        return call, waits, seen

    call, waits, seen = failing(Refused(429), TimeoutError("late"))
    assert remote.retrying(call, 3, pause=waits.append)(4) == 8 and waits == [1, 2] and seen == [4] * 3
    call, waits, seen = failing(Refused(404), OSError())
    with pytest.raises(remote.RemoteError, match="state 404 with <redacted> and more"):
        remote.retrying(call, 3, secret="key-1", pause=waits.append)(4)
    assert waits == [] and len(seen) == 1
    call, waits, seen = failing(*[Refused(503)] * 9)
    with pytest.raises(remote.RemoteError, match="state 503"):
        remote.retrying(call, 6, pause=waits.append)(4)
    assert waits == [1, 2, 4, 8, 8]
    call, waits, seen = failing(*[ConnectionError("no")] * 3)
    assert remote.retrying(call, 3, most=4, then=(lambda x: 1 // 0, lambda x: "other"), pause=waits.append)(4) == "other" and waits == [1, 2]
    assert remote.answer_of(b'{"code": 0, "data": 1}')["data"] == 1 and remote.answer_of(b"{}") == {}
    for raw in (b'{"code": 7, "msg": "no"}', b"[]"):
        with pytest.raises(remote.RemoteError):
            remote.answer_of(raw)


def test_jobs_and_answers_are_asked_again(spark, values):
    state = {}

    def client(name, data):
        state[name] = state.get(name, 0) + 1
        if name == "bad":
            raise ValueError("broken file")
        if state[name] == 1:
            raise ConnectionError("lost")
        return "done", data.decode(), None

    files = spark.createDataFrame([("a", b"x"), ("bad", b"y"), ("b", None)], "path string, content binary")
    got = {r["path"]: (r["state"], r["result"], r["error"]) for r in readers.run_jobs(files, client).collect()}
    assert got == {"a": ("done", "x", None), "b": ("done", "", None), "bad": ("failed", None, "broken file")}
    assert values(readers.is_token, "abcdefghijkl", "abcdefghijk", "abcdefgh ijkl", None) == [True, False, False, False]


def test_second_runs_change_nothing(values):
    listing = '<div class="x-algorithm">Algorithm 1<br>1: for $x \\in S$ do<br>2: y<br>3: end for</div> after'
    once = values(lambda c: pseudocode.plain_listings(c)["text"], listing)
    assert once[0] != listing and values(lambda c: pseudocode.plain_listings(c)["text"], *once) == once
    once = values(markdown.caption_openers, "![](images/a.jpg)\n\n图 3 说明\n")
    assert values(markdown.caption_openers, *once) == once
    def fold(c):
        return figures.rewrite(c, F.array(F.lit("a.jpg"), F.lit("b.jpg")), F.lit("figure-01.jpg"))

    once = values(fold, "![](images/a.jpg)\n(a) x\n![](images/b.jpg)\n")[0]
    assert once["status"].startswith("merged") and values(fold, once["text"])[0]["status"] == "skip: already merged or refs not found"


def test_short_rows_of_one_file_are_dealt_out(spark, tmp_path):
    """A file of short rows is one task; queries with much work on each row need more."""
    from inkstrata.plans import catalog, catalog_repairs

    spark.createDataFrame([(k, f"n {k}", k % 50) for k in range(200)], "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k,) for k in range(200)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for query in (catalog.algorithm_blocks, catalog_repairs.listing_lines, catalog_repairs.sound_translations):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_many_tables_of_one_text_are_replaced(spark):
    """Where tables begin and end was worked out anew for each piece, so it grew as the square."""
    import time

    n = 6000
    cell = "<table><caption>c</caption></table>"
    spans = [(k * (len(cell) + 1), k * (len(cell) + 1) + len(cell)) for k in range(n)]
    rows = spark.createDataFrame([((cell + "\n") * n, spans, [f"{k}.jpg" for k in range(n)])], "text string, spans array<struct<start:int,stop:int>>, pictures array<string>")
    began = time.time()
    got = rows.select(tables._replaced(F.col("text"), F.col("spans"), F.col("pictures")).alias("t")).first().t
    assert got == "".join(f"c\n\n![]({k}.jpg)\n\n" for k in range(n))
    assert time.time() - began < 60


def test_tables_are_matched_by_document_alone(spark, tmp_path):
    """Each row of a table and of its image was moved by document, body, path and number in turn, so disk grew to twenty times the input."""
    from inkstrata.plans import catalog, catalog_repairs

    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    # Lines that are equal up to the supplier and differ after it.
    spark.range(400).selectExpr("id % 90 l_orderkey", "id % 7 l_partkey", "id % 3 l_suppkey", "cast(id % 2 as int) l_linenumber", "id * 1.0D l_quantity", "id * 2.0D l_extendedprice", "0.1D l_discount", "0.2D l_tax", "'A' l_returnflag", "'F' l_linestatus", "timestamp_ntz '2020-01-01' l_shipdate").to(
        spark.createDataFrame([], kinds).schema
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    for query, fields in ((catalog_repairs.caption_tables, 4), (catalog.table_images, 11)):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        moves = re.findall(r"Exchange (?:hash|range)partitioning\((\w+)#\d+L?, ", plan)
        assert len(re.findall(r"\bExchange ", plan)) == len(moves) == 3 and set(moves) == {"l_orderkey"}
        assert {len(f.split(",")) for f in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)} == {fields}
    got = {r.doc_id: (r.content_list, r.text_sha256) for r in catalog_repairs.caption_tables(spark, str(tmp_path)).collect()}
    lines = {}
    for key, *rest in sorted((r.l_orderkey, r.l_linenumber, r.l_partkey) for r in spark.read.parquet(str(tmp_path / "lineitem.parquet")).collect()):
        lines.setdefault(key, []).append(rest[1])
    text = {k: "".join(f"Part {p}\n\ntwo\n\n![](images/t%20{i}.jpg)\n\n" for i, p in enumerate(own)) for k, own in lines.items()}
    assert got == {k: ("a" if k % 4 == 2 else "b", hashlib.sha256(t.encode()).hexdigest()) for k, t in text.items()}


def test_first_list_that_covers_all_tables(spark):
    """Tables and crops of a few bodies at random, some paths missing or outside: against a search in order."""
    draw = random.Random(3)
    bodies = [f"<table><tr><td>{k}</td></tr></table>" for k in range(3)] + ["| a | b |\n|---|---|\n| 1 | \x01 |\n"]
    docs, content, files, want = [], [], [], {}
    for doc in range(120):
        own = draw.choices(bodies[: 4 if doc % 3 == 0 else 3], k=draw.choice([0, 1, 3, 6, 60]))
        docs.append((doc, "start\n" + "".join(f"\n{b}\nwörds\n" for b in own)))
        there, found = set(), {}
        for name in draw.sample(["a", "b", "c"], k=draw.randint(0, 3)):
            crops = draw.sample(own, k=len(own)) if draw.random() < 0.6 else list(own)
            crops += draw.choices(bodies, k=draw.choice([0, 0, 2]))
            for i, body in enumerate(crops):
                path = f"images/{name} {i}.jpg"
                raw = {0: "../" + path, 1: "./" + path + "?v=1", 2: "https://e.org/" + path}.get(draw.randint(0, 40), path)
                if draw.random() > (0.02 if doc % 2 else 0):
                    there.add(path)
                content.append((doc, name, i, "table", body, raw))
                if path in there and not raw.startswith(("../", "https")):
                    found.setdefault(name, []).append((body, raw.removesuffix("?v=1").replace(" ", "%20")))
        files += [(doc, p) for p in there] + [(doc, "images/other.jpg")]
        for name in sorted(found):
            left, pictures = list(found[name]), []
            for body in own:
                if hit := next((x for x in left if x[0] == body), None):
                    left.remove(hit)
                    pictures.append(hit[1])
            if own and len(pictures) == len(own):
                want[doc] = (name, "start\n" + "".join(f"\n![]({p})\n\nwörds\n" for p in pictures))
                break
        want.setdefault(doc, (None, docs[-1][1]))
    draw.shuffle(content)
    rows = spark.createDataFrame(content, "doc_id long, list string, i int, type string, table_body string, img_path string")
    images = tables.table_images(rows, spark.createDataFrame(files, "doc_id long, path string"))
    out = {r.doc_id: r for r in tables.tables_to_images(spark.createDataFrame(docs, "doc_id long, text string"), images, "auto").collect()}
    assert {k: (r.content_list, r.text) for k, r in out.items()} == want
    assert {len([1 for name, _ in want.values() if name == x]) > 5 for x in ("a", "b", "c", None)} == {True}
    assert all(r.table_images == r.text.count("![](") and r.table_mode == ("image" if r.content_list else "html" if "|---|" in r.text or "<table" in r.text else "auto") for r in out.values())


def test_pairs_of_equal_values(values):
    from inkstrata.functions.text import paired

    draw = random.Random(5)
    rows = [(",".join(draw.choices("abcd", k=n)), ",".join(draw.choices("abce", k=m))) for n, m in ((1, 1), (5, 4), (9, 30), (200, 250))]
    for (own, others), got in zip(rows, values(lambda x, y: paired(F.split(x, ","), F.split(y, ",")), *rows), strict=True):
        places = {}
        for at, v in enumerate(others.split(",")):
            places.setdefault(v, []).append(at)
        assert got == [places[v].pop(0) if places.get(v) else None for v in own.split(",")]
