"""Rarer rules on small fixtures: kinds of places, prefixes, text lines beside crops, keys, nulls."""

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import protect, pseudocode, validate
from inkstrata.operators import figures, segment
from inkstrata.plans import catalog_edges, translate

W = "w" * 30


@pytest.mark.parametrize(
    ("text", "at"),
    [
        (f"{W} {W}\n{W}. {W}\n\n{W} {W} {W}", f"{W} {W}\n{W}. {W}\n\n"),  # a blank line comes first, though a space is nearer
        (f"{W} {W}\n{W}. {W} {W} {W} {W}", f"{W} {W}\n{W}. "),
        (f"{W} {W}\n{W} {W} {W} {W} {W}", f"{W} {W}\n"),
        (f"{W} {W} {W} {W}", f"{W} {W} "),
        (f"{W} `{W} {W}` {W}", f"{W} "),  # not inside code; the nearer of two as far from the middle is the first
        (f"`{W} {W}\n\n{W}`", f"`{W} {W}\n\n"),  # code doesn't go over lines
        (f"{W} x", None),
        ("", None),
        (None, None),
    ],
)
def test_places(spark, text, at):
    got = segment.halves(spark.createDataFrame([(text,)], "text string"), min_side=20).first()
    assert got["split_at"] == (None if at is None else len(at))
    assert at is None or (got["left"], got["right"]) == (at, text[len(at) :])


def test_prefixes_apart(spark):
    texts = [("none", "P_"), ("P_", "P_X"), ("P_X P_XXX_ P_", "P_XXXX"), ("", "P_"), (None, "P_")]
    rows = spark.createDataFrame(texts, "text string, want string").select(protect.apart(F.col("text"), F.lit("P_")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_text_lines_beside_crops(spark):
    groups = spark.createDataFrame([("d", 0, 1, [(0, "a.jpg", [100.0, 100.0, 300.0, 300.0]), (1, "b.jpg", [300.0, 100.0, 500.0, 300.0])]), ("e", 0, 1, [(0, "a.jpg", [0.0, 0.0, 10.0, 10.0])])], "doc_id string, page_idx int, figure int, panels array<struct<i:int,img:string,bbox:array<double>>>")
    sizes = spark.createDataFrame([("d", 0, 1000.0, 1000.0)], "doc_id string, page_idx int, width double, height double")
    lines = spark.createDataFrame([("d", 0, 50.0, 302.0, 600.0, 310.0), ("d", 0, 90.0, 200.0, 97.0, 210.0), ("d", 1, 0.0, 96.0, 900.0, 99.0), ("d", 0, 600.0, 90.0, 700.0, 99.0)], "doc_id string, page_idx int, x0 double, y0 double, x1 double, y1 double")
    got = {r["doc_id"]: r["box"] for r in figures.crop_plans(groups, sizes, lines).collect()}
    assert tuple(got["d"]) == (97.5, 95.0, 505.0, 301.5)  # lines of another page and beside the box don't count
    assert got["e"]["x0"] is None


def test_keys_tell_settings_apart(spark):
    row = spark.range(1).select(F.lit('a "b"\n').alias("text"))
    base = translate.Settings()
    other = [translate.Settings(model="m"), translate.Settings(terms=("t",)), translate.Settings(glossary="g"), translate.Settings(target_language="en"), translate.Settings(base_url="https://a.org"), translate.Settings(extra={"k": "v"})]
    same = [translate.Settings(tries=9), translate.Settings(base_url="http://localhost"), translate.Settings(commit_chunks=5)]
    keys = row.select(*[translate.cache_key(F.col("text"), s).alias(f"k{i}") for i, s in enumerate([base, *same, *other])]).first()
    assert len(set(keys[: 1 + len(same)])) == 1 and len(set(keys)) == 1 + len(other)


def test_checks_of_no_text(spark):
    fails = validate.failures(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([(None, None), ("", ""), (None, "x"), ("x", None)], "a string, b string").select(fails.alias("f")).collect()
    assert [len(r["f"]) > 0 for r in rows] == [False, False, True, True]


def test_every_symbol_and_group():
    for command, plain in catalog_edges.SYMBOLS + catalog_edges.GROUPS:
        assert pseudocode.plain(f"x {command} y") == f"x {plain} y"


@pytest.mark.parametrize("name", sorted(catalog_edges.queries()))
def test_queries_match_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("lineitem", "documents", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalog_edges.oracle_sql()[name]).df()
    got = catalog_edges.queries()[name](spark, folder)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want[columns].itertuples(index=False)))
