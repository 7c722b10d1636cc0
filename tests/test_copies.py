"""Copies by plan: once, whole, and again without harm."""

import os

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import assets
from inkstrata.sources import copies


def test_files_are_copied_once_and_whole(spark, tmp_path):
    big = os.urandom(copies.BLOCK + 17)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big.jpg").write_bytes(big)
    (tmp_path / "a" / "ü e.png").write_bytes(b"")
    rows = [("a/big.jpg", "out/x/big.jpg"), ("a/ü e.png", "out/e.png"), ("a/none", "out/none"), ("a/big.jpg", "out/x/big.jpg"), ("a", "out/folder")]
    plan = spark.createDataFrame([(f"{tmp_path}/{s}", f"{tmp_path}/{t}") for s, t in rows], "source string, target string").coalesce(1)
    got = sorted((r["source"].rsplit("/", 1)[1], r["action"], r["bytes"]) for r in copies.copy_files(plan).collect())
    assert got == [("a", "failed", None), ("big.jpg", "copied", len(big)), ("big.jpg", "same", len(big)), ("none", "failed", None), ("ü e.png", "copied", 0)]
    assert (tmp_path / "out" / "x" / "big.jpg").read_bytes() == big
    # Again, from many tasks, with a part that a lost one left and another file in the place.
    (tmp_path / "out" / "x" / "big.jpg").write_bytes(big[:-1] + b"?")
    same = copies.copy_files(plan.where(F.col("source").endswith("big.jpg")).repartition(4)).collect()
    assert (tmp_path / "out" / "x" / "big.jpg").read_bytes() == big and {r["action"] for r in same} <= {"copied", "same"}
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["big.jpg", "e.png"]


def test_a_copy_that_breaks_leaves_nothing(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"new")
    (tmp_path / "b").write_bytes(b"old!")

    class Broken(copies.fs.LocalFileSystem):
        pass

    def move(self, a, b):
        raise OSError("no rename")

    monkeypatch.setattr(Broken, "move", move, raising=False)
    monkeypatch.setattr(copies, "place_of", lambda address: (Broken(), address))
    with pytest.raises(OSError, match="no rename"):
        copies.copied(str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_bytes() == b"old!" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_a_slim_plan_is_carried_out(spark, tmp_path):
    files = {"deep/full.md": b"m", "images/a.jpg": b"i", "tmp/x.bin": b"x", "a_content_list.json": b"[]"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    plan = assets.slim_plan(spark.createDataFrame([(1, n, str(len(d)) + n) for n, d in files.items()], "doc_id long, path string, sha256 string"))
    at = F.lit(f"{tmp_path}/")
    kept = plan.where("action = 'keep'").select(F.concat(at, "path").alias("source"), F.concat(at, F.lit("slim/"), "dest").alias("target"))
    assert copies.copy_files(kept).where("action <> 'copied'").count() == 0
    assert sorted(str(p.relative_to(tmp_path / "slim")) for p in (tmp_path / "slim").rglob("*") if p.is_file()) == ["a_content_list.json", "full.md", "images/a.jpg"]
    dropped = plan.where("action = 'drop'").select(F.concat(at, "path").alias("path"))
    assert [r["action"] for r in copies.remove_files(dropped).collect()] == ["removed"] and [r["action"] for r in copies.remove_files(dropped).collect()] == ["gone"]
    assert [r["action"] for r in copies.remove_files(spark.createDataFrame([(str(tmp_path / "images"),)], "path string")).collect()] == ["failed"]
