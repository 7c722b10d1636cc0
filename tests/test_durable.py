"""Runs that fail or are killed keep what was answered."""

import json
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from inkstrata.plans import translate as T
from inkstrata.sources import remote

ROOT = Path(__file__).resolve().parents[1]


def test_one_failing_text_is_told_from_those_beside_it():
    def call(prompts, texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [(t.upper(), 1, 2) for t in texts]

    got = T.answers(call, [""] * 9, list("abcd") + ["bad"] + list("efgh"), at_once=8)
    assert [g[0] for g in got] == ["A", "B", "C", "D", None, "E", "F", "G", "H"]
    assert got[4][3] == "refused" and all(g[3] is None for k, g in enumerate(got) if k != 4)
    short = T.answers(lambda p, t: [], ["", ""], ["a", "b"])
    assert [g[3] for g in short] == ["0 answers to 1 texts"] * 2
    assert T.answers(call, [], []) == []


def test_a_call_without_an_answer_is_given_up_and_made_again():
    calls, waits = [], []

    def slow(x):
        calls.append(x)
        time.sleep(1.2)
        return x

    with pytest.raises(remote.RemoteError, match="no answer within 0.3 s"):
        remote.retrying(remote.timed(slow, 0.3), 2, pause=waits.append)(1)
    assert calls == [1, 1] and waits == [1]
    assert remote.timed(slow, 9)(2) == 2
    with pytest.raises(KeyError):
        remote.timed({}.__getitem__, 9)("none")
    for wrong in ({"request_timeout": 0}, {"commit_chunks": 0}, {"call_chunks": 0}, {"max_chars": 10}, {"tries": 0}, {"request_tries": 0}, {"min_side": 9}):
        with pytest.raises(ValueError):
            T.Settings(**wrong)


def docs_of(spark, n):
    return spark.createDataFrame([(k, f"Some words of number {k} are here.\n") for k in range(n)], "doc_id long, text string")


def test_a_lasting_failure_keeps_all_other_answers(spark, tmp_path):
    def one_fails(prompts, texts):
        if any("number 7 " in t for t in texts):
            raise ValueError("refused for good")
        return [(t, 10, 5) for t in texts]

    s = T.Settings(tries=1, commit_chunks=4, call_chunks=2)
    with pytest.raises(remote.RemoteError, match="1 calls kept failing: refused for good"):
        T.translate(docs_of(spark, 12), str(tmp_path), one_fails, s)
    cached = spark.read.parquet(str(tmp_path / "cache"))
    usage = T.usage(spark.read.parquet(str(tmp_path / "usage"))).first()
    # Whole batches of four but for the one text, up to the batch that it is in.
    assert cached.count() in (3, 7, 11) and usage["total_tokens"] == 15 * cached.count()
    before = cached.count()
    out, counts = T.translate(docs_of(spark, 12), str(tmp_path), T.echo, s)
    assert counts["cache_hits"] == before and counts["api_calls"] == 12 - before
    assert all(r["failures"] == [] and r["text"] for r in out.collect())
    rows = spark.read.parquet(str(tmp_path / "metrics")).collect()
    assert len(rows) == 1 and {k: rows[0][k] for k in T.METRICS} == counts


KILLED = """
import os, signal, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from inkstrata.plans import translate as T
driver, log = os.getpid(), {log!r}

def call(prompts, texts):
    with open(log, "a") as f:
        f.writelines(t for t in texts)
    if sum(1 for _ in open(log)) >= 8:
        os.kill(driver, signal.SIGKILL)
        time.sleep(3)
    return [(t, 1, 1) for t in texts]

spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(k, f"Some words of number {{k}} are here.\\n") for k in range(12)], "doc_id long, text string")
T.translate(docs, {work!r}, call, T.Settings(tries=1, commit_chunks=3, call_chunks=1))
"""


def test_a_killed_run_is_gone_on_with(spark, tmp_path):
    log, work = tmp_path / "calls", tmp_path / "work"
    script = KILLED.format(root=str(ROOT), log=str(log), work=str(work))
    gone = subprocess.run(["timeout", "200", sys.executable, "-c", script], capture_output=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=False)
    assert gone.returncode == -9 or gone.returncode == 137
    first = log.read_text().splitlines()
    assert len(first) >= 8
    out, counts = T.translate(docs_of(spark, 12), str(work), T.echo, T.Settings(tries=1, commit_chunks=3, call_chunks=1))
    # All batches before the one that was cut short are kept.
    assert counts["cache_hits"] >= (len(first) - 1) // 3 * 3 >= 6
    assert counts["api_calls"] == 12 - counts["cache_hits"] and len(first) + counts["api_calls"] <= 12 + 3
    assert len([r for r in out.collect() if r["text"]]) == 12
    assert json.dumps(counts)
