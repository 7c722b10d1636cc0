"""The stream with timers against the batch operator over the same polls."""

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import jobs
from inkstrata.plans.catalog import _polls
from inkstrata.streaming import deadlines

SF = "/root/testdata/sf0.001"


@pytest.fixture
def timers(spark):
    before = spark.conf.get(deadlines.STORE_KEY)
    deadlines.use_store(spark)
    yield spark
    spark.conf.set(deadlines.STORE_KEY, before)


def told(spark, stream, name, folder, **options):
    query = deadlines.watch(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_the_stream_agrees_with_the_batch_and_a_replay_changes_nothing(timers, tmp_path):
    polls = _polls(timers, SF).select("job_id", "ts", "state", "result_url", "err_msg")
    days = 86_400
    want = {r["job_id"]: r["outcome"] for r in jobs.outcomes(polls, days).collect()}
    assert {"done", "failed", "no result", "timeout"} >= set(want.values()) and len(set(want.values())) > 2
    cut = polls.agg(F.percentile_approx("ts", 0.5)).first()[0]
    folder = str(tmp_path / "in")
    far = timers.sql("SELECT -1L AS job_id, timestamp'2100-01-01' AS ts, 'pending' AS state, 'u' AS result_url, '' AS err_msg")
    for part in (polls.where(F.col("ts") <= cut), polls.where(F.col("ts") <= cut), polls.where(F.col("ts") > cut), polls.where(F.col("ts") > cut), far, far):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = timers.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = told(timers, stream, "deadlines_all", tmp_path / "cp", timeout_s=days, delay="0 seconds", keep_s=10 * 366 * days).where("outcome IS NOT NULL AND job_id >= 0").collect()
    assert len(got) == len(want) and {r["job_id"]: r["outcome"] for r in got} == want


def test_jobs_known_before_the_stream(timers, tmp_path):
    kinds = "job_id long, ts timestamp, state string, result_url string"
    rows = timers.sql("SELECT 1L AS job_id, timestamp'2026-01-01 00:20:00' AS ts, 'done' AS state, 'u' AS result_url UNION ALL SELECT 2L, timestamp'2026-01-01 00:20:00', 'done', 'u' UNION ALL SELECT 3L, timestamp'2026-01-01 00:20:00', 'done', 'u'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    known = timers.sql("SELECT 1L AS job_id, timestamp'2026-01-01 00:00:00' AS started, 'running' AS last, false AS over UNION ALL SELECT 2L, timestamp'2026-01-01 00:10:00', 'running', false UNION ALL SELECT 4L, timestamp'2026-01-01 00:00:00', 'running', true")
    stream = timers.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    got = {r["job_id"]: r["outcome"] for r in told(timers, stream, "deadlines_known", tmp_path / "cp", known=known).collect()}
    assert got == {1: "timeout", 2: "done", 3: "done"}


def test_a_store_without_timers_is_refused(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS job_id", "timestamp AS ts", "'done' AS state", "'u' AS result_url")
    with pytest.raises(ValueError, match="providerClass"):
        deadlines.watch(stream)
