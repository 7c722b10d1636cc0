"""Remote jobs as tables of polls: state changes, results and deadlines.

``polls``: job_id, ts, state, result_url, err_msg; several rows of a job may share a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States in which a job ends.
DONE, FAILED = "done", "failed"
TIMEOUT_S, POLL_S = 900, 3


def state_changes(polls: DataFrame, *tie: str) -> DataFrame:
    """job_id, ts, state of each poll that differs in state from the job's poll before."""
    order = W.partitionBy("job_id").orderBy("ts", *tie)
    rows = polls.withColumn("_before", F.lag("state").over(order)).withColumn("_n", F.row_number().over(order))
    return rows.where((F.col("_n") == 1) | ~F.col("state").eqNullSafe(F.col("_before"))).select("job_id", "ts", "state")


def outcomes(polls: DataFrame, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """job_id, outcome, ended, result_url, error of every job: its first end within the time since its first poll.

    Outcomes: ``done``, ``failed``, ``no result`` (done without an address) and ``timeout``. At one time a failure
    counts before success. Aggregates alone, combined before they move.
    """
    start = polls.groupBy("job_id").agg(F.min("ts").alias("_start"))
    ends = polls.where(F.col("state").isin(DONE, FAILED)).join(start, "job_id")
    ends = ends.where(F.col("ts") <= F.col("_start") + F.make_dt_interval(secs=F.lit(timeout_s).cast("decimal(18,6)")))
    first = F.min(F.struct(F.col("ts").alias("ts"), (F.col("state") == DONE).alias("ok"), F.coalesce("result_url", F.lit("")).alias("url"), F.coalesce("err_msg", F.lit("unknown error")).alias("err")))
    got = ends.groupBy("job_id").agg(first.alias("_e"))
    e = F.col("_e")
    outcome = F.when(e.isNull(), "timeout").when(~e["ok"], "failed").when(e["url"] == "", "no result").otherwise("done")
    return start.join(got, "job_id", "left").select("job_id", outcome.alias("outcome"), e["ts"].alias("ended"), F.when(outcome == "done", e["url"]).alias("result_url"), F.when(outcome == "failed", e["err"]).alias("error"))


def batch_result(results: Column, file_name: Column) -> Column:
    """Of a batch's results (file_name, ...) the one of this file, else the first, null if there are none."""
    return F.coalesce(F.get(F.filter(results, lambda r: r["file_name"] == file_name), 0), F.get(results, 0))


def backoff_seconds(attempt: Column, most: int = 8) -> Column:
    """Seconds to wait after the attempt of this number (from 1)."""
    return F.least(F.pow(F.lit(2), attempt - 1), F.lit(most)).cast("long")


def mode_of(mode: Column, token: Column, table_mode: Column, has_tables: Column) -> Column:
    """(mode, error) of a conversion: ``auto`` is precise with a token and light without one."""
    chosen = F.when(mode == "auto", F.when(F.coalesce(token, F.lit("")) != "", "precise").otherwise("agent")).otherwise(mode)
    error = F.when((table_mode == "image") & ((chosen != "precise") | ~has_tables), "images of tables need the precise mode and table recognition").when(
        (chosen == "precise") & (F.coalesce(token, F.lit("")) == ""), "the precise mode needs a token"
    )
    return F.struct(chosen.alias("mode"), error.alias("error"))
