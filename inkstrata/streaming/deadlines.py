"""Jobs with deadlines as a stream with timers: a timer for each job's end of time, and one for when it may be forgotten.

State lives in the state store with timers, so the session needs ``STORE`` as its state store provider (see ``use_store``).
Of a job that was known before the stream, its first poll can be given as initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkstrata.operators.jobs import DONE, FAILED, TIMEOUT_S

from .jobs import KEEP_S, STATE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_store(spark: SparkSession) -> None:
    """Streams that start from now on keep their state where timers can be kept."""
    spark.conf.set(STORE_KEY, STORE)


class Deadlines(StatefulProcessor):
    """A job's state (started, last, over) and its one timer; times are microseconds, timers milliseconds."""

    def __init__(self, limit: int, kept: int):
        self.limit, self.kept = limit, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def close(self) -> None:
        pass

    def _keep(self, started: int, last: str | None, over: bool) -> None:
        self.job.update((started, last, over))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((started + self.limit + (self.kept if over else 0)) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(int(row["started"]), row["last"], bool(row["over"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, last, over = self.job.get() if self.job.exists() else (None, None, False)
        got = pd.concat(list(rows))
        url = got["result_url"].fillna("").astype(str)
        # At one time a failure counts before success, and success without an address before others.
        order = pd.DataFrame({"at": got["at"], "last": (got["state"] != FAILED).astype(int), "url": url}).sort_values(["at", "last", "url"], kind="stable").index
        told = []
        for at, new, address in zip(got["at"][order].tolist(), got["state"][order], url[order], strict=True):
            started = at if started is None else started
            if over or new == last:
                continue
            end = None
            if at > started + self.limit:
                end = "timeout"
            elif new == FAILED:
                end = "failed"
            elif new == DONE:
                end = "done" if address else "no result"
            last, over = new, end is not None
            told.append((key[0], at, new, end))
        self._keep(started, last, over)
        yield pd.DataFrame(told, columns=["job_id", "at", "state", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        if self.job.exists():
            started, last, over = self.job.get()
            if over:
                self.job.clear()
            else:
                told.append((key[0], started + self.limit, last, "timeout"))
                self._keep(started, last, True)
        yield pd.DataFrame(told, columns=["job_id", "at", "state", "outcome"])


def watch(polls: DataFrame, timeout_s: float = TIMEOUT_S, delay: str = "1 minute", keep_s: float = KEEP_S, known: DataFrame | None = None) -> DataFrame:
    """job_id, ts, state, outcome for each change of a job's state, as ``streaming.jobs.watch`` has it.

    ``polls``: a stream of job_id, ts, state, result_url. ``known``: job_id, started (timestamp), last (state), over, one row for each job
    that was polled before; it holds from the stream's first batch on. Jobs without id or time are left out. A job's row goes
    ``keep_s`` after its deadline; until then polls of a job that is over change nothing, replayed ones too.
    """
    if polls.sparkSession.conf.get(STORE_KEY) != STORE:
        raise ValueError(f"set {STORE_KEY} to {STORE} (use_store)")
    kind = polls.schema["job_id"].dataType.simpleString()
    timed = polls.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "state", "result_url")
    timed = timed.where(F.col("job_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    first = None
    if known is not None:
        first = known.select("job_id", F.unix_micros("started").alias("started"), "last", "over").groupBy("job_id")
    told = timed.withColumn("at", F.unix_micros("ts")).groupBy("job_id").transformWithStateInPandas(
        Deadlines(int(timeout_s * 1e6), int(keep_s * 1e6)), f"job_id {kind}, at long, state string, outcome string", "Append", "EventTime", first
    )
    return told.select("job_id", F.timestamp_micros("at").alias("ts"), "state", "outcome")
