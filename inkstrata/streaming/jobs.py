"""Polls of remote jobs as a stream: a job's state is kept until it ends or its time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstrata.operators.jobs import DONE, FAILED, TIMEOUT_S

STATE = "started long, last string, over boolean"
KEEP_S = 86_400.0


def watch(polls: DataFrame, timeout_s: float = TIMEOUT_S, delay: str = "1 minute", keep_s: float = KEEP_S) -> DataFrame:
    """job_id, ts, state, outcome for each change of a job's state; outcome is set on its last row.

    ``polls`` is a stream of job_id, ts, state, result_url. Time is event time under a watermark of
    ``delay``: a job that hasn't ended when it passes the deadline ends as ``timeout``. Polls of
    a job that is over are ignored, so a replayed batch changes nothing; what is known of a job
    goes ``keep_s`` after its deadline. Times are microseconds since the epoch inside, whatever the
    session's time zone.
    """
    limit, kept = int(timeout_s * 1e6), int(keep_s * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, over = state.get if state.exists else (None, None, False)
        rows = []
        if state.hasTimedOut and over:
            state.remove()
        else:
            if state.hasTimedOut:
                rows.append((key[0], started + limit, last, "timeout"))
                over = True
            else:
                got = pd.concat(list(frames)).sort_values("at", kind="stable")
                for at, new, url in zip(got["at"].tolist(), got["state"], got["result_url"], strict=True):
                    started = at if started is None else started
                    if over or new == last:
                        continue
                    end = None
                    if at > started + limit:
                        end = "timeout"
                    elif new == FAILED:
                        end = "failed"
                    elif new == DONE:
                        end = "done" if isinstance(url, str) and url else "no result"
                    last, over = new, end is not None
                    rows.append((key[0], at, new, end))
            state.update((started, last, over))
            due = started + limit + (kept if over else 0)
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["job_id", "at", "state", "outcome"])

    timed = polls.select("job_id", "ts", "state", "result_url").where(F.col("job_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    kind = polls.schema["job_id"].dataType.simpleString()
    told = timed.withColumn("at", F.unix_micros("ts")).groupBy("job_id").applyInPandasWithState(step, f"job_id {kind}, at long, state string, outcome string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("job_id", F.timestamp_micros("at").alias("ts"), "state", "outcome")
