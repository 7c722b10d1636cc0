"""Conversion jobs at a remote service: submitted, polled and fetched as tables.

The caller gives the transport, ``client(method, address, body) -> bytes``, with its own secrets and
time-outs; requests, checks of every answer, repeated calls and the state of each job are the
library's. Jobs are a table in a shared folder. Polls are a stream whose offsets are their
numbers by the clock: of each, the jobs that haven't ended are asked on the executors and the answers
kept as ``polls/poll=<n>`` before the next. A run that was stopped goes on with the
polls it has; ``streaming.jobs.watch`` and ``operators.jobs.outcomes`` read the same table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from inkstrata.operators.jobs import DONE, FAILED, POLL_S, TIMEOUT_S

from .readers import LIMITS
from .remote import RemoteError, answer_of, retrying

Client = Callable[[str, str, bytes | None], bytes]

# Addresses of the service by mode, and where its answers have what is asked for.
CREATE = {"agent": "/api/v1/agent/parse/file", "precise": "/api/v4/file-urls/batch"}
POLL = {"agent": "/api/v1/agent/parse/", "precise": "/api/v4/extract-results/batch/"}
RESULT = {"agent": "markdown_url", "precise": "full_zip_url"}
WAITING = "waiting-file"
POLLS = "job_id string, ts timestamp, state string, result_url string, err_msg string"
ENDED = (DONE, FAILED)


def request_of(mode: str, name: str, options: dict) -> bytes:
    """The body of a request for a job: one file and what is wanted of it."""
    if mode == "agent":
        return json.dumps({"file_name": name, **options}).encode()
    own = {k: options[k] for k in ("is_ocr", "page_ranges", "data_id") if k in options}
    file = {"name": name, "data_id": name.rsplit(".", 1)[0][:120], **own}
    return json.dumps({"files": [file], **{k: v for k, v in options.items() if k not in own}}).encode()


def job_of(mode: str, raw: bytes) -> tuple[str, str]:
    """(job's id, address to upload to) of the service's answer."""
    data = answer_of(raw).get("data") or {}
    address = data.get("file_url") if mode == "agent" else next(iter(data.get("file_urls") or []), None)
    job = data.get("task_id" if mode == "agent" else "batch_id")
    if not job or not address:
        raise RemoteError("the service gave no job or no address to upload to")
    return str(job), str(address)


def state_of(mode: str, raw: bytes, name: str) -> tuple[str, str | None, str | None]:
    """(state, address of the result, message) of a job in the answer to a poll; of a batch the file's own entry, else its first."""
    data = answer_of(raw).get("data") or {}
    if mode == "precise":
        found = data.get("extract_result") or []
        found = [x for x in ([found] if isinstance(found, dict) else found) if isinstance(x, dict)]
        data = next((x for x in found if x.get("file_name") == name), found[0] if found else {"state": WAITING})
    return str(data.get("state") or "unknown"), data.get(RESULT[mode]), data.get("err_msg")


def submit(files: DataFrame, client: Client, mode: str = "precise", tries: int = 3, **options) -> DataFrame:
    """path, job_id, error of every file (path, length, content) sent to the service.

    Files over the mode's limit are refused and not sent. A task that is made again sends its files
    again, so write the result before it is used.
    """
    limit, call = LIMITS[mode], retrying(client, tries)

    def one(path: str, length: int, content: bytes | None) -> tuple[str | None, str | None]:
        try:
            if length > limit or content is None:
                raise RemoteError(f"the mode takes no more than {limit} bytes")
            job, address = job_of(mode, call("POST", CREATE[mode], request_of(mode, path.rsplit("/", 1)[-1], options)))
            call("PUT", address, content)
            return job, None
        except RemoteError as error:
            return None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*row) for row in zip(*[b.column(c).to_pylist() for c in ("path", "length", "content")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array([g[k] for g in got], pa.string()) for k in range(2)]], ["path", "job_id", "error"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, job_id string, error string")


def ask_states(jobs: DataFrame, client: Client, mode: str = "precise", tries: int = 3) -> DataFrame:
    """job_id, ts, state, result_url, err_msg of each job (path, job_id) asked once. A refused or failing call is the state ``failed``."""
    call = retrying(client, tries)

    def one(path: str, job: str) -> tuple[str, str | None, str | None]:
        try:
            return state_of(mode, call("GET", POLL[mode] + quote(job), None), path.rsplit("/", 1)[-1])
        except (RemoteError, ValueError) as error:
            return FAILED, None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*row) for row in zip(b.column("path").to_pylist(), b.column("job_id").to_pylist(), strict=True)]
            now = pa.array([int(time.time() * 1e6)] * len(got), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([b.column("job_id"), now, *[pa.array([g[k] for g in got], pa.string()) for k in range(3)]], [c.split()[0] for c in POLLS.split(", ")])

    return jobs.select("path", "job_id").mapInArrow(run, POLLS)


class PollClock(DataSource):
    """A stream of poll numbers by the clock: options ``start`` (seconds since the epoch), ``interval`` and ``last``."""

    @classmethod
    def name(cls) -> str:
        return "poll_clock"

    def schema(self) -> str:
        return "poll long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(float(self.options["start"]), float(self.options["interval"]), int(self.options["last"]))


class PollReader(DataSourceStreamReader):
    """Offsets are the polls that are due, so a restart goes on where the clock is; of several that fell due together the last is made."""

    def __init__(self, start: float, interval: float, last: int):
        self.start, self.interval, self.last = start, interval, last

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": max(0, min(self.last, int((time.time() - self.start) / self.interval) + 1))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(end["poll"])] if end["poll"] > start["poll"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value,)


def polls_of(spark: SparkSession, work_dir: str) -> DataFrame:
    """All answers to polls under a folder."""
    try:
        return spark.read.schema(POLLS).parquet(f"{work_dir}/polls").select(*[c.split()[0] for c in POLLS.split(", ")])
    except AnalysisException:  # none yet
        return spark.createDataFrame([], POLLS)


def poll(spark: SparkSession, work_dir: str, client: Client, mode: str = "precise", interval: float = POLL_S, timeout_s: float = TIMEOUT_S, tries: int = 3, started: float | None = None) -> int:
    """Ask for the jobs of ``work_dir/jobs`` (path, job_id) until all have ended or their time is up; how many haven't.

    Answers go to ``work_dir/polls``. Jobs that have ended are not asked again, in this run or one after it. ``started``:
    when the time began to run, now if it isn't given. A poll that is made again after a stop takes the place of its first answers.
    """
    start = time.time() if started is None else started
    spark.dataSource.register(PollClock)
    jobs = spark.read.parquet(f"{work_dir}/jobs").where("job_id is not null").select("path", "job_id")
    left = []

    def made(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        due = batch.agg(F.max("poll")).first()[0]
        if due is None:
            return
        ended = polls_of(own, work_dir).where(F.col("state").isin(*ENDED)).select("job_id").distinct()
        asked = ask_states(jobs.join(ended, "job_id", "left_anti"), client, mode, tries)
        path = f"{work_dir}/polls/poll={int(start * 1000)}-{due}"
        asked.write.mode("overwrite").parquet(path)
        left.append(own.read.parquet(path).where(~F.col("state").isin(*ENDED)).count())

    last = max(1, int(timeout_s / interval))
    clock = spark.readStream.format("poll_clock").option("start", start).option("interval", interval).option("last", last).load()
    query = clock.writeStream.foreachBatch(made).option("checkpointLocation", f"{work_dir}/clock-{int(start * 1000)}").start()
    try:
        while not query.awaitTermination(min(1.0, interval)):
            if left and (left[-1] == 0 or time.time() > start + timeout_s):
                break
    finally:
        query.stop()
    return left[-1] if left else jobs.count()


def fetch(ended: DataFrame, client: Client, tries: int = 3, fallbacks: Sequence[Client] = ()) -> DataFrame:
    """job_id, content, error of each job's result (job_id, result_url), fetched with repeated calls and then each fallback once."""
    call = retrying(client, tries, most=4, then=fallbacks)

    def one(address: str | None) -> tuple[bytes | None, str | None]:
        try:
            return (call("GET", address, None), None) if address else (None, "no result")
        except RemoteError as error:
            return None, str(error).replace(address, "<signed-url>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, address in enumerate(b.column("result_url").to_pylist()):  # one result at a time is held
                content, error = one(address)
                yield pa.RecordBatch.from_arrays([b.column("job_id").slice(k, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["job_id", "content", "error"])

    return ended.select("job_id", "result_url").mapInArrow(run, "job_id string, content binary, error string")
