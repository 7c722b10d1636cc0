"""Jobs at a remote service, played by a client that keeps its state in files."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import jobs
from inkstrata.sources import remote, services
from inkstrata.streaming import jobs as live


def service(folder: Path, slow: int = 2):
    """Jobs end at their poll number ``slow``; files named bad fail, odd ones are refused at the poll, big ones can't be uploaded."""

    def client(method, address, body):
        with open(folder / "calls", "a") as log:
            log.write(f"{method} {address}\n")
        if method == "POST":
            name = json.loads(body)["files"][0]["name"]
            if name.startswith("none"):
                return b'{"code": 0, "data": {}}'
            return json.dumps({"code": 0, "data": {"batch_id": name, "file_urls": [f"up/{name}"]}}).encode()
        if method == "PUT":
            if address.endswith("big.pdf"):
                raise ValueError("too much")
            return b""
        name = address.rsplit("/", 1)[-1]
        if address.startswith("get/"):
            if name == "lost.pdf":
                raise ValueError(f"nothing at {address}")
            return f"content of {name}".encode()
        if name.startswith("odd"):
            return b'{"code": 7, "msg": "no such batch"}'
        polls = (folder / "calls").read_text().splitlines().count(f"GET {address}")
        if polls < slow:
            return b'{"data": {"extract_result": []}}' if polls == 1 else b'{"data": {"extract_result": {"state": "running"}}}'
        own = {"file_name": name, "state": "failed", "err_msg": "broken"} if name.startswith("bad") else {"file_name": name, "state": "done", "full_zip_url": f"get/{name}"}
        return json.dumps({"data": {"extract_result": [{"file_name": "other", "state": "running"}, own]}}).encode()

    return client


def test_answers_of_both_modes():
    assert services.job_of("agent", b'{"data": {"task_id": 3, "file_url": "u"}}') == ("3", "u")
    for raw in (b'{"data": {"batch_id": "b", "file_urls": []}}', b'{"code": 1}', b"[]"):
        with pytest.raises(remote.RemoteError):
            services.job_of("precise", raw)
    assert services.state_of("agent", b'{"data": {"state": "done", "markdown_url": "m"}}', "x") == ("done", "m", None)
    assert services.state_of("precise", b'{"data": null}', "x")[0] == "waiting-file"
    assert services.state_of("precise", b'{"data": {"extract_result": [{"file_name": "y", "state": "running"}]}}', "x")[0] == "running"
    assert json.loads(services.request_of("precise", "a.b.pdf", {"is_ocr": True, "language": "en"})) == {"files": [{"name": "a.b.pdf", "data_id": "a.b", "is_ocr": True}], "language": "en"}
    assert json.loads(services.request_of("agent", "a.pdf", {"is_ocr": True})) == {"file_name": "a.pdf", "is_ocr": True}


def test_jobs_from_submission_to_result(spark, tmp_path):
    names = ["a.pdf", "bad.pdf", "odd.pdf", "big.pdf", "none.pdf", "lost.pdf"]
    files = spark.createDataFrame([(f"x/{n}", 3, b"pdf") for n in names] + [("x/huge.pdf", 1 << 40, b"")], "path string, length long, content binary")
    client, work = service(tmp_path, slow=3), str(tmp_path / "work")
    services.submit(files, client).write.parquet(f"{work}/jobs")
    sent = {r["path"]: (r["job_id"], r["error"]) for r in spark.read.parquet(f"{work}/jobs").collect()}
    assert {p for p, (job, _) in sent.items() if job} == {"x/a.pdf", "x/bad.pdf", "x/odd.pdf", "x/lost.pdf"}
    assert sent["x/big.pdf"][1] == "too much" and "no more than" in sent["x/huge.pdf"][1] and "gave no job" in sent["x/none.pdf"][1]
    # Stopped after the first poll, and gone on with.
    assert services.poll(spark, work, client, interval=30, timeout_s=30, started=time.time() - 31) == 3
    assert services.poll(spark, work, client, interval=0.5, timeout_s=120) == 0
    calls = (tmp_path / "calls").read_text().splitlines()
    # A job that has ended isn't asked again, across both runs.
    assert {n: calls.count(f"GET /api/v4/extract-results/batch/{n}") for n in ("a.pdf", "bad.pdf", "odd.pdf")} == {"a.pdf": 3, "bad.pdf": 3, "odd.pdf": 1}
    polls = services.polls_of(spark, work)
    assert sorted(r["state"] for r in polls.where("job_id = 'a.pdf'").collect()) == ["done", "running", "waiting-file"]
    ended = jobs.outcomes(polls)
    got = {r["job_id"]: (r["outcome"], r["result_url"], r["error"]) for r in ended.collect()}
    assert got == {"a.pdf": ("done", "get/a.pdf", None), "lost.pdf": ("done", "get/lost.pdf", None), "bad.pdf": ("failed", None, "broken"), "odd.pdf": ("failed", None, "the service's code is 7: no such batch")}
    results = {r["job_id"]: (r["content"] and bytes(r["content"]), r["error"]) for r in services.fetch(ended.where("outcome = 'done'"), client).collect()}
    assert results == {"a.pdf": (b"content of a.pdf", None), "lost.pdf": (None, "nothing at <signed-url>")}
    # The same polls as a stream.
    stream = spark.readStream.schema(services.POLLS).parquet(f"{work}/polls/*")
    query = live.watch(stream).writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r["job_id"], r["outcome"]) for r in spark.table("polled").where(F.col("outcome").isNotNull()).collect()} == {(k, v[0]) for k, v in got.items()}


def test_no_jobs(spark, tmp_path):
    spark.createDataFrame([], "path string, job_id string, error string").write.parquet(str(tmp_path / "jobs"))
    assert services.poll(spark, str(tmp_path), service(tmp_path), interval=1, timeout_s=2) == 0
    assert services.fetch(services.polls_of(spark, str(tmp_path)), service(tmp_path)).count() == 0
