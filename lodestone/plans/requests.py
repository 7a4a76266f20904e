"""Batched model requests: request tables, backends, responses, and batch services that work file by file.

A request is ``custom_id, request`` (JSON text), a response ``custom_id, response, error``.  A backend answers
requests where they are; a transport sends whole files to a service and fetches its answers, from the tasks.  The state of a
remote job is a table of its files in the job's folder, so any session can go on with it.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.position import with_position
from lodestone.plans.scratch import discard, remove, written
from lodestone.sources.footers import opened
from lodestone.sources.registry import exists, write_whole

RESPONSE = "custom_id string, response string, error string"
MESSAGE = "array<struct<content:string,role:string>>"


def requests(df: DataFrame, key: str, messages: Column, model: str, name: str = "task", **settings) -> DataFrame:
    """``custom_id, request``: one chat request a row, named by the place of its key."""
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), *[F.lit(v).alias(k) for k, v in sorted(settings.items())])
    kept = written(df, "asked")
    placed = with_position(kept, key).withColumn("custom_id", F.concat(F.lit(f"{name}_"), F.col("pos").cast("string")))
    if kept is not df:  # the positions are a table of their own
        discard(kept)
    return placed.select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("request"))


def answered(asked: DataFrame, backend: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Responses of an in-process backend: ``backend()`` is called once a task and gives a function from a request to its response.

    What a request raises is its error.
    """

    def run(batches: Iterator[pd.DataFrame]):
        answer = backend()
        for b in batches:
            out = []
            for custom_id, request in zip(b["custom_id"], b["request"], strict=True):
                try:
                    out.append((custom_id, json.dumps({"custom_id": custom_id, "response": answer(json.loads(request))}, ensure_ascii=False), None))
                except Exception as e:  # one request's failure is its result
                    out.append((custom_id, None, str(e)))
            yield pd.DataFrame(out, columns=["custom_id", "response", "error"])

    return asked.select("custom_id", "request").mapInPandas(run, RESPONSE)


#: How each kind of service words its answers: the type of ``response``, and its messages.
SHAPES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "chat": ("struct<body:struct<choices:array<struct<message:struct<content:string,role:string>>>>>", lambda r: F.transform(r["body"]["choices"], lambda c: c["message"])),
    "complete": ("struct<choices:array<struct<messages:string>>>", lambda r: F.transform(r["choices"], lambda c: _said(c["messages"]))),
    "outputs": ("struct<outputs:array<struct<text:string>>>", lambda r: F.transform(r["outputs"], lambda c: _said(c["text"]))),
    "text": ("string", lambda r: F.array(_said(r))),
}


def _said(content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit("assistant").alias("role"))


def extracted(responses: DataFrame, shape: str) -> DataFrame:
    """``custom_id, choices``: the messages of each response without an error; what cannot be read is left out."""
    kind, choices = SHAPES[shape]
    read = responses.filter("error IS NULL").select(F.from_json("response", f"custom_id string, response {kind}").alias("j"))
    return read.filter("j.response IS NOT NULL").select("j.custom_id", choices(F.col("j.response")).cast(MESSAGE).alias("choices"))


def by_item(extracts: DataFrame, item: Column) -> DataFrame:
    """``item, contents``: the contents of all choices of all responses that belong to an item, by response and place."""
    each = extracts.select(item.alias("item"), "custom_id", F.posexplode("choices").alias("i", "m"))
    listed = F.array_sort(F.collect_list(F.struct("custom_id", "i", F.col("m.content").alias("content"))))
    return each.groupBy("item").agg(F.transform(listed, lambda x: x["content"]).alias("contents"))


class Transport(Protocol):
    """A batch service: files go up, jobs run over them, answers come down.  Statuses: ``processed``/``error`` of files, ``completed``/``failed`` of jobs, anything else is pending.

    Tasks work with pickled copies of it, each on whole files, so what becomes of files and jobs is kept by the service alone.
    A task that is run again sends its files again; the ids of its last run count.
    """

    def upload(self, lines: list[str]) -> str: ...
    def file_status(self, file_id: str) -> str: ...
    def submit(self, file_id: str) -> str: ...
    def job_status(self, job_id: str) -> str: ...
    def download(self, job_id: str) -> list[str]: ...


class OfflineTransport:
    """A service in a folder that answers with a function; ``delay`` polls are pending first.  Driver and tasks share the folder; without one, they are to be on one machine."""

    def __init__(self, answer: Callable[[dict], dict], delay: int = 0, folder: str | None = None):
        self.answer, self.delay = answer, delay
        if folder is None:
            folder = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        self.folder = folder.rstrip("/")

    def _there(self, kind: str, key: str) -> bool:
        system, at = opened(f"{self.folder}/{kind}/{key}")
        return system.get_file_info(at).is_file

    def _read(self, kind: str, key: str) -> str:
        system, at = opened(f"{self.folder}/{kind}/{key}")
        with system.open_input_stream(at, compression="gzip") as f:
            return f.read().decode()

    def _write(self, kind: str, key: str, text: str) -> None:
        system, at = opened(f"{self.folder}/{kind}/{key}")
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at, compression="gzip") as f:
            f.write(text.encode())

    def _later(self, key: str, status: str) -> str:
        polls = int(self._read("polls", key)) if self._there("polls", key) else 0
        if polls >= self.delay:
            return status
        self._write("polls", key, str(polls + 1))
        return "pending"

    def upload(self, lines):
        key = uuid.uuid4().hex
        if lines:
            self._write("files", key, "\n".join(lines))
        return key

    def file_status(self, file_id):
        return self._later(file_id, "processed" if self._there("files", file_id) else "error")

    def submit(self, file_id):
        key = uuid.uuid4().hex
        self._write("jobs", key, file_id)
        return key

    def job_status(self, job_id):
        return self._later(job_id, "completed" if self._there("jobs", job_id) else "failed")

    def download(self, job_id):
        asked = map(json.loads, self._read("files", self._read("jobs", job_id)).split("\n"))
        return [json.dumps({"custom_id": r["custom_id"], "response": self.answer(r)}, ensure_ascii=False) for r in asked]


class RemoteBatch:
    """Requests added to a folder, taken through a transport a file at a time, and their responses.

    Files go from new to uploaded, submitted and downloaded, or to failed; :meth:`step` moves each as far as the service lets
    it and writes the state, so a call after a crash goes on from the last step.  The tasks talk to the service; neither requests
    nor responses come to the driver.
    """

    STATE = "file long, state string, file_id string, job_id string"
    #: What a step writes: a row for each file, and with null for the state one for each line that came down.
    STEP = f"{STATE}, value string"

    def __init__(self, spark: SparkSession, folder: str, per_file: int = 50_000):
        self.spark, self.folder, self.per_file = spark, folder.rstrip("/"), per_file

    def add(self, asked: DataFrame) -> int:
        """Write the requests and deal them to files, in the order of their partitions; the number of files."""
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # Spark's row number within the partition
        placed = asked.select(F.spark_partition_id().alias("part"), place.alias("place"), F.col("request").alias("value"))
        placed.write.option("compression", "zstd").parquet(f"{self.folder}/requests")
        counts = self.spark.read.parquet(f"{self.folder}/requests").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = write_whole(counts.select("part", "n", before.alias("before"), F.lit(self.per_file).cast("long").alias("per_file")), f"{self.folder}/parts")
        files = -(-(parts.agg(F.sum("n")).first()[0] or 0) // self.per_file)
        self._save(self.spark.range(files).selectExpr("id AS file", "'new' AS state", "NULL AS file_id", "NULL AS job_id", "NULL AS value"), 0)
        return files

    def _save(self, rows: DataFrame, version: int) -> None:
        write_whole(rows.to(self.spark.createDataFrame([], self.STEP).schema), f"{self.folder}/state/{version:08d}")

    def _version(self) -> int:
        n = 0
        while exists(self.spark, f"{self.folder}/state/{n + 1:08d}"):
            n += 1
        return n

    def _state(self, version: int) -> DataFrame:
        rows = self.spark.read.schema(self.STEP).parquet(f"{self.folder}/state/{version:08d}")
        return rows.filter("state IS NOT NULL").drop("value")

    def state(self) -> list[tuple]:
        """``file, state, file_id, job_id`` of each file."""
        return [tuple(r) for r in self._state(self._version()).orderBy("file").collect()]

    def _uploaded(self, new: DataFrame, transport: Transport) -> DataFrame:
        """The rows of new files once they are sent; each file's lines meet in one task, which holds one file at a time."""
        parts = self.spark.read.parquet(f"{self.folder}/parts").drop("n")
        placed = self.spark.read.parquet(f"{self.folder}/requests").join(F.broadcast(parts), "part").withColumn("pos", F.col("before") + F.col("place"))
        lines = placed.select(F.expr("pos DIV per_file").alias("file"), "pos", "value").join(new.select("file"), "file", "left_semi")

        def send(batches: Iterator[pd.DataFrame]):
            file, held = None, []
            row = lambda: pd.DataFrame([(file, "uploaded", transport.upload(held), None, None)], columns=["file", "state", "file_id", "job_id", "value"])
            for b in batches:
                for number, more in b.groupby("file", sort=False)["value"]:
                    if held and number != file:
                        yield row()
                        held = []
                    file = number
                    held += more.tolist()
            if held:
                yield row()

        return lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").mapInPandas(send, self.STEP)

    def step(self, transport: Transport) -> bool:
        """Move every file on by one step; whether all are downloaded or failed."""
        version = self._version()
        now = self._state(version)
        counts = dict(now.groupBy("state").count().collect())
        rows = now.filter("state IN ('downloaded', 'failed')").withColumn("value", F.lit(None).cast("string"))
        if counts.get("new"):
            rows = rows.union(self._uploaded(now.filter("state = 'new'"), transport))
        waiting = counts.get("uploaded", 0) + counts.get("submitted", 0)
        if waiting:
            tasks = min(waiting, 4 * self.spark.sparkContext.defaultParallelism)
            rows = rows.union(now.filter("state IN ('uploaded', 'submitted')").repartition(tasks).mapInPandas(lambda batches: _moved(batches, transport), self.STEP))
        self._save(rows, version + 1)
        return self._state(version + 1).filter("state NOT IN ('downloaded', 'failed')").isEmpty()

    def responses(self) -> DataFrame:
        """The responses so far."""
        lines = self.spark.read.schema(self.STEP).parquet(f"{self.folder}/state/????????").filter("state IS NULL")
        return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.col("value").alias("response"), F.lit(None).cast("string").alias("error"))

    def clean(self) -> None:
        """Remove the folder."""
        remove(self.spark, self.folder)


def _moved(batches: Iterator[pd.DataFrame], transport: Transport) -> Iterator[pd.DataFrame]:
    """Files that are with the service, each moved as far as it lets them; behind a file that is downloaded come its lines."""
    names, lines_at_once = ["file", "state", "file_id", "job_id", "value"], 1000
    for b in batches:
        for file, state, file_id, job_id in b.itertuples(index=False, name=None):
            lines: list[str] = []
            if state == "uploaded":
                status = transport.file_status(file_id)
                if status == "processed":
                    state, job_id = "submitted", transport.submit(file_id)
                elif status == "error":
                    state = "failed"
            else:
                status = transport.job_status(job_id)
                if status == "completed":
                    state, lines = "downloaded", transport.download(job_id)
                elif status == "failed":
                    state = "failed"
            yield pd.DataFrame([(file, state, file_id, job_id, None)], columns=names)
            for i in range(0, len(lines), lines_at_once):
                yield pd.DataFrame([(file, None, None, None, x) for x in lines[i : i + lines_at_once]], columns=names)
