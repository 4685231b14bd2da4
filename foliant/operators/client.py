"""Calls made from executors: bounded concurrency, retries by the schedule, answers kept by request so that nothing is asked twice."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calls import DELAYS, TRANSIENT

ANSWER = "request_id string, code int, content string, error string, tries int, waited double"

#: request (its columns by name) and attempt (from 1) to an HTTP-like code and a text. An exception is a failed connection, which is tried again.
Call = Callable[[dict, int], tuple[int, str | None]]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def spread(request_id: str, attempt: int, base: float, jitter: float) -> float:
    """The delay before the next try, spread to both sides by a hash of the request and the try, so reruns wait alike."""
    h = int.from_bytes(hashlib.sha256(f"{request_id} {attempt}".encode()).digest()[:8], "big") / 2**64
    return base * (1 - jitter + 2 * jitter * h)


def answer(call: Call, request: dict, codes: tuple[int, ...], delays: tuple[float, ...], jitter: float, sleep: Callable[[float], None]) -> dict:
    """One request with its retries: a transient code or a failed connection is tried again as long as a delay is left, any other failure ends it."""
    waited = 0.0
    for attempt in range(1, len(delays) + 2):
        error = content = None
        try:
            code, content = call(request, attempt)
        except Exception as e:  # whatever a transport raises
            code, error = None, f"{type(e).__name__}: {e}"
        good = code is not None and code < 400
        if good or attempt > len(delays) or not (code is None or code in codes):
            error = None if good else error or f"status {code}"
            return {"request_id": request["request_id"], "code": code, "content": content if good else None, "error": error, "tries": attempt, "waited": waited}
        wait = spread(request["request_id"], attempt, delays[attempt - 1], jitter)
        sleep(wait)
        waited += wait
    raise AssertionError


#: Seconds after which a journal goes on in another file: some stores show a file only when it is closed.
_OPEN_S = 1.0


class _Journal:
    """Answers of one task's attempt, a line each, in files of its own under `at`. A line is with the file system when `add` returns."""

    def __init__(self, files: pafs.FileSystem, at: str):
        self.files, self.at, self.out, self.since, self.lock = files, at, None, 0.0, threading.Lock()

    def add(self, got: dict) -> None:
        line = json.dumps(got).encode() + b"\n"
        with self.lock:
            if self.out is None:
                self.out, self.since = self.files.open_output_stream(f"{self.at}/{uuid.uuid4().hex}.json"), time.monotonic()
            self.out.write(line)
            self.out.flush()
            if time.monotonic() - self.since > _OPEN_S:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _kept(files: pafs.FileSystem, at: str) -> dict[str, dict]:
    """Answers by request of the journals under `at`; a line that a worker died over is none."""
    found = {}
    for f in files.get_file_info(pafs.FileSelector(at)):
        with files.open_input_stream(f.path) as lines:
            for line in lines.read().split(b"\n"):
                try:
                    got = json.loads(line)
                except ValueError:
                    continue
                found[got["request_id"]] = got
    return found


class Client:
    """Asks on executors, `threads` requests at a time in each task, and keeps answers under `path`, a folder that driver and executors share.

    An answer is written to the journal there the moment it is known, as a line of the files of its task, so a task that is lost and runs again, and a later run, read it instead of asking; what was in flight
    when a worker died is asked again. When a run is through, its answers become one Parquet part and their journal goes. Failures that the schedule gave up are kept too, and asked again only with `again`.
    """

    def __init__(self, spark: SparkSession, path: str, call: Call, threads: int = 8, per_task: int = 256, codes: tuple[int, ...] = TRANSIENT, delays: tuple[float, ...] = DELAYS, jitter: float = 0.25, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.path, self.call, self.threads, self.per_task = spark, path.rstrip("/"), call, threads, per_task
        self.codes, self.delays, self.jitter, self.sleep = codes, delays, jitter, sleep

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        f = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return f.exists(p) and len(f.listStatus(p)) > 0

    def answers(self) -> DataFrame:
        """What is kept, one row a request: a later answer stands for an earlier failure."""
        parts = [self.spark.createDataFrame([], ANSWER)]
        if self._exists("answers"):
            parts.append(self.spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(f"{self.path}/answers"))
        if self._exists("journal"):
            parts.append(self.spark.read.schema(ANSWER).option("recursiveFileLookup", "true").json(f"{self.path}/journal"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        best = F.max_by(F.struct(*rows.columns), F.struct(F.col("error").isNull(), F.coalesce("tries", F.lit(0)), F.coalesce("content", "error")))
        return rows.filter("request_id is not null").groupBy(F.col("request_id").alias("id")).agg(best.alias("a")).select("a.*")

    def ask(self, requests: DataFrame, again: bool = False) -> DataFrame:
        """requests (request_id and what `call` reads) with code, content, error, tries and waited. Each id is asked once however often it stands there; null ids are not asked, and their rows have no answer."""
        known = self.answers() if not again else self.answers().filter("error is null")
        todo = requests.filter("request_id is not null").dropDuplicates(["request_id"]).join(known.select("request_id"), "request_id", "left_anti")
        todo = todo.select(F.col("request_id"), F.to_json(F.struct(*requests.columns)).alias("request"))
        n = todo.count()
        if n:
            self._run(todo.repartition(-(-n // self.per_task), "request_id"))
        return requests.join(self.answers(), "request_id", "left")

    def _run(self, todo: DataFrame) -> None:
        call, threads, codes, delays, jitter, sleep = self.call, self.threads, self.codes, self.delays, self.jitter, self.sleep
        run = uuid.uuid4().hex
        journal, done = f"{self.path}/journal/run={run}", f"{self.path}/answers/run={run}"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            files, at = _open(f"{journal}/part-{TaskContext.get().partitionId()}")
            files.create_dir(at, recursive=True)
            had, lines = _kept(files, at), _Journal(files, at)

            def one(row: tuple[str, str]) -> dict:
                if row[0] in had:  # a task of this run that was lost had it
                    return had[row[0]]
                got = answer(call, json.loads(row[1]), codes, delays, jitter, sleep)
                lines.add(got)
                return got

            try:
                with ThreadPoolExecutor(threads) as pool:
                    for batch in batches:
                        rows = list(pool.map(one, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
                        kinds = {"request_id": pa.string(), "code": pa.int32(), "content": pa.string(), "error": pa.string(), "tries": pa.int32(), "waited": pa.float64()}
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
            finally:
                lines.close()

        todo.mapInArrow(ask, ANSWER).write.parquet(done)
        files, at = _open(journal)
        if files.get_file_info(at).type != pafs.FileType.NotFound:
            files.delete_dir(at)
