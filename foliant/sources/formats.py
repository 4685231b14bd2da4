"""Section files and log lines as formats of Spark: spark.read, readStream and write under the names `sections` and `lines_log`.

A write is a folder of its own: tasks write beside the table, and the folder gets its number by one rename when all are through, so readers see a whole write or none. A stream reads
writes in the order of their numbers, and a number is its offset. Files are reached by Arrow's file systems, from driver and executors alike.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SECTION = "doc string, image string, ord int, body string"
LOG = "value string"
_HEAD = re.compile(r"^Image:\s*(.+?)\s*$")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _writes(files: pafs.FileSystem, at: str) -> list[int]:
    """Numbers of the writes that are whole."""
    found = files.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name.split("-")[1]) for f in found if re.fullmatch(r"write-\d+", f.base_name))


#: Files of a folder that a task writes, and of a part that a task reads.
_FILES = 1000


@dataclass
class Files(InputPartition):
    """Files, or folders of files, that one task reads."""

    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    rows: int
    folder: str


def read_sections(doc: str, lines: Iterator[str]) -> Iterator[tuple[str, str, int, str]]:
    """Sections of one document, line by line: what is before the first header goes; ends of bodies are stripped."""
    image, body, n = None, [], 0
    for line in lines:
        head = _HEAD.match(line)
        if head:
            if image is not None:
                yield doc, image, n, "\n".join(body).rstrip()
            image, body, n = head[1], [], n + 1
        elif image is not None:
            body.append(line)
    if image is not None:
        yield doc, image, n, "\n".join(body).rstrip()


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Files]:
        files, at = _open(self.path)
        return self.of(_writes(files, at))

    def of(self, writes: list[int]) -> list[Files]:
        """A part for each folder of a write, whose files its task lists, and for some files at a time that lie in no folder."""
        files, at = _open(self.path)
        parts = []
        for n in writes:
            found = sorted(files.get_file_info(pafs.FileSelector(f"{at}/write-{n:08d}")), key=lambda f: f.path)
            plain = [f.path for f in found if f.is_file]
            parts += [Files([f.path]) for f in found if not f.is_file] + [Files(plain[k : k + _FILES]) for k in range(0, len(plain), _FILES)]
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        if partition is None:  # an empty table
            return
        files, _ = _open(self.path)
        for f in files.get_file_info(partition.names):
            for name in [f.path] if f.is_file else sorted(x.path for x in files.get_file_info(pafs.FileSelector(f.path))):
                yield from self._rows(files, name)

    def _rows(self, files: pafs.FileSystem, name: str) -> Iterator[tuple]:
        with files.open_input_stream(name) as f:
            lines = _lines(f)
            if self.kind == "lines_log":
                yield from ((line,) for line in lines if line.strip())
            else:
                doc = name.rsplit("/", 1)[-1].removesuffix(".txt").split(".", 1)[1]
                yield from read_sections(bytes.fromhex(doc).decode(), lines)


def _lines(f) -> Iterator[str]:
    """Lines of a stream, a block at a time."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode()
    if rest:
        yield rest.decode()


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"write": 0}

    def latestOffset(self) -> dict:
        files, at = _open(self.path)
        return {"write": max(_writes(files, at), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        files, at = _open(self.path)
        return self.of([n for n in _writes(files, at) if start["write"] < n <= end["write"]])

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, columns: list[str], overwrite: bool):
        self.path, self.kind, self.columns, self.overwrite = path, kind, columns, overwrite
        self.stage = f"_stage-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """A file a document, in the order of rows, or one file of lines. A task that runs again writes files of other names, of which the commit would take both; so a task's folders carry its attempt. A folder takes a bounded number of files."""
        from pyspark import TaskContext

        files, at = _open(self.path)
        task = TaskContext.get()
        mine_only = f"{task.partitionId()}-{task.taskAttemptId()}"
        n, doc, out, made = 0, None, None, 0
        for row in rows:
            n += 1
            mine = "" if self.kind == "lines_log" else row["doc"] or ""
            if out is None or mine != doc:
                if out:
                    out.close()
                doc = mine
                folder = f"{at}/{self.stage}/{mine_only}/{mine_only}-{made // _FILES}"
                if made % _FILES == 0:
                    files.create_dir(folder, recursive=True)
                made += 1
                out = files.open_output_stream(f"{folder}/{uuid.uuid4().hex}.{mine.encode().hex()}.txt")
            if self.kind == "lines_log":
                line = row["value"] if self.columns == ["value"] else json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False)
                out.write(((line or "").replace("\n", " ") + "\n").encode())
            else:
                body = (row["body"] or "").rstrip()
                out.write(f"Image: {row['image']}\n{body + chr(10) if body else ''}\n".encode())
        if out:
            out.close()
        return Written(n, mine_only)

    def commit(self, messages: list) -> None:
        files, at = _open(self.path)
        stage = f"{at}/{self.stage}"
        whole = f"{stage}-whole"
        files.create_dir(whole, recursive=True)
        for m in messages:  # folders of the attempts that counted
            if m is not None:
                for f in files.get_file_info(pafs.FileSelector(f"{stage}/{m.folder}", allow_not_found=True)):
                    files.move(f.path, f"{whole}/{f.base_name}")
        had = _writes(files, at)
        files.move(whole, f"{at}/write-{max(had, default=0) + 1:08d}")
        for n in had if self.overwrite else []:
            files.delete_dir(f"{at}/write-{n:08d}")
        self._clear(files, stage)

    def abort(self, messages: list) -> None:
        files, at = _open(self.path)
        self._clear(files, f"{at}/{self.stage}")

    @staticmethod
    def _clear(files: pafs.FileSystem, stage: str) -> None:
        for name in (stage, f"{stage}-whole"):
            if files.get_file_info(name).type != pafs.FileType.NotFound:
                files.delete_dir(name)


class _Source(DataSource):
    KIND, SCHEMA = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return self.SCHEMA

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"{self.KIND} needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> _Reader:
        return _Reader(self._path(), self.KIND)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._path(), self.KIND)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._path(), self.KIND, [f.name for f in schema.fields], overwrite)


class Sections(_Source):
    """Rows (doc, image, ord, body): documents are files, `Image:` lines are headers. A document's rows must be in one task and in order when written."""

    KIND, SCHEMA = "sections", SECTION


class LinesLog(_Source):
    """Lines of a log, one a row. Rows of one column `value` are written as they are, others as JSON objects."""

    KIND, SCHEMA = "lines_log", LOG


def register(spark: SparkSession) -> None:
    for source in (Sections, LinesLog):
        spark.dataSource.register(source)
