"""Requests that a front end spools and Spark streams, and answers that Spark sends: data sources in Python.

Both work on any file system that Arrow opens by its address (a mounted folder, HDFS, an object store).
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: Bytes of spooled lines that one task reads, about.
RANGE_BYTES = 16 << 20


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def spooled_line(body: bytes, received_at: float | None = None) -> bytes:
    """A line of a spool: what the front end appends for each request, its body untouched."""
    return json.dumps({"at": time.time() if received_at is None else received_at, "raw": base64.b64encode(body).decode()}).encode() + b"\n"


@dataclass
class Lines(InputPartition):
    """Whole lines of a spool file, from one byte to another."""

    name: str
    start: int
    end: int

    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class Spool(DataSource):
    """A stream of requests (file, position, at, raw) from a folder of files that only grow, a line for each request.

    An offset has the bytes that were taken of each file, so it doesn't matter which file grows when, and a line that
    is still being written waits for the next batch. (file, position) tell requests apart, also after a restart.
    """

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "file string, position long, at double, raw binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolReader(self.options["path"])


class SpoolReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = _opened(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name: self._whole(fs, f) for f in sorted(found, key=lambda f: f.base_name) if f.is_file and not f.base_name.startswith(("_", "."))}

    def _whole(self, fs: arrow_fs.FileSystem, info) -> int:
        """Bytes up to the end of the last line that is finished, searched for from the end."""
        with fs.open_input_file(info.path) as f:
            end = info.size
            while end > 0:
                start = max(0, end - 65536)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for name, upto in end.items():
            at = start.get(name, 0)
            out += [Lines(name, k, min(k + RANGE_BYTES, upto)) for k in range(at, upto, RANGE_BYTES)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        """The lines that begin in the range, the last one to its end."""
        fs, folder = _opened(self.path)
        with fs.open_input_file(f"{folder.rstrip('/')}/{partition.name}") as f:
            at = partition.start
            if at:  # a line that begins before is another range's
                f.seek(at - 1)
                at += len(_line(f)) - 1
            f.seek(at)
            while at < partition.end:
                line = _line(f)
                if not line:
                    return
                body = json.loads(line)
                yield partition.name, at, float(body["at"]), base64.b64decode(body["raw"])
                at += len(line)


def _line(f) -> bytes:
    """The next line with its end, from a file that reads blocks only; the file stands after it."""
    out, start = b"", f.tell()
    while True:
        block = f.read(65536)
        at = block.find(b"\n")
        if at >= 0 or not block:
            out += block[: at + 1]
            f.seek(start + len(out))
            return out
        out += block


@dataclass
class Sent(WriterCommitMessage):
    n_sent: int
    n_known: int
    failed: list


def outbox(send: Callable[[dict, str], int], name: str = "outbox") -> type[DataSource]:
    """A data source that sends the rows of a stream: send(row, key) gives an HTTP status.

    Options: path, a folder for what was sent, and key, a column. A row's idempotency key goes with it, and is marked
    once the answer is 200 to 299: a task or a batch that is repeated passes marked rows over, and a receiver knows by
    the key the one that was sent just before a crash. If rows fail the batch fails, after all others were sent,
    and is tried again. What a batch did is in the folder under its number.
    """

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
            return Writer(self.options["path"], self.options["key"])

    class Writer(DataSourceStreamWriter):
        def __init__(self, path: str, key: str):
            self.path, self.key = path, key

        def write(self, rows) -> Sent:
            fs, folder = _opened(self.path)
            fs.create_dir(f"{folder}/sent", recursive=True)
            done = Sent(0, 0, [])
            for row in rows:
                key = str(row[self.key])
                mark = f"{folder}/sent/{hashlib.sha256(key.encode()).hexdigest()}"
                if fs.get_file_info(mark).type != arrow_fs.FileType.NotFound:
                    done.n_known += 1
                    continue
                try:
                    status = send(row.asDict(), key)
                    error = None if 200 <= status <= 299 else f"unexpected_status: {status}"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                if error is None:
                    with fs.open_output_stream(mark) as f:
                        f.write(key.encode())
                    done.n_sent += 1
                else:
                    done.failed.append([key, error])
            if done.failed:
                raise RuntimeError(f"{len(done.failed)} rows weren't sent: {done.failed[:3]}")
            return done

        def commit(self, messages: list, batchId: int) -> None:
            fs, folder = _opened(self.path)
            fs.create_dir(f"{folder}/batches", recursive=True)
            with fs.open_output_stream(f"{folder}/batches/{batchId}.json") as f:
                f.write(json.dumps({"sent": sum(m.n_sent for m in messages if m), "known": sum(m.n_known for m in messages if m)}).encode())

        def abort(self, messages: list, batchId: int) -> None:
            """Nothing: what was sent is marked."""

    return Outbox


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Spool)
