"""Rows of a frame in order of a key, encoded and written by tasks as files that the driver only joins.

What a task tells the driver is a line for each file. Where executors have no mounted folder in common with the driver,
rows stream through the driver instead, one partition at a time.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tractlake.errors import ArgumentError, FormatError
from tractlake.shipping import ship

COPY_BYTES = 1 << 22
#: Of a batch: bytes by the name of a file, and whole numbers by name, which are summed up (those that begin with "max": the largest).
Encoded = tuple[dict[str, bytes], dict[str, int]]


@dataclass(frozen=True)
class Part:
    """What a task has written: (file name, path, bytes) in order, and its numbers."""

    files: list
    numbers: dict

    def paths(self, name: str) -> list[str]:
        return [path for own, path, _ in self.files if own == name]


@dataclass(frozen=True)
class Folder:
    """Where parts go, and whether tasks can write there."""

    path: str
    shared: bool


@contextmanager
def folder_of(spark: SparkSession, path: str):
    """A folder for the parts of a file, which goes afterwards: beside it where all runs in one process, else a shared one."""
    where, found = os.path.dirname(os.path.abspath(path)), None
    one = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    if not one:
        from tractlake.operators import near

        with suppress(ArgumentError):
            shared = urlsplit(near.shared_dir(spark))
            found = os.path.join(shared.path, f"parts-{uuid.uuid4().hex}") if shared.scheme in ("", "file") else None
    if found is not None:
        os.makedirs(found)
    else:
        os.makedirs(where, exist_ok=True)
        found = tempfile.mkdtemp(prefix=f".{os.path.basename(path)}-", dir=where)
        one = one or None
    try:
        yield Folder(found, one is not None)
    finally:
        shutil.rmtree(found, ignore_errors=True)


class _Files:
    """Files of one task, written in pieces; the last few stay open."""

    OPEN = 64

    def __init__(self, prefix: str):
        self.prefix, self.sizes, self.opened, self.numbers = prefix, {}, {}, {}

    def take(self, encoded: Encoded) -> None:
        for name, data in encoded[0].items():
            path, size = self.sizes.setdefault(name, (f"{self.prefix}-{len(self.sizes)}", 0))
            if name not in self.opened:
                if len(self.opened) >= self.OPEN:
                    self.opened.pop(next(iter(self.opened))).close()
                self.opened[name] = open(path, "ab")  # noqa: SIM115
            self.opened[name].write(data)
            self.sizes[name] = (path, size + len(data))
        for k, v in encoded[1].items():
            self.numbers[k] = merged(k, self.numbers.get(k), v)

    def close(self) -> Part:
        for f in self.opened.values():
            f.close()
        return Part([[name, path, size] for name, (path, size) in self.sizes.items()], self.numbers)


def merged(name: str, a: int | None, b: int) -> int:
    return b if a is None else max(a, b) if name.startswith("max") else a + b


def total(parts: list[Part], name: str, nothing: int = 0) -> int:
    out = None
    for part in parts:
        if name in part.numbers:
            out = merged(name, out, part.numbers[name])
    return nothing if out is None else out


def write(df: DataFrame, key: str | list[str], folder: Folder, encode: Callable[[pa.RecordBatch], Encoded], rows: int = 4096) -> list[Part]:
    """Parts of a frame in order of a key."""
    spark, run_id = ship(df.sparkSession), uuid.uuid4().hex[:8]
    if not folder.shared:
        from tractlake.sources.trx import arrow_in_order

        files = _Files(os.path.join(folder.path, run_id))
        for batch in arrow_in_order(df, key, rows):
            files.take(encode(batch))
        return [files.close()]
    at = folder.path

    def run(batches):
        context = TaskContext.get()
        # an attempt has files of its own, and only those of the one that Spark takes are told
        files = _Files(os.path.join(at, f"{run_id}-{context.partitionId()}-{context.taskAttemptId()}"))
        for batch in batches:
            if batch.num_rows:
                files.take(encode(batch))
        part = files.close()
        if part.files:
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([json.dumps([part.files, part.numbers])])], ["part", "told"])

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        told = df.orderBy(*([key] if isinstance(key, str) else key)).mapInArrow(run, "part int, told string").collect()
    finally:
        spark.conf.set(setting, before)
    return [checked(Part(*json.loads(r["told"]))) for r in sorted(told, key=lambda r: r["part"])]


def checked(part: Part) -> Part:
    for _, path, size in part.files:
        if not os.path.exists(path) or os.path.getsize(path) != size:
            raise FormatError(f"the driver does not see {path} of a task whole: spark.checkpoint.dir must be shared")
    return part


def blocks(parts: list[Part], name: str) -> Iterator[bytes]:
    """The bytes of a file over all parts; a part's file goes when it has been read."""
    for part in parts:
        for path in part.paths(name):
            with open(path, "rb") as f:
                while data := f.read(COPY_BYTES):
                    yield data
            os.remove(path)
