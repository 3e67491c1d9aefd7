"""Folders and tables that change in one step: new files first, a commit record last.

``root/_commits/<number>`` is a small JSON record of what version ``number`` consists
of; the highest number is the current version. Data is written to a folder of its
own (``root/data-<number>-<unique>``), which nobody reads before its record exists. A
record is written aside and renamed to its number without overwriting, so a write that
stops anywhere leaves the version before it, and of two writers that started from one
version only the first commits.

A table's record lists folders with the partitions that still count in each, so an
append rewrites only the partitions it touches. Old folders stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version this one was to become."""


class _Commits:
    """The records of one root folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def record(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"_commits/{number:020d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, record: dict) -> None:
        fs, aside = self._fs(), self._path(f"_commits/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        renames = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(renames, 1)
        options[0] = renames.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self.conf)
        try:
            context.rename(aside, self._path(f"_commits/{number:020d}"), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(f"version {number} of {self.root} exists") from e
            raise

    def next_folder(self) -> tuple[int, str]:
        number = (self.numbers() or [0])[-1] + 1
        return number, f"data-{number}-{uuid.uuid4().hex}"

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders and records that none of the last ``keep`` versions needs; returns the folders."""
        numbers = self.numbers()
        kept = numbers[-keep:]
        needed = {f["folder"] for n in kept for f in self.record(n)["folders"]}
        old = sorted({f["folder"] for n in numbers[:-keep] for f in self.record(n)["folders"]} - needed)
        for folder in old:
            self._fs().delete(self._path(folder), True)
        for n in numbers[:-keep]:
            self._fs().delete(self._path(f"_commits/{n:020d}"), False)
        return old


class VersionedFolder(_Commits):
    """A folder whose whole content is replaced at once."""

    def current(self) -> str | None:
        """Path of the current version, None before the first."""
        numbers = self.numbers()
        return f"{self.root}/{self.record(numbers[-1])['folders'][0]['folder']}" if numbers else None

    def publish(self, build: Callable[[str], T]) -> T:
        """Let ``build`` fill a new folder, then make it current; returns what ``build`` returns."""
        number, folder = self.next_folder()
        out = build(f"{self.root}/{folder}")
        self.commit(number, {"folders": [{"folder": folder, "partitions": None}]})
        return out


class VersionedTable(_Commits):
    """A Parquet table, partitioned by ``partition_by`` (maybe by nothing)."""

    def __init__(self, spark: SparkSession, root: str, partition_by: list[str] | None = None):
        super().__init__(spark, root)
        self.by = list(partition_by or [])

    def _write(self, df: DataFrame, folder: str) -> None:
        w = df.write
        (w.partitionBy(*self.by) if self.by else w).parquet(f"{self.root}/{folder}")

    def _record(self, folders: list[dict], schema) -> dict:
        return {"folders": folders, "schema": schema.jsonValue(), "partition_by": self.by}

    def _texts(self, df: DataFrame) -> list[list[str | None]]:
        """The partitions that ``df`` has rows of, as text (as many as folders are written)."""
        rows = df.select(*[F.col(c).cast("string") for c in self.by]).distinct().collect()
        return sorted((list(r) for r in rows), key=repr)

    def _of(self, partitions: list[list[str | None]]):
        same = [reduce(lambda a, b: a & b, [F.col(c).cast("string").eqNullSafe(F.lit(v)) for c, v in zip(self.by, values)])
                for values in partitions]
        return reduce(lambda a, b: a | b, same)

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version (the current one)."""
        from pyspark.sql.types import StructType

        numbers = self.numbers()
        if not numbers:
            raise FileNotFoundError(f"{self.root} has no version")
        record = self.record(numbers[-1] if version is None else version)
        schema = StructType.fromJson(record["schema"])
        frames = []
        for f in record["folders"]:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{f['folder']}").select(*schema.names)
            if f["partitions"] is not None:
                df = df.where(self._of(f["partitions"]))
            frames.append(df)
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionAll(b), frames)

    def overwrite(self, df: DataFrame) -> int:
        """Replace the table; returns the version's number."""
        number, folder = self.next_folder()
        self._write(df, folder)
        listed = None
        if self.by:
            listed = self._texts(self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}"))
        folders = [] if listed == [] else [{"folder": folder, "partitions": listed}]
        self.commit(number, self._record(folders, df.schema))
        return number

    def append(self, df: DataFrame, keys: list[str]) -> int:
        """Rows with a new key are added, rows with a known key replace it; loading ``df`` twice changes nothing.

        Of rows of ``df`` that share a key, one stays. A partition that loses its last row is gone.
        """
        numbers = self.numbers()
        if not numbers:
            return self.overwrite(df.dropDuplicates(keys))
        number, folder = self.next_folder()
        staged = f"{folder}-in"
        df.dropDuplicates(keys).write.parquet(f"{self.root}/{staged}")
        old = self.read(numbers[-1])
        new = self.spark.read.schema(df.schema).parquet(f"{self.root}/{staged}").select(
            *[F.col(f.name).cast(f.dataType) for f in old.schema.fields])
        left = old.join(new.select(*keys), keys, "left_anti").select(*old.columns)
        record = self.record(numbers[-1])
        if not self.by:
            self._write(left.unionAll(new), folder)
            folders = [{"folder": folder, "partitions": None}]
        else:
            replaced = old.join(new.select(*keys), keys, "left_semi")
            touched = self._texts(new.select(*self.by).unionAll(replaced.select(*self.by)))
            if touched:
                left = left.where(self._of(touched))
            self._write(left.unionAll(new) if touched else new, folder)
            written = self._texts(self.spark.read.schema(old.schema).parquet(f"{self.root}/{folder}"))
            folders = []
            for f in record["folders"]:
                rest = [p for p in f["partitions"] if p not in touched]
                if rest:
                    folders.append({"folder": f["folder"], "partitions": rest})
            if written:
                folders.append({"folder": folder, "partitions": written})
        self.commit(number, self._record(folders, old.schema))
        self._fs().delete(self._path(staged), True)
        return number
