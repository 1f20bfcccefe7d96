"""Partitioned tables whose readers see whole commits only.

A commit writes the partitions it changes into a folder of its own, then one
small table that says which folder holds each partition (unchanged ones keep
their older folder).  That table's success marker is the pointer: until it is
there, readers go by the commit before.  Nothing a reader uses is overwritten,
and a partition that no commit touches is never rewritten.

A commit has a label (a load's id, or a stream's run and batch id).  Publishing
a label again changes nothing, so a batch replayed after any failure ends in
the same table.

    <path>/data/commit_no=<n>/<partition folders>
    <path>/commits/<n>.<label>    folder, commit_no, schema, totals

What the driver sees is one row a partition, never rows of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

COMMIT = "commit_no"
POINTER = "folder string, commit_no long, schema string, totals string"


def children(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths of what matches a file pattern in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found or [])


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@dataclass(frozen=True)
class Commit:
    """The table as of one commit: each partition's folder with the commit that wrote it."""

    number: int
    label: str
    folders: Mapping[str, int]
    schema: StructType
    totals: Mapping[str, float]


class Published:
    """A table partitioned by ``parts``; read() gives the newest whole commit."""

    def __init__(self, spark: SparkSession, path: str, parts: Sequence[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), list(parts)

    def _commits(self) -> list[tuple[int, str, str]]:
        found = [p.rsplit("/", 1)[0] for p in children(self.spark, f"{self.path}/commits/*/_SUCCESS")]
        return sorted((int(name.split(".", 1)[0]), name.split(".", 1)[1], p) for p in found for name in [p.rsplit("/", 1)[1]])

    def commit(self) -> Commit | None:
        """The newest commit, or None for a table never published."""
        if not (done := self._commits()):
            return None
        number, label, path = done[-1]
        rows = self.spark.read.schema(POINTER).parquet(path).collect()
        return Commit(number, label, {r.folder: r.commit_no for r in rows if r.folder is not None},
                      StructType.fromJson(json.loads(rows[0].schema)), json.loads(rows[0].totals or "{}"))

    def read(self) -> DataFrame | None:
        return None if (c := self.commit()) is None else self._frame(c)

    def _frame(self, c: Commit) -> DataFrame:
        if not c.folders:
            return self.spark.createDataFrame([], c.schema)
        full = StructType([*c.schema.fields]).add(COMMIT, LongType())
        paths = [f"{self.path}/data/{COMMIT}={n}/{folder}" for folder, n in sorted(c.folders.items())]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).select(*c.schema.names)

    def publish(self, build: Callable[[], DataFrame], label: str, totals: Mapping[str, Column] | None = None,
                whole: bool = False) -> list[str]:
        """Replace the partitions present in ``build()`` (with ``whole``: all), which may read this table.

        ``totals`` are aggregates observed while the data is written; they stand
        in the commit.  Returns the folders written ([] for a known label)."""
        done = self._commits()
        if any(label == known for _, known, _ in done):
            return []
        before = self.commit()
        number = before.number + 1 if before else 1
        df = build()
        folder = f"{self.path}/data/{COMMIT}={number}"
        seen = self._write_data(df, folder, totals)
        depth = "/".join(["*=*"] * len(self.parts))
        written = [p.split(f"/{COMMIT}={number}/", 1)[1] for p in children(self.spark, f"{folder}/{depth}")]
        folders = ({} if whole or not before else dict(before.folders)) | dict.fromkeys(written, number)
        self._write_pointer(folders, df.schema.json(), json.dumps(seen), f"{self.path}/commits/{number:08d}.{label}")
        return written

    def _write_data(self, df: DataFrame, folder: str, totals: Mapping[str, Column] | None) -> dict:
        observed = Observation() if totals else None
        if observed:
            df = df.observe(observed, *[c.alias(name) for name, c in totals.items()])
        df.write.mode("overwrite").partitionBy(*self.parts).parquet(folder)
        return dict(observed.get) if observed else {}

    def _write_pointer(self, folders: Mapping[str, int], schema: str, totals: str, path: str) -> None:
        rows = [(f, n, schema, totals) for f, n in sorted(folders.items())] or [(None, None, schema, totals)]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("overwrite").parquet(path)

    def expire(self, keep: int = 2) -> None:
        """Drop folders that none of the newest ``keep`` commits uses (readers of older ones are given up)."""
        done = self._commits()
        used = set()
        for number, _, path in done[-keep:]:
            used |= {(r.folder, r.commit_no) for r in self.spark.read.schema(POINTER).parquet(path).collect()}
        newest = done[-1][0] if done else 0
        depth = "/".join(["*=*"] * len(self.parts))
        for p in children(self.spark, f"{self.path}/data/{COMMIT}=*/{depth}"):
            number, folder = p.split(f"/{COMMIT}=", 1)[1].split("/", 1)
            if (folder, int(number)) not in used and int(number) <= newest:
                remove(self.spark, p)
