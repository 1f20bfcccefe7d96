"""Gold snapshots (survey A30): data, then a manifest with counts and fingerprints, then the marker.

    <root>/run=<id>/<table>/        data
    <root>/run=<id>/_manifest/      one row a table: dataset, rows, fingerprint
    <root>/run=<id>/_complete/      written last

A run without its marker is partial, and a reader refuses it; so it does a run of
another dataset (two environments hold tables of the same names), and a table
whose rows are no longer those that were counted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.sources.published import children

MANIFEST = "run_id string, dataset string, table string, rows long, fingerprint string, completed_at timestamp"


class PartialSnapshot(ValueError):
    """A snapshot that must not be read or relied on."""


def fingerprint(df: DataFrame) -> dict[str, Column]:
    """Rows, and an order-free fingerprint of whole rows that repeated rows also change."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return {"rows": F.count(F.lit(1)), "xor": F.coalesce(F.bit_xor(h), F.lit(0)), "sum": F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")}


def _text(seen: Mapping) -> str:
    return f"{seen['xor']}:{seen['sum']}"


def run_path(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/run={run_id}"


def snapshot(tables: Mapping[str, DataFrame], root: str, run_id: str, dataset: str, now: dt.datetime | None = None) -> DataFrame:
    """Write every table, the manifest of what was written, and the marker last."""
    if not tables:
        raise ValueError("no tables to snapshot")
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        seen = Observation()
        df.observe(seen, *[c.alias(k) for k, c in fingerprint(df).items()]).write.mode("overwrite").parquet(f"{run_path(root, run_id)}/{name}")
        rows.append((run_id, dataset, name, seen.get["rows"], _text(seen.get), now or dt.datetime.now()))
    m = spark.createDataFrame(rows, MANIFEST)
    m.coalesce(1).write.mode("overwrite").parquet(f"{run_path(root, run_id)}/_manifest")
    m.select("run_id", "dataset", "completed_at").distinct().coalesce(1).write.mode("overwrite").parquet(f"{run_path(root, run_id)}/_complete")
    return m


def complete_runs(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    """(run_id, dataset, completed_at) of the runs with a marker, of one dataset if named."""
    done = [p.removesuffix("/_SUCCESS") for p in children(spark, f"{root.rstrip('/')}/run=*/_complete/_SUCCESS")]
    schema = "run_id string, dataset string, completed_at timestamp"
    runs = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return runs if dataset is None else runs.filter(F.col("dataset") == dataset)


def read_snapshot(spark: SparkSession, root: str, run_id: str, dataset: str, table: str) -> DataFrame:
    """A table of a complete run of this dataset whose rows are still those of its manifest."""
    if complete_runs(spark, root, dataset).filter(F.col("run_id") == run_id).isEmpty():
        raise PartialSnapshot(f"run {run_id} is partial or not of {dataset}")
    entry = spark.read.schema(MANIFEST).parquet(f"{run_path(root, run_id)}/_manifest").filter(F.col("table") == table).first()
    if entry is None:
        raise PartialSnapshot(f"run {run_id} has no {table}")
    df = spark.read.parquet(f"{run_path(root, run_id)}/{table}")
    seen = df.agg(*[c.alias(k) for k, c in fingerprint(df).items()]).first()
    if (seen["rows"], _text(seen)) != (entry["rows"], entry["fingerprint"]):
        raise PartialSnapshot(f"{table} of run {run_id} is not what was written")
    return df


def backup_status(spark: SparkSession, root: str, dataset: str, now: dt.datetime, staleness_days: int) -> tuple[bool, str]:
    """Whether a complete snapshot of this dataset is recent enough to go back to."""
    if not children(spark, f"{root.rstrip('/')}/run=*"):
        return False, "no snapshot"
    newest = complete_runs(spark, root, dataset).agg(F.max("completed_at")).first()[0]
    if newest is None:
        return False, "no complete snapshot of this dataset"
    age = (now - newest).total_seconds() / 86400
    if age > staleness_days:
        return False, f"newest snapshot is {age:.0f} days old (more than {staleness_days})"
    return True, f"complete snapshot of {dataset} at {newest:%Y-%m-%d %H:%M}"
