"""Raw archive and its manifest (survey A01-A05, A22-A24, A29, A38, A39).

An extract is archived verbatim as Parquet under
``<root>/source=<s>/dataset=<d>/batch_id=<b>/`` and described by one
manifest row (batch id, row count, fetch time, provenance map).  The
manifest is itself an append-only Parquet table, so every bookkeeping
question (pending batches, freshness, replay order) is a DataFrame query.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("rows", T.LongType(), False),
    T.StructField("fetched_at", T.TimestampType(), False),
    T.StructField("provenance", T.MapType(T.StringType(), T.StringType()), True),
])


def batch_path(root: str, source: str, dataset: str, batch_id: str | None = None) -> str:
    p = f"{root.rstrip('/')}/data/source={source}/dataset={dataset}"
    return p if batch_id is None else f"{p}/batch_id={batch_id}"


def manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}/manifest"


def archive_batch(
    df: DataFrame,
    root: str,
    source: str,
    dataset: str,
    batch_id: str,
    provenance: Mapping[str, str] | None = None,
    fetched_at: dt.datetime | None = None,
) -> DataFrame:
    """Write one verbatim batch and append its manifest row.

    The data is written first and the manifest row last, so a batch without
    a manifest row is an incomplete write and is never read as archived.
    An empty extract still gets a manifest row (``rows = 0``) so a settled
    empty scope is not fetched again.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(batch_path(root, source, dataset, batch_id))
    n = spark.read.parquet(batch_path(root, source, dataset, batch_id)).count()
    row = [(source, dataset, batch_id, n, fetched_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
            dict(provenance or {}))]
    spark.createDataFrame(row, MANIFEST_SCHEMA).write.mode("append").parquet(manifest_path(root))
    return spark.read.parquet(manifest_path(root)).filter(F.col("batch_id") == batch_id)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path(root))


def read_batch(spark: SparkSession, root: str, source: str, dataset: str, batch_id: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """One archived batch (or all of a dataset), with ``batch_id``
    from the folder name so the batch filter prunes partitions."""
    r = spark.read.option("basePath", f"{root.rstrip('/')}/data")
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(batch_path(root, source, dataset))
    return df if batch_id is None else df.filter(F.col("batch_id") == batch_id)


def list_batches(manifest: DataFrame, source: str, dataset: str) -> DataFrame:
    """Batches of a dataset in replay order (fetch time, then id)."""
    return (manifest.filter((F.col("source") == source) & (F.col("dataset") == dataset))
            .select("batch_id", "rows", "fetched_at").orderBy("fetched_at", "batch_id"))


def pending_batches(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Archived batches not yet loaded into Bronze."""
    return manifest.join(loaded.select("source", "dataset", "batch_id"), ["source", "dataset", "batch_id"], "left_anti")


def etag_current(manifest: DataFrame, remote: DataFrame) -> DataFrame:
    """An archived batch is current only if both ETags exist and are
    equal; a missing or weak validator never counts as current."""
    m = manifest.select("source", "dataset", "batch_id", F.col("provenance")["etag"].alias("archived_etag"))
    j = m.join(remote, ["source", "dataset", "batch_id"], "left")
    strong = lambda c: F.col(c).isNotNull() & ~F.col(c).startswith("W/")
    return j.withColumn("is_current", strong("archived_etag") & strong("remote_etag")
                        & (F.col("archived_etag") == F.col("remote_etag")))


def stable_batch_id(members: Sequence[str], prefix: str = "") -> str:
    """A batch id that depends only on its (sorted) members."""
    h = hashlib.sha1(",".join(sorted(str(m) for m in members)).encode()).hexdigest()[:10]
    return f"{prefix}{h}"


def member_chunks(members: DataFrame, member_col: str, size: int) -> DataFrame:
    """Sorted members cut into fixed-size batches with a stable id per
    batch (sha1 of its sorted member list).  The global position comes from
    the range-partitioned ordered scan, not a single-task window."""
    from strata.operators.ordered import ordered_columns

    m = members.select(F.col(member_col).cast("string").alias("member")).distinct().withColumn("_all", F.lit(0))
    m = ordered_columns(m, ["_all"], ["member"], row_number="_pos")
    m = m.withColumn("chunk", F.floor((F.col("_pos") - 1) / size).cast("int"))
    chunks = m.groupBy("chunk").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return chunks.select("chunk", F.size("members").alias("n_members"),
                         F.substring(F.sha1(F.array_join("members", ",")), 1, 10).alias("batch_hash"))


def chunk_plan(spark: SparkSession, year_from: int, year_to: int, members: DataFrame, member_col: str,
               size: int) -> DataFrame:
    """Year x fixed-size batches of sorted members."""
    years = spark.range(1).select(F.explode(F.sequence(F.lit(year_from), F.lit(year_to))).alias("year"))
    return years.crossJoin(member_chunks(members, member_col, size))


def expected_missing(expected: DataFrame, manifest: DataFrame, year_col: str, end_year: int) -> DataFrame:
    """Expected batches without a manifest row; the latest period is a
    skip (not yet published), an older one is an error."""
    miss = expected.join(manifest.select("batch_id"), "batch_id", "left_anti")
    return miss.withColumn("status", F.when(F.col(year_col) == end_year, "skip").otherwise("error"))


def source_freshness(df: DataFrame, ts: str, warn_after_hours: float, error_after_hours: float,
                     now: dt.datetime | None = None) -> DataFrame:
    """Age of the newest ingestion against warn / error thresholds."""
    now_lit = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = (F.unix_timestamp(now_lit) - F.unix_timestamp(F.max(ts))) / 3600.0
    out = df.agg(F.max(ts).alias("newest"), age.alias("age_hours"))
    return out.withColumn("status", F.when(F.col("age_hours") > error_after_hours, "error")
                          .when(F.col("age_hours") > warn_after_hours, "warn").otherwise("pass"))


def archive_partitioned(df: DataFrame, root: str, source: str, dataset: str, batch_col: str,
                        fetched_at: dt.datetime, provenance: Mapping[str, str] | None = None) -> DataFrame:
    """A01 at scale: archive many batches in one job (partitioned by batch)
    and append one manifest row per batch, counted from the written files."""
    spark = df.sparkSession
    data = df.withColumn("batch_id", F.col(batch_col).cast("string"))
    data.write.mode("overwrite").partitionBy("batch_id").parquet(batch_path(root, source, dataset))
    written = read_batch(spark, root, source, dataset)
    prov = F.create_map(*[x for k, v in (provenance or {}).items() for x in (F.lit(k), F.lit(v))]) if provenance \
        else F.lit(None).cast("map<string,string>")
    rows = written.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), F.col("batch_id").cast("string").alias("batch_id"),
        "rows", F.lit(fetched_at).cast("timestamp").alias("fetched_at"), prov.alias("provenance"))
    rows.write.mode("append").parquet(manifest_path(root))
    return read_manifest(spark, root)
