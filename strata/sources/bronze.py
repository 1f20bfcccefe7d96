"""Bronze loading (survey A14, A15, A25, A37, A40, A41, A42).

Bronze is append-only: every source column is a string and only
``ingestion_timestamp`` is typed.  One timestamp is shared by the whole
batch (a literal, not a per-row ``now()``), and the table is partitioned by
ingestion date so a batch lands in one partition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType


def to_bronze(df: DataFrame, batch_ts: dt.datetime) -> DataFrame:
    """All columns as strings plus the batch's single ingestion time."""
    cols = [F.col(c).cast("string").alias(c) for c in df.columns if c != "ingestion_timestamp"]
    return df.select(*cols, F.lit(batch_ts).cast("timestamp").alias("ingestion_timestamp"))


def append_bronze(df: DataFrame, path: str, period: str | None = None) -> None:
    """Append, partitioned by ingestion date, and within it by ``period``
    (the source's year) where loads are incremental: one bounds the search for
    new rows, the other the rebuild of the periods they belong to."""
    days = df.withColumn("ingestion_date", F.to_date("ingestion_timestamp"))
    parts = ["ingestion_date", *([period] if period else [])]
    # a folder's rows come from few tasks: one, or as many as its measured size needs
    days = days.hint("rebalance", *[F.col(p) for p in parts]) if period else days
    days.write.mode("append").partitionBy(*parts).parquet(path)


def read_bronze(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Appended Bronze under its own types: a year or code stays a string, though it names a folder."""
    full = StructType([*schema.fields, StructField("ingestion_date", DateType())])
    return spark.read.schema(full).parquet(path)


def run_batches(batches: Iterable[str], job: Callable[[str], None], transient: tuple[type, ...] = (IOError,)) -> list[tuple[str, str, str]]:
    """Run each batch as its own Spark job; a failing batch does not
    stop the others.  Returns (batch, outcome, message) rows for an outcome
    table: ``ok``, ``transient`` (retry later) or ``failed``."""
    out = []
    for b in batches:
        try:
            job(b)
            out.append((b, "ok", ""))
        except transient as e:  # noqa: PERF203
            out.append((b, "transient", str(e)))
        except Exception as e:  # noqa: BLE001
            out.append((b, "failed", str(e)))
    return out


def multi_table(specs: Sequence[tuple[str, DataFrame]], tag_col: str = "table_id") -> DataFrame:
    """Per-table frames unioned by name with a literal tag."""
    out = None
    for tag, df in specs:
        d = df.withColumn(tag_col, F.lit(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def calendar_spine(spark: SparkSession, start: str = "1970-01-01", end: str = "2050-12-01") -> DataFrame:
    """One row per month with calendar attributes."""
    from strata.functions.columns import month_abbr_pt, month_name_pt

    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                                                   F.expr("interval 1 month"))).alias("date_month"))
    m = F.month("date_month")
    return d.select(
        "date_month",
        F.year("date_month").alias("reference_year"),
        m.alias("reference_month"),
        F.quarter("date_month").alias("quarter"),
        F.when(m <= 6, 1).otherwise(2).alias("semester"),
        F.last_day("date_month").alias("month_end_date"),
        F.date_format("date_month", "yyyy-MM").alias("year_month"),
        (m == 12).alias("is_year_end"),
        month_name_pt(m).alias("month_name_pt"),
        month_abbr_pt(m).alias("month_abbr_pt"),
    )


def states_dimension(spark: SparkSession) -> DataFrame:
    """The federative units as a literal dimension."""
    from strata.functions.columns import STATES, region_abbrev, region_code

    from strata.sources.seeds import seed_frame

    d = seed_frame(spark, STATES, "state_acronym string, state_name string, region string")
    return d.withColumn("region_abbrev", region_abbrev("region")).withColumn("ibge_region_code", region_code("region"))


def schema_listing(df: DataFrame) -> DataFrame:
    """(column, type) rows of a table's schema."""
    spark = df.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
                                 "column string, type string, nullable boolean")
