"""Incremental Silver, and the streaming jobs, against full builds of the same Bronze."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.incremental import incremental_build
from strata.plans.base import r2, register
from strata.plans.inputs import fx_series, index_series, orders_daily, t
from strata.plans.survey import livestock_gold, livestock_silver, survey_gold, survey_silver
from strata.plans.trade import comtrade_silver
from strata.plans.twins_crops import CROP_BOUNDS, LIVESTOCK_COLS, livestock_bronze
from strata.plans.twins_pipelines import (
    COMTRADE_SILVER_COLS, COMTRADE_UNITS, DELIVERY_1, DELIVERY_2, SURVEY_GOLD_COLS, SURVEY_MONEY_COLS, comtrade_bronze, survey_bronze)
from strata.sources import seeds
from strata.sources.bronze import append_bronze, read_bronze
from strata.sources.published import Published
from strata.streaming import jobs

TS = "ingestion_timestamp"


def loaded(spark: SparkSession, name: str, year: str, loads: Sequence[Sequence[DataFrame]],
           build: Callable[..., DataFrame]) -> Published:
    """Append each load (one frame a Bronze table) to Bronze, and build Silver after each."""
    target = Published(spark, jobs.shared_path(spark, f"silver_{name}"), ["reference_year"])
    paths = [jobs.shared_path(spark, f"bronze_{name}{i}") for i in range(len(loads[0]))]
    for number, load in enumerate(loads):
        for frame, path in zip(load, paths, strict=True):
            append_bronze(frame, path, year)
        bronze = [read_bronze(spark, path, frame.schema) for frame, path in zip(load, paths, strict=True)]
        incremental_build(target, bronze, year, TS, build, f"load{number}")
    return target


def deliveries(df: DataFrame) -> list[list[DataFrame]]:
    return [[df.filter(F.col(TS) == F.lit(ts).cast("timestamp_ntz"))] for ts in (DELIVERY_1, DELIVERY_2)]


def _seed_args(spark: SparkSession) -> list[DataFrame]:
    return [seeds.currency_factors(spark), seeds.unit_families(spark), seeds.product_unit_factors(spark)]


@register
def survey_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Survey Silver loaded delivery by delivery; Gold over it equals the full build."""
    build = lambda b: survey_silver(b, "prod_codigo", "prod", *_seed_args(spark), "pevs")
    silver = loaded(spark, "survey", "ano", deliveries(survey_bronze(spark, sf)), build).read()
    daily = orders_daily(spark, sf)
    gold = survey_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), **CROP_BOUNDS)
    return gold.select(*SURVEY_GOLD_COLS, *[r2(c).alias(c) for c in SURVEY_MONEY_COLS])


@register
def livestock_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The affected years of two Bronze tables together; herds of 1997
    and animal products of 1996 come first in an early form, then as they are."""
    herd, animal = livestock_bronze(spark, sf)
    early, late = (F.lit(x).cast("timestamp_ntz") for x in ("2023-12-01 00:00:00", DELIVERY_2))

    def split(df: DataFrame, year: str) -> tuple[DataFrame, DataFrame]:
        again = F.col("ano") == year
        first = df.withColumn("valor", F.when(again, F.lit("1")).otherwise(F.col("valor"))).withColumn(TS, F.when(again, early).otherwise(F.col(TS)))
        return first, df.filter(again).withColumn(TS, late)

    (h1, h2), (a1, a2) = split(herd, "1997"), split(animal, "1996")
    build = lambda h, a: livestock_silver(h, a, "prod_codigo", "prod", *_seed_args(spark))
    silver = loaded(spark, "livestock", "ano", [[h1, a1], [h2, a2]], build).read()
    daily = orders_daily(spark, sf)
    gold = livestock_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), **CROP_BOUNDS)
    return gold.select(*LIVESTOCK_COLS[:-4], *[r2(c).alias(c) for c in LIVESTOCK_COLS[-4:-1]], LIVESTOCK_COLS[-1])


def _comtrade_silver(spark: SparkSession, bronze: DataFrame) -> DataFrame:
    units = seeds.seed_frame(spark, COMTRADE_UNITS, "qty_unit_code string, unit_name string, unit_symbol string, unit_raw string")
    succ = seeds.seed_frame(spark, [("000001", "000010", "merged")], seeds.SUCCESSION_SCHEMA)
    return comtrade_silver(bronze, units, seeds.unit_families(spark), succ)


@register
def comtrade_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Bilateral Silver loaded delivery by delivery; a restated
    reporter-year rebuilds its whole year, every reporter of it."""
    target = loaded(spark, "comtrade", "refYear", deliveries(comtrade_bronze(spark, sf)), lambda b: _comtrade_silver(spark, b))
    return target.read().select(*COMTRADE_SILVER_COLS)


# --- streams -----------------------------------------------------------------


def landed(df: DataFrame, name: str, by: str, again: DataFrame | None = None) -> str:
    """Files in landing order: one folder a value of ``by``, then repeated deliveries."""
    path = jobs.shared_path(df.sparkSession, f"landing_{name}")
    df.repartition(by).withColumn("_by", F.col(by)).write.partitionBy("_by").parquet(f"{path}/a")
    if again is not None:
        again.coalesce(1).write.parquet(f"{path}/b")
    return path


def stream(spark: SparkSession, path: str, df: DataFrame, files: int) -> DataFrame:
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


@register
def stream_affected_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Bilateral Bronze landed file by file; each micro-batch appends to
    Bronze and rebuilds the years it touches; the end equals the full build."""
    rows = comtrade_bronze(spark, sf)
    bronze, target = jobs.shared_path(spark, "bronze_streamed"), jobs.shared_path(spark, "silver_streamed")
    first, second = (d[0] for d in deliveries(rows))
    path = landed(first, "comtrade", "refYear", second)
    build = lambda s, years: _comtrade_silver(s, read_bronze(s, bronze, rows.schema).join(F.broadcast(years), "refYear", "left_semi"))
    refresh = jobs.affected_partition_refresher(target, "refYear", build, "reference_year")

    def step(batch: DataFrame, batch_id: int) -> None:
        jobs.landed_once(batch, bronze, "refYear", batch_id)
        refresh(batch, batch_id)

    jobs.run_available(stream(spark, path, rows, 3), step, jobs.shared_path(spark, "ckpt_affected"))
    return Published(spark, target, ["reference_year"]).read().select(*COMTRADE_SILVER_COLS)


@register
def stream_batch_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """A day's batch of a scope replaces an older one, also if days come out of order."""
    e = t(spark, sf, "events").withColumn("batch_date", F.to_date("ts"))
    shuffled = e.withColumn("_order", F.pmod(F.xxhash64("batch_date"), F.lit(7)))
    path = landed(shuffled, "batches", "_order", shuffled.filter(F.dayofmonth("batch_date") <= 3))
    target = jobs.shared_path(spark, "batches")
    jobs.run_available(stream(spark, path, e, 2), jobs.batch_replacement(target, ["event_type"], "batch_date"), jobs.shared_path(spark, "ckpt_batches"))
    return Published(spark, target, ["event_type"]).read().select(*e.columns).distinct()


@register
def stream_scd2(spark: SparkSession, sf: str) -> DataFrame:
    """Versions maintained edit by edit, from days in shuffled order (late
    edits split intervals) and repeated deliveries, equal the timeline of the log."""
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    shuffled = e.withColumn("_order", F.pmod(F.xxhash64(F.to_date("ts")), F.lit(5)))
    path = landed(shuffled, "edits", "_order", shuffled.filter(F.dayofmonth("ts") <= 3))
    state = jobs.shared_path(spark, "versions")
    jobs.run_available(stream(spark, path, e, 2), jobs.scd2_maintainer(state, ["user_id"], "ts", "event_id", buckets=8), jobs.shared_path(spark, "ckpt_versions"))
    return jobs.scd2_read(spark, state, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "version", "valid_from", "valid_to", "is_current")


@register
def stream_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event time and rows per type and day, those behind the
    watermark counted from where they are kept; together all events."""
    e = t(spark, sf, "events").select("event_id", "event_type", "ts")
    shuffled = e.withColumn("_order", F.pmod(F.xxhash64(F.to_date("ts")), F.lit(5)))
    path = landed(shuffled, "fresh", "_order")
    state, late = jobs.shared_path(spark, "fresh"), jobs.shared_path(spark, "late")
    jobs.run_available(stream(spark, path, e, 1), jobs.freshness_monitor(state, late, "ts", "event_type", "2 days"), jobs.shared_path(spark, "ckpt_fresh"))
    behind = Published(spark, late, ["batch"]).read().groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n_rows"))
    both = Published(spark, state, ["day"]).read().unionByName(behind)
    return both.groupBy("day", "event_type").agg(F.max("newest").alias("newest"), F.sum("n_rows").alias("n_rows"))
