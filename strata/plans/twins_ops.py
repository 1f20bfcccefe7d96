"""Twins of the data-quality suites (L*), reconciliation (A31), incremental
refresh (A28/M02) and streaming state (M01/M03/M04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import checks as CK
from strata.operators.dedup import latest_wins
from strata.operators.incremental import incremental_build
from strata.operators.reconcile import reconcile_cells as _cells
from strata.operators.reconcile import reconcile_summary
from strata.plans.base import r2, register
from strata.plans.inputs import LINE_KEY, t, trade_lines
from strata.sources.bronze import append_bronze, read_bronze
from strata.sources.published import Published
from strata.streaming.jobs import latest_state_aggregate, latest_state_merger, read_state, shared_path


def _mart(lines: DataFrame) -> DataFrame:
    return lines.groupBy("flow", "year", "product", "reporter").agg(
        F.sum("value_cents").alias("value_cents"), F.sum("qty").alias("qty"))


@register
def grain_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Grain uniqueness, not-null, accepted values and relationships."""
    li = t(spark, sf, "lineitem")
    o = t(spark, sf, "orders")
    mart = _mart(trade_lines(spark, sf, product=True, reporter=True))
    return CK.run_suite({
        "mart_grain_unique": (CK.unique_combination(mart, ["flow", "year", "product", "reporter"]), CK.ERROR),
        "lineitem_order_unique": (CK.unique_combination(li, ["l_orderkey"]), CK.WARN),
        "orders_not_null": (CK.not_null(o, o.columns), CK.ERROR),
        "flow_accepted": (CK.accepted_values(li, "l_returnflag", ["A", "N", "R"]), CK.ERROR),
        "priority_accepted": (CK.accepted_values(o, "o_orderpriority", ["1-URGENT", "2-HIGH"]), CK.WARN),
        "supplier_exists": (CK.relationships(li, "l_suppkey", t(spark, sf, "supplier"), "s_suppkey"), CK.ERROR),
    })


@register
def bounded_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Values within documented bounds."""
    o = t(spark, sf, "orders")
    li = t(spark, sf, "lineitem")
    return CK.run_suite({
        "implied_rate_bounded": (CK.bounded(o, F.col("o_totalprice") / 1000.0, 1.0, 400.0), CK.ERROR),
        "discount_bounded": (CK.bounded(li, F.col("l_discount"), 0.0, 0.08), CK.WARN),
        "unit_price_bounded": (CK.bounded(li, F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), 900.0, 2000.0), CK.WARN),
    })


def _seasonality(lines: DataFrame) -> DataFrame:
    return lines.groupBy("flow", "year", "month").agg(
        F.sum("value_cents").alias("cents"), F.sum("qty").alias("weight"), F.count(F.lit(1)).alias("source_rows"),
        F.max("ingestion_timestamp").alias("last_refresh"))


@register
def incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """An initial load (years <= 1998, 1998 later restated) plus an
    affected-year incremental refresh equals the full seasonality mart.

    Bronze keeps both deliveries; Silver is latest-wins per line; only the
    years with rows at or after the target's newest ingestion are rebuilt."""
    base = trade_lines(spark, sf)
    ts0, ts1, ts2 = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-01-15", "2024-02-01"))
    v1 = base.filter(F.col("year") <= 1998).withColumn(
        "qty", F.when(F.col("year") == 1998, F.col("qty") * 2).otherwise(F.col("qty"))).withColumn(
        "ingestion_timestamp", F.when(F.col("year") == 1998, ts1).otherwise(ts0))
    v2 = base.filter(F.col("year") >= 1998).withColumn("ingestion_timestamp", ts2)
    keys, order = LINE_KEY, ["ingestion_timestamp"]
    bronze = shared_path(spark, "bronze_lines")
    target = Published(spark, shared_path(spark, "mart_seasonality"), ["year"])
    build = lambda rows: _seasonality(latest_wins(rows, keys, order))
    for number, delivery in enumerate([v1, v2]):
        append_bronze(delivery, bronze, "year")
        incremental_build(target, [read_bronze(spark, bronze, delivery.schema)], "year", "ingestion_timestamp", build, f"load{number}", "last_refresh")
    out = target.read()
    return out.select("flow", F.col("year").cast("int").alias("year"), "month",
                      r2(F.col("cents") / 100.0).alias("value"), "weight", "source_rows")


@register
def stream_latest_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Events landed as daily files, streamed in several
    micro-batches (with duplicate deliveries) through a stateful newest-row
    aggregation, merged into a bucketed current-state table; the result
    equals batch latest-wins per user."""
    events = t(spark, sf, "events")
    landing = shared_path(spark, "landing_events")
    # Land the log as one folder of files per day, then re-deliver the first
    # days again (at-least-once delivery must not change the state).
    dated = events.withColumn("_day", F.to_date("ts"))
    dated.repartition("_day").write.partitionBy("_day").parquet(landing + "/a")
    dated.filter(F.dayofmonth("_day") <= 3).write.partitionBy("_day").parquet(landing + "/b")
    schema = events.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
              .option("recursiveFileLookup", "true").parquet(landing))
    # State store keeps the newest row per user (max_by (ts, event_id));
    # each micro-batch emits only the users it changed, merged into the
    # bucketed state table.  Re-delivered files change nothing.
    newest = latest_state_aggregate(stream, ["user_id"], ["ts", "event_id"])
    state = shared_path(spark, "user_state")
    q = (newest.writeStream.outputMode("update")
         .foreachBatch(latest_state_merger(state, ["user_id"], ["ts", "event_id"], id_col="event_id", buckets=16))
         .option("checkpointLocation", shared_path(spark, "ckpt_user_state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_state(spark, state).select(*schema.fieldNames())
