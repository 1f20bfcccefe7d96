"""Driver-table twins of the reference's jobs.

Each function is ``(spark, sf_dir) -> DataFrame`` over whole tables and is
composed from the library operators; the matching DuckDB SQL lives in
``strata.plans.oracle``.  Output doubles are rounded to fixed decimals so a
value hash does not depend on float summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.deflate import (
    VALUE_MATRIX,
    deflate,
    fx_latest,
    fx_year_average,
    latest_index,
    year_end_index,
)
from strata.plans.base import r2, register
from strata.plans.inputs import fx_series, index_series, orders_daily, revenue_cents, t


def nation_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Nation is a fixed 25-row dimension, so broadcasting it is bounded."""
    return F.broadcast(t(spark, sf, "nation"))


@register
def deflated_revenue_by_nation_year(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: revenue per customer nation and ship year with the full
    value matrix (year FX in two currencies, three deflators x three
    currencies).  C05 + D04-D07 + E03 + V4/V5.

    Lines are pre-aggregated to (order, year) before the order join, so the
    largest shuffle carries one row per order-year instead of one per line.
    """
    daily = orders_daily(spark, sf)
    idx = index_series(spark, sf, daily)
    fx = fx_series(spark, sf, daily)
    per_order = (
        t(spark, sf, "lineitem")
        .groupBy("l_orderkey", F.year("l_shipdate").alias("reference_year"))
        .agg(F.sum(revenue_cents()).alias("cents"))
    )
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    fact = (
        per_order.join(orders, "l_orderkey")
        .join(cust, "o_custkey")
        .groupBy("c_nationkey", "reference_year")
        .agg((F.sum("cents") / F.lit(100.0)).alias("val_raw"))
    )
    out = deflate(fact, "val_raw", year_end_index(idx), latest_index(idx), fx_year_average(fx), fx_latest(fx))
    nation = nation_dim(spark, sf).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return out.join(nation, "c_nationkey").select(
        "nation", "reference_year", *[r2(c).alias(c) for c in VALUE_MATRIX]
    )
