"""Adapters that derive the reference's inputs from the driver tables.

Role mapping (SURVEY 7.4): lineitem joined to orders, customer, supplier,
part and nation plays the trade fact; ``events`` plays the append-only edit
log; monthly ``orders`` play the price-index and FX series.

Money is carried as integer-valued cents (``round(x * 100)``) so sums are
exact whatever the partitioning, and averaged series use integer-valued
inputs for the same reason.  Every function returns a lazy DataFrame over
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.series import chain_index, pct_change
from strata.session import read_table

# Role values for the driver tables (fixed for the twin queries).
DEFLATOR_OF_STATUS = {"F": "433", "O": "189", "P": "190"}  # o_orderstatus -> index series
CURRENCY_OF_PRIORITY = {"1-URGENT": "USD", "2-HIGH": "EUR"}  # o_orderpriority -> currency
DAILY_PARTITIONS = 4  # of a summary with at most statuses x priorities x days rows


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def revenue_cents() -> F.Column:
    return F.round(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * F.lit(100.0))


def _map(col: str, mapping: dict[str, str]) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over orders reduced to (status, priority, day) aggregates.

    Both the index and the FX series derive from this summary, so the large
    orders table is scanned once.  The summary is bounded by
    statuses x priorities x days (not by the number of orders), so it is
    cached, in a few partitions: the consumers in the plan share one
    computation, each in a few tasks, and a lost cached partition is
    recomputed deterministically from the scan.
    """
    o = t(spark, sf, "orders")
    daily = o.groupBy(
        "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day")
    ).agg(
        F.sum(F.floor("o_totalprice")).alias("price_sum"),
        F.count(F.lit(1)).alias("n_orders"),
        F.max(F.floor(F.col("o_totalprice") / F.lit(1000.0))).alias("rate_max"),
    )
    return daily.repartition(DAILY_PARTITIONS).persist()


def index_series(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """Silver index: (series_code, reference_date, reference_year,
    reference_month, monthly_pct_change, index_value).

    The monthly change is the change of the mean (floored) order price of
    the status; the index chains those changes from 100.
    """
    d = daily if daily is not None else orders_daily(spark, sf)
    monthly = (
        d.select(
            _map("o_orderstatus", DEFLATOR_OF_STATUS).alias("series_code"),
            F.trunc("day", "month").alias("reference_date"),
            "price_sum",
            "n_orders",
        )
        .groupBy("series_code", "reference_date")
        .agg((F.sum("price_sum") / F.sum("n_orders")).alias("mean_price"))
    )
    pct = pct_change(monthly, ["series_code"], "reference_date", "mean_price", "monthly_pct_change")
    idx = chain_index(pct, ["series_code"], "reference_date", "monthly_pct_change")
    return idx.select(
        "series_code",
        "reference_date",
        F.year("reference_date").alias("reference_year"),
        F.month("reference_date").alias("reference_month"),
        "monthly_pct_change",
        "index_value",
    )


def fx_series(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """Silver FX: (currency, reference_date, reference_year,
    reference_month, brl_per_foreign_unit), one fixing per currency and day."""
    d = daily if daily is not None else orders_daily(spark, sf)
    cur = _map("o_orderpriority", CURRENCY_OF_PRIORITY)
    return (
        d.filter(cur.isNotNull())
        .select(cur.alias("currency"), F.col("day").alias("reference_date"), F.col("rate_max").cast("double").alias("rate"))
        .groupBy("currency", "reference_date")
        .agg(F.max("rate").alias("brl_per_foreign_unit"))
        .withColumn("reference_year", F.year("reference_date"))
        .withColumn("reference_month", F.month("reference_date"))
    )


# The natural key of a line (the driver's lineitem has repeated
# (orderkey, linenumber) pairs; these attributes together are unique).
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "tax",
            "flow", "unit", "l_shipdate"]


def trade_lines(
    spark: SparkSession,
    sf: str,
    partner: bool = False,
    reporter: bool = False,
    product: bool = False,
    product_type: bool = False,
) -> DataFrame:
    """Trade fact lines: flow, unit, qty, value (cents), year, month and the
    requested dimensions.  Only the joins a query needs are planned."""
    li = t(spark, sf, "lineitem").select(
        F.col("l_orderkey"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_linenumber"),
        F.col("l_returnflag").alias("flow"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_quantity").alias("qty"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice"),
        F.col("l_discount"),
        F.col("l_shipdate"),
        revenue_cents().alias("value_cents"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
    )
    if partner:
        o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("partner"))
        li = li.join(o, "l_orderkey").join(c, "o_custkey").drop("o_custkey")
    if reporter:
        s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("reporter"))
        li = li.join(s, "l_suppkey")
    if product or product_type:
        cols = [F.col("p_partkey").alias("l_partkey")]
        if product:
            cols.append(F.col("p_brand").alias("product"))
        if product_type:
            cols.append(F.col("p_type").alias("level"))
        li = li.join(t(spark, sf, "part").select(*cols), "l_partkey")
    return li
