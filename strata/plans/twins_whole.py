"""Operators over whole tables, each also under the name of a former twin that read a slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import incremental as I
from strata.operators import scd
from strata.operators import reconcile as RC
from strata.plans import reads as R
from strata.plans.base import REGISTRY, r2, register
from strata.plans.inputs import t, trade_lines
from strata.plans.twins_dash import domain_suite, unit_price
from strata.plans.twins_logs import _log
from strata.plans.twins_more import named_totals
from strata.plans.twins_sources import _resolved


def whole(fn):
    """Registers a twin under its name, and without the ending."""
    REGISTRY[fn.__name__.removesuffix("_whole")] = fn
    return register(fn)


@whole
def catalog_without_data_whole(spark: SparkSession, sf: str) -> DataFrame:
    """C20: catalogued codes (current users) with no order in any year."""
    cur = scd.current_catalog(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select("user_id")
    return cur.join(t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", "left_anti")


@whole
def new_codes_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Configured codes (all parts) with no Bronze rows in any year."""
    conf = t(spark, sf, "part").select(F.col("p_partkey").alias("code"))
    return I.new_codes(conf, t(spark, sf, "lineitem").select(F.col("l_partkey").alias("code")), "code")


@whole
def comex_by_partner_latest_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Trade by partner nation at the latest year of the table."""
    li = R.apply(trade_lines(spark, sf, partner=True), R.in_list("flow", ["A", "N"]))
    fact = R.apply(trade_lines(spark, sf), R.in_list("flow", ["A", "N"]))
    return R.latest_year_only(li, "year", fact).groupBy("partner").agg(
        r2(F.sum("value_cents") / 100.0).alias("value"), F.sum("qty").alias("weight"))


@whole
def codes_present_catalog_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Exported codes with names from the catalogue of all parts."""
    return named_totals(spark, sf, t(spark, sf, "part"))


@register
def reconcile_cells_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Per-order quantities of all lines against a rendered source
    delivery of all lines, where every 7th order is one unit higher and every
    11th stands under another key."""
    live = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    source = live.select(
        F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("l_orderkey"),
        F.when(F.col("l_orderkey") % 7 == 0, F.col("qty") + 1).otherwise(F.col("qty")).alias("qty"))
    return RC.reconcile_summary(RC.reconcile_cells(live, source, ["l_orderkey"], "qty"))


@register
def reconcile_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A31, both comparisons: per-order quantities in the live table (returned lines
    excluded) against a source snapshot taken before 2001, and (``delivery_``) all
    lines against a rendered delivery of all lines."""
    li = t(spark, sf, "lineitem")
    live = li.filter(F.col("l_returnflag") != "R").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    source = li.filter(F.col("l_shipdate") < F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).groupBy(
        "l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    snapshot = RC.reconcile_summary(RC.reconcile_cells(live, source, ["l_orderkey"], "qty"))
    delivery = reconcile_cells_whole(spark, sf)
    # one row each
    return snapshot.crossJoin(F.broadcast(delivery.select(*[F.col(c).alias(f"delivery_{c}") for c in delivery.columns])))


@whole
def export_unit_price_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Export value over the weight of all units."""
    return unit_price(spark, sf, F.lit(True))


@whole
def resolved_scope_fallback_whole(spark: SparkSession, sf: str) -> DataFrame:
    """With every code paused, the configured list (all customers)."""
    return _resolved(spark, sf, F.lit("pausada"))


@whole
def domain_checks_whole(spark: SparkSession, sf: str) -> DataFrame:
    """L13/L15/L19/L22/L23; L22 against all customers."""
    return domain_suite(spark, sf, F.lit(True))
