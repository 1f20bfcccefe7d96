"""More read and join twins: H04-H06, H12, H14, H20, H21, H23, H26, C08,
C13, C14, C16, C20, D24, D25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import checks as CK
from strata.operators import scd
from strata.operators.gate import visibility_gate
from strata.operators.quality import exact_percentiles
from strata.plans import reads as R
from strata.plans.base import r2, r6, register
from strata.plans.inputs import t, trade_lines
from strata.plans.twins_logs import _log
from strata.sources.bronze import calendar_spine


def _order_cents() -> F.Column:
    return F.round(F.col("o_totalprice") * 100)


def _hidden_codes(spark: SparkSession, sf: str) -> DataFrame:
    return scd.hidden_registry(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(
        F.col("user_id").alias("code"))


@register
def municipio_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """City (customer) x state (nation) x year order value, hidden
    codes removed by the visibility anti-join."""
    o = t(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), _order_cents().alias("cents"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = F.broadcast(t(spark, sf, "nation")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    g = visibility_gate(o.join(c, "o_custkey").join(n, "c_nationkey"), _hidden_codes(spark, sf), "o_custkey")
    return g.groupBy(F.col("o_custkey").alias("city"), "state", "year").agg(r2(F.sum("cents") / 100.0).alias("value"))


@register
def geo_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """The full city -> state -> region hierarchy listing."""
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    h = F.broadcast(t(spark, sf, "nation")).join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(h, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("city_code"), F.col("c_name").alias("city_name"), F.col("n_name").alias("state_name"),
        F.col("r_name").alias("region_name")).orderBy("region_name", "state_name", "city_code")


@register
def productivity_read(spark: SparkSession, sf: str) -> DataFrame:
    """One product -> year x state: production, planted and harvested area."""
    li = trade_lines(spark, sf, product=True, reporter=True).filter(F.col("product") == "Brand#7")
    return li.groupBy("year", F.col("reporter").alias("state")).agg(
        F.sum("qty").alias("production"), F.sum(F.round(F.col("l_discount") * 100)).alias("area_planted"),
        F.sum(F.round(F.col("tax") * 100)).alias("area_harvested"))


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    return scd.scd2_timeline(t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"),
                             ["user_id"], ts="ts", tiebreak="event_id")


@register
def current_flow_market(spark: SparkSession, sf: str) -> DataFrame:
    """Current mappings that are not cleared ('error' clears)."""
    cur = scd.scd2_without_cleared(scd.scd2_current(_timeline(spark, sf)), "event_type", "error")
    return cur.select("user_id", F.col("event_type").alias("market"), "version", "valid_from")


@register
def flow_market_values(spark: SparkSession, sf: str) -> DataFrame:
    """(regime = order priority, flow) totals, excluding one regime."""
    li = trade_lines(spark, sf)
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("regime"))
    j = li.join(o, "l_orderkey").filter(F.col("regime") != "5-LOW")
    return j.groupBy("regime", "flow").agg(r2(F.sum("value_cents") / 100.0).alias("value"), F.count(F.lit(1)).alias("n_rows"))


@register
def market_nature_series(spark: SparkSession, sf: str) -> DataFrame:
    """Order value by market nature x year, where the nature is the
    customer's current (non-cleared) SCD2 mapping; unclassified rows dropped."""
    cur = current_flow_market(spark, sf).select(F.col("user_id").alias("o_custkey"), "market")
    o = t(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), _order_cents().alias("cents"))
    j = o.join(cur, "o_custkey", "left").filter(F.col("market").isNotNull())
    return j.groupBy("market", "year").agg(r2(F.sum("cents") / 100.0).alias("value"), F.count(F.lit(1)).alias("n_rows"))


@register
def quality_by_source_read(spark: SparkSession, sf: str) -> DataFrame:
    """The quality-by-source mart read for one source."""
    from strata.plans.twins_rollups import quality_by_source

    return quality_by_source(spark, sf).filter(F.col("source") == "orders")


@register
def source_metadata_read(spark: SparkSession, sf: str) -> DataFrame:
    """The source-metadata view read for one source."""
    from strata.plans.twins_rollups import source_metadata

    return source_metadata(spark, sf).filter(F.col("source") == "lineitem")


@register
def bilateral_named(spark: SparkSession, sf: str) -> DataFrame:
    """The nation dimension joined twice, as reporter and as partner."""
    m = trade_lines(spark, sf, partner=True, reporter=True).groupBy("year", "reporter", "partner").agg(
        F.sum("value_cents").alias("cents"))
    nat = t(spark, sf, "nation")
    rep = F.broadcast(nat.select(F.col("n_nationkey").alias("reporter"), F.col("n_name").alias("reporter_name")))
    par = F.broadcast(nat.select(F.col("n_nationkey").alias("partner"), F.col("n_name").alias("partner_name")))
    return m.join(rep, "reporter").join(par, "partner").select(
        "year", "reporter_name", "partner_name", r2(F.col("cents") / 100.0).alias("value"))


def named_totals(spark: SparkSession, sf: str, parts: DataFrame) -> DataFrame:
    """Codes present in the exports ⋈ catalog names, joined back to the
    per-code totals (codes without a catalog row keep a NULL name)."""
    li = trade_lines(spark, sf, product=True).filter(F.col("flow") == "A")
    totals = li.groupBy("product").agg(F.sum("value_cents").alias("cents"))
    present = totals.select("product").distinct()
    catalog = parts.groupBy(F.col("p_brand").alias("product")).agg(
        F.max("p_name").alias("name"))
    named = present.join(catalog, "product", "inner")
    return totals.join(named, "product", "left").select("product", "name", r2(F.col("cents") / 100.0).alias("value"))


@register
def seasonality_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The seasonality mart joined to the month dimension on the
    constructed first-of-month date."""
    m = trade_lines(spark, sf).groupBy("flow", "year", "month").agg(F.sum("value_cents").alias("cents"))
    m = m.withColumn("date_month", C.safe_date_from_parts("year", "month"))
    cal = F.broadcast(calendar_spine(spark, "1970-01-01", "2050-12-01").select("date_month", "month_name_pt", "quarter"))
    return m.join(cal, "date_month", "left").select("flow", "year", "month", "month_name_pt", "quarter",
                                                   r2(F.col("cents") / 100.0).alias("value"))


@register
def median_price_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median unit price per year, and years whose median is
    below 0.1 x the mean of the neighbouring years' medians (a cliff)."""
    li = trade_lines(spark, sf).withColumn("price", F.try_divide(F.col("value_cents") / 100.0, F.col("qty")))
    med = exact_percentiles(li, ["year"], "price", {"median_price": 0.5})
    from pyspark.sql import Window

    w = Window.orderBy("year")
    nb = (F.lag("median_price").over(w) + F.lead("median_price").over(w)) / 2
    return med.withColumn("cliffed", F.col("median_price") < F.lit(0.1) * nb).select(
        "year", r6("median_price").alias("median_price"), "cliffed")


@register
def unit_list_per_product(spark: SparkSession, sf: str) -> DataFrame:
    """Products reported under more than one unit, units listed."""
    li = trade_lines(spark, sf, product=True)
    out = CK.single_value_per_key(li, ["product"], "unit", "single_stat_unit", CK.WARN)
    return out.select("product", "n_values", "values", "check", "severity")
