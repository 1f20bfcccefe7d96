"""Twins of the cross-source analyses (I*) and series/concentration
statistics (J*, E14-E16, F05) on the driver tables.

Series: yearly export value (flow 'A') per reporter nation and per flow.
Processing level: part type.  Hierarchy: customer -> nation -> region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import concentration as K
from strata.operators import series as S
from strata.plans import analyses as A
from strata.plans.base import r2, r6, register
from strata.plans.inputs import t, trade_lines

COUNTRY = 7  # the pinned reporter nation of the country-level analyses
# Fixed processing order of the part types (least -> most processed) for I16.
LEVEL_RANK = {"ECONOMY": 1, "STANDARD": 2, "SMALL": 3, "MEDIUM": 4, "LARGE": 5, "PROMO": 6}


def _usd(c: str) -> F.Column:
    return F.col(c) / F.lit(100.0)


def _flow_year(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly value per flow (cents)."""
    return trade_lines(spark, sf).groupBy("flow", "year").agg(F.sum("value_cents").alias("value"))


@register
def settled_year(spark: SparkSession, sf: str) -> DataFrame:
    """Last year with >= 90 % of the maximum distinct exporting suppliers."""
    li = trade_lines(spark, sf).filter(F.col("flow") == "A")
    return A.settled_year(li, "year", "l_suppkey")


def _country_world(spark: SparkSession, sf: str, by_level: bool = False):
    li = trade_lines(spark, sf, reporter=True, product_type=by_level).filter(F.col("flow") == "A")
    keys = ["year", "level"] if by_level else ["year"]
    world = li.groupBy(*keys).agg(F.sum("value_cents").alias("value"))
    country = li.filter(F.col("reporter") == COUNTRY).groupBy(*keys).agg(F.sum("value_cents").alias("value"))
    settled = A.settled_year(li, "year", "l_suppkey")
    return country, world, settled


@register
def market_share(spark: SparkSession, sf: str) -> DataFrame:
    """Pinned country's exports / world exports up to the settled year."""
    country, world, settled = _country_world(spark, sf)
    m = A.market_share(country, world, settled, "year", "value")
    return m.select("year", r2(_usd("country_value")).alias("country_value"), r2(_usd("world_value")).alias("world_value"),
                    r6("share").alias("share"))


@register
def share_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Market share in percent per product group (part type) at the latest
    settled common year, descending."""
    country, world, settled = _country_world(spark, sf, by_level=True)
    j = country.withColumnRenamed("value", "cv").join(world.withColumnRenamed("value", "wv"), ["year", "level"])
    j = j.crossJoin(F.broadcast(settled.select("settled_year"))).filter(F.col("year") <= F.col("settled_year"))
    last = j.groupBy("level").agg(F.max("year").alias("year"))
    out = j.join(last, ["level", "year"]).select(
        "level", "year", F.when(F.col("wv") == 0, 0.0).otherwise(F.col("cv") / F.col("wv") * 100).alias("share"))
    return out.select("level", "year", r6("share").alias("share")).orderBy(F.col("share").desc(), "level")


@register
def export_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    """Exported quantity / quantity x 100: per common year, per reporter nation
    over the common window, and nationally."""
    li = trade_lines(spark, sf, reporter=True)
    produced = li.groupBy("reporter", "year").agg(F.sum("qty").alias("produced"))
    exported = li.filter(F.col("flow") == "A").groupBy("reporter", "year").agg(F.sum("qty").alias("exported"))
    out = A.export_coefficient(produced, exported, "reporter", "year")
    return out.select("scope", "reporter", "year", "produced", "exported", r6("coefficient").alias("coefficient"))


@register
def price_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Gate price (value / (quantity x 1000)) vs export unit price by year: spread and
    markup on common years; a zero gate price has markup 0."""
    li = trade_lines(spark, sf)
    value, qty = F.sum("value_cents") / F.lit(100.0), F.sum("qty")
    gate = li.groupBy("year").agg(F.when(qty == 0, F.lit(0.0)).otherwise(F.try_divide(value, qty * 1000)).alias("gate_price"))
    fob = li.filter(F.col("flow") == "A").groupBy("year").agg(F.try_divide(value, qty).alias("fob_price")).filter("fob_price IS NOT NULL")
    j = fob.join(gate, "year")
    return j.select("year", r6("gate_price").alias("gate_price"), r6("fob_price").alias("fob_price"),
                    r6(F.col("fob_price") - F.col("gate_price")).alias("spread"),
                    r6(F.when(F.col("gate_price") == 0, F.lit(0.0)).otherwise(F.col("fob_price") / F.col("gate_price"))).alias("markup"))


@register
def trade_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """The country's exports (reporter side) vs partners' imports of
    it (partner side), optional third series (orders placed), discrepancy %."""
    li = trade_lines(spark, sf, reporter=True, partner=True)
    a = li.filter((F.col("flow") == "A") & (F.col("reporter") == COUNTRY)).groupBy("year").agg(F.sum("value_cents").alias("a"))
    b = li.filter((F.col("flow") == "R") & (F.col("partner") == COUNTRY)).groupBy("year").agg(F.sum("value_cents").alias("b"))
    cust = t(spark, sf, "customer").filter(F.col("c_nationkey") == COUNTRY).select(F.col("c_custkey").alias("o_custkey"))
    c = t(spark, sf, "orders").join(cust, "o_custkey", "left_semi").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100)).alias("c"))
    j = a.join(b, "year").join(c, "year", "left")
    return j.select("year", r2(_usd("a")).alias("reporter_exports"), r2(_usd("b")).alias("partner_imports"),
                    r2(_usd("c")).alias("orders_placed"), r6(A.discrepancy_pct(F.col("a"), F.col("b"))).alias("discrepancy_pct"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    li = trade_lines(spark, sf, product_type=True).filter(F.col("flow") == "A")
    return A.level_series(li, "year", "level", "value_cents", "qty")


@register
def value_added(spark: SparkSession, sf: str) -> DataFrame:
    """Exports by processing level per year: value, weight, unit price."""
    lv = _levels(spark, sf)
    return lv.select("year", "level", r2(_usd("value")).alias("value"), "weight",
                     r6(F.col("unit_price") / 100.0).alias("unit_price"))


@register
def premium(spark: SparkSession, sf: str) -> DataFrame:
    """I16: processing premium at the last year."""
    p = A.processing_premium(_levels(spark, sf), "year", "level", LEVEL_RANK)
    return p.select("year", "top_level", "base_level", r6("premium").alias("premium"))


@register
def predominant_level(spark: SparkSession, sf: str) -> DataFrame:
    """Predominant level by value share per year."""
    p = A.predominant(_levels(spark, sf), "year", "level")
    return p.select("year", "level", r6("share").alias("share"))


@register
def market_nature_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Value by year x market nature (zero-filled pivot)."""
    li = trade_lines(spark, sf).withColumn(
        "nature", F.when(F.col("unit") == "F", "commodity").otherwise("processed"))
    p = A.pivot_zero(li, "year", "nature", "value_cents", ["commodity", "processed", "unclassified"])
    return p.select("year", *[r2(_usd(c)).alias(c) for c in ("commodity", "processed", "unclassified")])


@register
def seasonality_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Export value by year x month, 0 where a month has none."""
    li = trade_lines(spark, sf).filter(F.col("flow") == "A")
    m = A.month_matrix(li, "year", "month", "value_cents")
    return m.select("year", *[r2(_usd(c)).alias(c) for c in m.columns[1:]])


@register
def seasonality_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean export value of each calendar month over the years, its peak, trough and amplitude."""
    li = trade_lines(spark, sf).filter(F.col("flow") == "A")
    p = A.month_profile(li, "year", "month", "value_cents")
    return p.select("month", r2(_usd("mean_value")).alias("mean_value"), "peak_month", "trough_month", r6("amplitude").alias("amplitude"))


@register
def productivity(spark: SparkSession, sf: str) -> DataFrame:
    """National yield = sum(qty) x 1000 / sum(area) per year
    (area = discount points), never an average of ratios; CAGR over the span."""
    li = t(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity",
                                        F.round(F.col("l_discount") * 100).alias("area"))
    y = li.groupBy("year").agg(F.sum("l_quantity").alias("production"), F.sum("area").alias("area")).withColumn(
        "yield", F.try_divide(F.col("production") * 1000, F.col("area")))
    ends = S.series_endpoints(y.withColumn("_k", F.lit(1)), ["_k"], "year", "yield")
    cagr = ends.select(S.cagr_pct("first_year", "last_year", "first_value", "last_value").alias("cagr_pct"))
    return y.crossJoin(F.broadcast(cagr)).select("year", "production", "area", r6("yield").alias("yield"),
                                                 r6("cagr_pct").alias("cagr_pct"))


@register
def region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-nation export values summed to regions."""
    li = trade_lines(spark, sf, reporter=True).groupBy("reporter").agg(F.sum("value_cents").alias("value"))
    h = F.broadcast(t(spark, sf, "nation")).join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    h = h.select(F.col("n_nationkey").alias("reporter"), "r_name")
    return A.region_rollup(li, h, "reporter", "r_name", "value").select("r_name", r2(_usd("value")).alias("value"))


@register
def facet_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers (cities) -> nation (state) rollup under hierarchy
    facets (two regions, one market segment)."""
    cust = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    h = F.broadcast(t(spark, sf, "nation")).join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cities = cust.join(h, F.col("c_nationkey") == F.col("n_nationkey")).filter(
        F.col("r_name").isin("AMERICA", "EUROPE") & (F.col("c_mktsegment") == "BUILDING"))
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round(F.col("o_totalprice") * 100).alias("cents"))
    j = o.join(cities, "c_custkey")
    return j.groupBy("n_name").agg(r2(F.sum("cents") / 100.0).alias("value"), F.count_distinct("c_custkey").alias("n_cities"))


@register
def top_others(spark: SparkSession, sf: str) -> DataFrame:
    """per flow, the top 6 brands plus an 'others' remainder, with shares."""
    li = trade_lines(spark, sf, product=True).groupBy("flow", "product").agg(F.sum("value_cents").alias("value"))
    h = K.head_and_others(li, ["flow"], "product", "value")
    return h.select("flow", "bucket", r2(_usd("value")).alias("value"), r6("share").alias("share"))


@register
def yoy(spark: SparkSession, sf: str) -> DataFrame:
    """Year-over-year growth per flow (0 on a zero base)."""
    y = S.yoy(_flow_year(spark, sf), ["flow"], "year", "value")
    return y.select("flow", "year", r2(_usd("value")).alias("value"), r6("yoy").alias("yoy"))


@register
def cagr(spark: SparkSession, sf: str) -> DataFrame:
    """CAGR over the calendar span and accumulated change per flow."""
    e = S.series_endpoints(_flow_year(spark, sf), ["flow"], "year", "value")
    return e.select("flow", "first_year", "last_year",
                    r6(S.cagr_pct("first_year", "last_year", "first_value", "last_value")).alias("cagr_pct"),
                    r6(S.accum_pct("first_value", "last_value")).alias("accum_pct"))


@register
def base100(spark: SparkSession, sf: str) -> DataFrame:
    """Rebase each flow's series to 100 at its first year."""
    b = S.rebase_100(_flow_year(spark, sf), ["flow"], "year", "value")
    return b.select("flow", "year", r6("base100").alias("base100"))


@register
def ratio_series(spark: SparkSession, sf: str) -> DataFrame:
    """Flow A over flow R x 100 on common years, with the mean ratio."""
    fy = _flow_year(spark, sf)
    r = S.ratio_series(fy.filter(F.col("flow") == "A"), fy.filter(F.col("flow") == "R"), "year", "value", "value")
    r = r.crossJoin(F.broadcast(r.agg(F.avg("ratio").alias("mean_ratio"))))
    return r.select("year", r6("ratio").alias("ratio"), r6("mean_ratio").alias("mean_ratio"))


@register
def growth_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson r of YoY growth for each pair of flows over common,
    calendar-adjacent years (0 when undefined)."""
    fy = _flow_year(spark, sf)
    a = fy.select(F.col("flow").alias("flow_a"), "year", F.col("value").alias("va"))
    b = fy.select(F.col("flow").alias("flow_b"), "year", F.col("value").alias("vb"))
    pairs = a.join(b, "year").filter(F.col("flow_a") < F.col("flow_b"))
    w = Window.partitionBy("flow_a", "flow_b").orderBy("year")
    g = (pairs.withColumn("_py", F.lag("year").over(w)).withColumn("_pa", F.lag("va").over(w))
         .withColumn("_pb", F.lag("vb").over(w)).filter(F.col("year") - F.col("_py") == 1))
    ga = F.when(F.col("_pa") == 0, 0.0).otherwise((F.col("va") - F.col("_pa")) / F.col("_pa"))
    gb = F.when(F.col("_pb") == 0, 0.0).otherwise((F.col("vb") - F.col("_pb")) / F.col("_pb"))
    g = g.select("flow_a", "flow_b", ga.alias("ga"), gb.alias("gb"))
    out = g.groupBy("flow_a", "flow_b").agg(S.pearson("ga", "gb").alias("r"), F.count(F.lit(1)).alias("n_pairs"))
    return out.select("flow_a", "flow_b", r6("r").alias("r"), "n_pairs")


@register
def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Least-squares trend of each flow's yearly value (in currency units).

    The intercept at year 0 is ill-conditioned (x ~ 2000), so the twin
    reports the slope and the fitted endpoints, which are stable."""
    fy = _flow_year(spark, sf).withColumn("v", _usd("value"))
    o = S.ols_trend(fy, ["flow"], "year", "v")
    return o.select("flow", r2("slope").alias("slope"), "x0", "x1", r2("y0").alias("y0"), r2("y1").alias("y1"))


def _nation_year(spark: SparkSession, sf: str) -> DataFrame:
    return trade_lines(spark, sf, reporter=True).groupBy("year", "reporter").agg(F.sum("value_cents").alias("value"))


@register
def gini(spark: SparkSession, sf: str) -> DataFrame:
    """Gini of reporter-nation values per year."""
    g = K.gini(_nation_year(spark, sf), ["year"], "value", tiebreak="reporter")
    return g.select("year", "n", r6("gini").alias("gini"))


@register
def hhi(spark: SparkSession, sf: str) -> DataFrame:
    """HHI of reporter-nation values per year."""
    h = K.hhi(_nation_year(spark, sf), ["year"], "value")
    return h.select("year", r6("hhi").alias("hhi"))


@register
def top_n_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the top-5 reporter nations per year."""
    s = K.top_n_share(_nation_year(spark, sf), ["year"], "value", 5, "reporter")
    return s.select("year", r6("top5_share").alias("top5_share"))


@register
def lorenz(spark: SparkSession, sf: str) -> DataFrame:
    """Lorenz points of reporter-nation values per year."""
    lz = K.lorenz(_nation_year(spark, sf), ["year"], "value", "reporter")
    return lz.select("year", "reporter", r6("pop_share").alias("pop_share"), r6("value_share").alias("value_share"))
