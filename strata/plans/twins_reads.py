"""Twins of the parameterised reads (H*), rankings (F*) and universes.

The "gold" relation is lineitem with part (product = brand), supplier
(reporter) and the supplier's nation (state); family is derived from the
line status.  Filter values below are the read parameters of each twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.plans import reads as R
from strata.plans.base import r2, register
from strata.plans.inputs import t, trade_lines

PRODUCTS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
STATES = ["NATION_1", "NATION_2", "NATION_3", "NATION_4"]


def gold(spark: SparkSession, sf: str, partner: bool = False) -> DataFrame:
    li = trade_lines(spark, sf, product=True, reporter=True, partner=partner)
    nation = F.broadcast(t(spark, sf, "nation")).select(F.col("n_nationkey").alias("reporter"), F.col("n_name").alias("state"))
    return li.join(nation, "reporter").withColumn(
        "family", F.when(F.col("unit") == "F", "massa").otherwise("volume")
    )


def _money(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withColumn(col, r2(F.col(col) / F.lit(100.0)))


@register
def read_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Years 1996-2000, five products -> per year value and rows."""
    g = gold(spark, sf)
    return _money(R.overview(g, "year", "value_cents", [R.year_between("year", 1996, 2000, "l_shipdate"), R.in_list("product", PRODUCTS)]))


@register
def latest_year_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Latest year under the filters, per state, with family sums."""
    g = gold(spark, sf)
    out = R.by_state(g, "state", "year", "value_cents", "family", "qty", [R.in_list("flow", ["A", "R"])], latest=True, fact=trade_lines(spark, sf))
    return _money(out)


@register
def read_state_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """H03."""
    return _money(R.by_state_yearly(gold(spark, sf), "state", "year", "value_cents"))


@register
def read_products_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Top-100 products of four states for one flow."""
    g = gold(spark, sf)
    r = R.ranking(g, "product", "value_cents", [R.in_list("state", STATES), R.in_list("flow", ["N"])], k=100)
    return _money(r)


@register
def read_seasonality(spark: SparkSession, sf: str) -> DataFrame:
    """Year x month value and weight, two flows, 1997-2000."""
    g = R.apply(gold(spark, sf), R.year_between("year", 1997, 2000, "l_shipdate"), R.in_list("flow", ["A", "N"]))
    return _money(g.groupBy("year", "month").agg(F.sum("value_cents").alias("value"), F.sum("qty").alias("weight")))


@register
def read_months_present(spark: SparkSession, sf: str) -> DataFrame:
    """H09/D23."""
    return R.distinct_per_year(gold(spark, sf), "year", "month", "n_months")


@register
def read_reporters_present(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct reporters per year, export flow only."""
    return R.distinct_per_year(gold(spark, sf), "year", "reporter", "n_reporters", [F.col("flow") == "A"])


@register
def read_trade_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Reporters pinned to a list, default flow set when none chosen."""
    g = gold(spark, sf)
    preds = [R.reporter_pin("reporter", [1, 2, 3], default=0), R.default_flows("flow", None, ["A", "R"])]
    out = R.apply(g, *preds).groupBy("year").agg(
        F.sum("value_cents").alias("value"), F.sum("qty").alias("weight"), F.count(F.lit(1)).alias("n_rows")
    )
    return _money(out)


@register
def partner_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Partner split, unit price, top 30 by total."""
    li = trade_lines(spark, sf, partner=True).withColumn("value", F.col("value_cents") / F.lit(100.0))
    p = R.partner_table(li, "partner", "flow", "value_cents", "qty", "A", "R", rank_by="total", k=30)
    return p.select(
        "partner",
        r2(F.col("exports") / 100.0).alias("exports"),
        r2(F.col("imports") / 100.0).alias("imports"),
        r2(F.col("total") / 100.0).alias("total"),
        "weight",
        r2(F.col("unit_price") / 100.0).alias("unit_price"),
    )


@register
def flow_links(spark: SparkSession, sf: str) -> DataFrame:
    """Top 40 reporter -> partner links."""
    li = trade_lines(spark, sf, partner=True, reporter=True)
    links, _ = R.flow_links(li, "reporter", "partner", "value_cents", k=40)
    return _money(links)


@register
def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node totals over the kept top links."""
    li = trade_lines(spark, sf, partner=True, reporter=True)
    _, nodes = R.flow_links(li, "reporter", "partner", "value_cents", k=40)
    return _money(nodes)


@register
def country_universes(spark: SparkSession, sf: str) -> DataFrame:
    """Reporter (supplier) and partner (customer) nation universes."""
    s = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return R.universes({"reporter": s, "partner": c}, "nation")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    g = gold(spark, sf)
    return g.withColumn("data_quality_flag", C.quality_flag_basic(C.zero_as_missing("tax"), F.col("value_cents")))


@register
def read_quality_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    """Year x flag counts."""
    return _flagged(spark, sf).groupBy("year", "data_quality_flag").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def read_quality_by_product(spark: SparkSession, sf: str) -> DataFrame:
    """Product x flag counts."""
    return _flagged(spark, sf).groupBy("product", "data_quality_flag").agg(F.count(F.lit(1)).alias("n_rows"))


@register
def read_product_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    """Product x year value, native quantity and family sums."""
    from strata.operators.rollup import family_sums

    g = gold(spark, sf)
    out = g.groupBy("product", "year").agg(
        F.sum("value_cents").alias("value"), F.sum("qty").alias("qty_native"), *family_sums("family", "qty")
    )
    return _money(out)


@register
def read_cross_annual(spark: SparkSession, sf: str) -> DataFrame:
    """One measure (weight) for one flow, product list and reporter -> per year."""
    g = R.apply(gold(spark, sf), F.col("flow") == "A", R.in_list("product", PRODUCTS), R.reporter_pin("reporter", "default", 7))
    return g.groupBy("year").agg(F.sum("qty").alias("measure"))


@register
def read_products(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct products with a deterministic name."""
    return t(spark, sf, "part").groupBy("p_brand").agg(F.max("p_name").alias("name"), F.count(F.lit(1)).alias("n_codes"))


def _browse_preds():
    return [R.typed_filter("o_orderstatus", "eq", "F"), R.typed_filter("o_totalprice", "ge", 100000.0),
            R.typed_filter("o_orderpriority", "contains", "urgent")]


@register
def browse_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.browse_count(t(spark, sf, "orders"), _browse_preds())
