"""Twins of the dashboard compositions (I02-I05, I21-I34, J08) and the
domain checks (L13, L15, L19, L22, L23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import checks as CK
from strata.operators import scd
from strata.operators.gate import visibility_gate
from strata.operators.rollup import family_sums
from strata.operators.units import range_lookup
from strata.plans import analyses as A
from strata.plans import reads as R
from strata.sources import seeds
from strata.plans.base import r2, r6, register
from strata.plans.inputs import t, trade_lines
from strata.plans.twins_logs import _log
from strata.plans.twins_reads import PRODUCTS, STATES, gold
from strata.plans.twins_rollups import _RANGE_SCHEMA, TWIN_FACTOR_RANGES


def _usd(c: str) -> F.Column:
    return F.col(c) / F.lit(100.0)


@register
def overview_with_families(spark: SparkSession, sf: str) -> DataFrame:
    """The yearly overview with per-year family quantities attached
    (left join from the product series)."""
    g = gold(spark, sf)
    ov = g.groupBy("year").agg(F.sum("value_cents").alias("cents"), F.count(F.lit(1)).alias("n_rows"))
    fam = g.groupBy("product", "year").agg(*family_sums("family", "qty")).groupBy("year").agg(
        F.sum("q_mass").alias("q_mass"), F.sum("q_vol").alias("q_vol"), F.sum("q_count").alias("q_count"))
    return ov.join(fam, "year", "left").select("year", r2(_usd("cents")).alias("value"), "n_rows", "q_mass", "q_vol", "q_count")


@register
def latest_complete_year(spark: SparkSession, sf: str) -> DataFrame:
    """The latest year is complete with 12 distinct months, else the
    latest complete year is the previous one."""
    m = R.distinct_per_year(trade_lines(spark, sf), "year", "month", "n_months")
    last = m.agg(F.max_by("n_months", "year").alias("n_last"), F.max("year").alias("latest_year"))
    return last.select("latest_year", "n_last", F.when(F.col("n_last") == 12, F.col("latest_year"))
                       .otherwise(F.col("latest_year") - 1).alias("latest_complete_year"))


def unit_price(spark: SparkSession, sf: str, weighed: F.Column) -> DataFrame:
    """Export value and weight per year (display units) and the
    derived unit price; a missing or zero weight gives NULL."""
    li = trade_lines(spark, sf).filter(F.col("flow") == "A")
    v = li.groupBy("year").agg(F.sum("value_cents").alias("cents"))
    w = li.filter(weighed).groupBy("year").agg(F.sum("qty").alias("weight"))
    j = v.join(w, "year", "left")
    return j.select("year", r2(F.col("cents") / 1e8).alias("value_musd"), (F.col("weight") / 1e3).alias("weight_kt"),
                    r6(F.try_divide(_usd("cents"), F.col("weight"))).alias("unit_price"))


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    g = gold(spark, sf)
    return g.withColumn("data_quality_flag", C.quality_flag_basic(C.zero_as_missing("tax"), F.col("value_cents")))


@register
def quality_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Flag shares per year (every flag, known or not, in the denominator)."""
    c = _flags(spark, sf).groupBy("year", "data_quality_flag").agg(F.count(F.lit(1)).alias("n_rows"))
    s = A.share_of_total(c, ["year"], "n_rows")
    return s.select("year", "data_quality_flag", "n_rows", r6("share").alias("share"))


@register
def quality_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The quality mix renormalised over the selected flags."""
    c = _flags(spark, sf).filter(F.col("data_quality_flag").isin("OK", "MISSING_QUANTITY")).groupBy(
        "data_quality_flag").agg(F.count(F.lit(1)).alias("n_rows"))
    s = c.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))
    return s.select("data_quality_flag", "n_rows", r6("share").alias("share"))


@register
def partner_top3(spark: SparkSession, sf: str) -> DataFrame:
    """Per flow, partner totals with the top-3 partners' share."""
    li = trade_lines(spark, sf, partner=True)
    top = R.top_per_key(li, "flow", "partner", "value_cents", 3).groupBy("flow").agg(F.sum("value").alias("_top"), F.max("n_members").alias("n_partners"))
    g = top.join(li.groupBy("flow").agg(F.sum("value_cents").alias("_tot")), "flow")
    return g.select("flow", "n_partners", r2(_usd("_tot")).alias("total"), r6(F.col("_top") / F.col("_tot")).alias("top3_share"))


@register
def products_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Per group (part type), visible brands (hidden part codes
    removed) and whether the group has a single family."""
    p = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("group_id"), F.col("p_brand").alias("code"),
                                    F.when(F.col("p_size") > 25, "massa").otherwise("volume").alias("family"))
    hidden = scd.hidden_registry(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(F.col("user_id").alias("code"))
    vis = visibility_gate(p, hidden, "p_partkey")
    g = vis.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_parts"),
                                    F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    fam = A.family_set(vis, ["group_id"], "family").select("group_id", "single_family")
    return g.join(fam, "group_id")


@register
def basket_series(spark: SparkSession, sf: str) -> DataFrame:
    """Basket (five brands) x state (four nations) x year totals."""
    g = R.apply(gold(spark, sf), R.in_list("product", PRODUCTS), R.in_list("state", STATES))
    return g.groupBy("state", "year").agg(r2(F.sum("value_cents") / 100.0).alias("value"))


@register
def coverage_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of years and states covered by a selection."""
    g = gold(spark, sf)
    sel = R.apply(g, R.year_between("year", 1996, 1999), R.in_list("state", STATES))
    tot = g.agg(F.count_distinct("year").alias("ty"), F.count_distinct("state").alias("ts"))
    s = sel.agg(F.count_distinct("year").alias("sy"), F.count_distinct("state").alias("ss"))
    return s.crossJoin(tot).select(r6(F.col("sy") / F.col("ty")).alias("year_share"),
                                   r6(F.col("ss") / F.col("ts")).alias("state_share"))


@register
def herd_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's quantity at its own latest year, as a share of the
    sum of those stocks (a composition, not an additive series)."""
    s = trade_lines(spark, sf, product=True).groupBy("product", "year").agg(F.sum("qty").alias("stock"))
    last = s.groupBy("product").agg(F.max_by("stock", "year").alias("stock"), F.max("year").alias("year"))
    return A.share_of_total(last, [], "stock").select("product", "year", "stock", r6("share").alias("share"))


@register
def top_states_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """I32: state x year values limited to the top 12 states by total."""
    g = gold(spark, sf)
    tot = g.groupBy("state").agg(F.sum("value_cents").alias("t")).orderBy(F.col("t").desc(), "state").limit(12)
    return g.join(tot.select("state"), "state", "left_semi").groupBy("state", "year").agg(
        r2(F.sum("value_cents") / 100.0).alias("value"))


@register
def product_profile(spark: SparkSession, sf: str) -> DataFrame:
    """One product's yearly value, previous-year value, unit price,
    share of the year's total, and its peak year."""
    g = gold(spark, sf)
    yr = g.groupBy("year").agg(F.sum("value_cents").alias("year_total"))
    p = g.filter(F.col("product") == "Brand#11").groupBy("year").agg(F.sum("value_cents").alias("v"), F.sum("qty").alias("q"))
    w = Window.orderBy("year")
    peak = p.agg(F.max_by("year", F.struct("v", -F.col("year"))).alias("peak_year"))
    j = p.join(yr, "year").crossJoin(F.broadcast(peak))
    return j.select("year", r2(_usd("v")).alias("value"), r2(F.lag("v").over(w) / 100.0).alias("previous"),
                    r6(F.try_divide(_usd("v"), F.col("q"))).alias("unit_price"),
                    r6(F.col("v") / F.col("year_total")).alias("share_of_year"), "peak_year")


@register
def product_top_states(spark: SparkSession, sf: str) -> DataFrame:
    """The ten first states of every product, over all years, by value and by quantity."""
    g = gold(spark, sf)
    by = lambda m, name: R.top_per_key(g, "product", "state", m, 10).withColumn("measure", F.lit(name))
    both = by("value_cents", "value").unionByName(by("qty", "heads"))
    return both.select("measure", "product", "state", "rank", "value", r6("share").alias("share"), "n_members")


@register
def flow_top_links(spark: SparkSession, sf: str) -> DataFrame:
    """The eight largest links with their share of all flows."""
    li = trade_lines(spark, sf, partner=True, reporter=True)
    links = li.groupBy("reporter", "partner").agg(F.sum("value_cents").alias("v"))
    total = links.agg(F.sum("v").alias("t"))
    top = links.orderBy(F.col("v").desc(), "reporter", "partner").limit(8)
    return top.crossJoin(F.broadcast(total)).select("reporter", "partner", r2(_usd("v")).alias("value"), r6(F.col("v") / F.col("t")).alias("share"))


@register
def flow_headline(spark: SparkSession, sf: str) -> DataFrame:
    """Total flow value, the top origin and the top destination."""
    li = trade_lines(spark, sf, partner=True, reporter=True)
    o = li.groupBy("reporter").agg(F.sum("value_cents").alias("v"))
    d = li.groupBy("partner").agg(F.sum("value_cents").alias("v"))
    top_o = o.agg(F.max_by("reporter", F.struct("v", -F.col("reporter"))).alias("top_origin"), F.sum("v").alias("total"))
    top_d = d.agg(F.max_by("partner", F.struct("v", -F.col("partner"))).alias("top_destination"))
    return top_o.crossJoin(top_d).select(r2(_usd("total")).alias("total"), "top_origin", "top_destination")


@register
def stacked_year_max(spark: SparkSession, sf: str) -> DataFrame:
    """The largest per-year total across the flow layers."""
    from strata.operators.series import stacked_year_max as op

    fy = trade_lines(spark, sf).groupBy("flow", "year").agg(F.sum("value_cents").alias("v"))
    return op(fy, "year", "v").select(r2(F.col("stack_max") / 100.0).alias("stack_max"))


def domain_suite(spark: SparkSession, sf: str, configured: F.Column) -> DataFrame:
    """L13/L15/L19/L22/L23 as one suite."""
    li = trade_lines(spark, sf, product=True)
    # Every (unit, year) with value has a currency factor range.
    cells = li.groupBy("unit", "year").agg(F.count(F.lit(1)).alias("n"))
    no_factor = range_lookup(cells, seeds.seed_frame(spark, TWIN_FACTOR_RANGES, _RANGE_SCHEMA), "unit", "year").filter(
        F.col("brl_factor").isNull())
    # Planted >= harvested per (product, year) (planted = discount points, harvested = tax points).
    areas = li.groupBy("product", "year").agg(F.sum(F.round(F.col("l_discount") * 100)).alias("planted"),
                                              F.sum(F.round(F.col("tax") * 100)).alias("harvested"))
    # One unit family per product.
    fam = li.withColumn("family", F.when(F.col("unit") == "F", "massa").otherwise("volume"))
    # Catalogue (current users) vs configured codes (customers), either side missing.
    cur = scd.current_catalog(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(
        F.col("user_id").alias("code"), F.lit(True).alias("in_catalog"))
    conf = t(spark, sf, "customer").filter(configured).select(
        F.col("c_custkey").alias("code"), F.lit(True).alias("configured"))
    side = cur.join(conf, "code", "full_outer").filter(F.col("in_catalog").isNull() | F.col("configured").isNull())
    # Orphans detected but not marked (nothing marked yet -> all).
    data = t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    orph = scd.orphans(_log(spark, sf), data, ["user_id"], "group_name", ts="ts", tiebreak="event_id")
    return CK.run_suite({
        "monetary_unit_has_factor": (no_factor, CK.ERROR),
        "planted_ge_harvested": (areas.filter(F.col("planted") < F.col("harvested")), CK.WARN),
        "single_family_per_product": (CK.single_value_per_key(fam, ["product"], "family", "single_family"), CK.WARN),
        "catalog_vs_configured": (side, CK.WARN),
        "orphans_unmarked": (orph, CK.WARN),
    })


@register
def value_matrix_checks(spark: SparkSession, sf: str) -> DataFrame:
    """L06/L18 on the flagship output: the euro year-FX value is NULL before
    1999, and the implied year-FX USD rate (BRL / USD value) stays within
    the range of the observed fixings."""
    from strata.plans.twins import deflated_revenue_by_nation_year

    g = deflated_revenue_by_nation_year(spark, sf)
    implied = F.try_divide(F.col("val_yearfx_brl"), F.col("val_yearfx_usd"))
    return CK.run_suite({
        "eur_null_before_1999": (g.filter((F.col("reference_year") < 1999) & F.col("val_yearfx_eur").isNotNull()), CK.ERROR),
        "implied_usd_rate_bounded": (CK.bounded(g, implied, 100.0, 400.0), CK.ERROR),
        "real_values_present": (g.filter(F.col("val_real_ipca_brl").isNull()), CK.WARN),
    })


@register
def unconvertible_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities whose unit has no conversion (family
    'desconhecida'), grouped by raw unit for curation."""
    from strata.operators.units import harmonise_units
    from strata.plans.twins_rollups import TWIN_UNIT_FAMILIES, _unit_raw

    li = trade_lines(spark, sf).withColumn("unit_raw", _unit_raw())
    fam = seeds.seed_frame(spark, TWIN_UNIT_FAMILIES, "unit_raw string, family string, base_unit string, to_base double")
    h = harmonise_units(li, "unit_raw", "qty", fam)
    return h.filter(F.col("family") == "desconhecida").groupBy("unit_raw").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("qty_native"))
