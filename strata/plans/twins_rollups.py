"""Twins for lookups, harmonisation, roll-ups, quality and marts.

The trade role of lineitem: flow = l_returnflag, unit = l_linestatus,
weight/quantity = l_quantity, value = revenue, month = l_shipdate,
product = part brand, reporter = supplier nation, partner = customer nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import columns as C
from strata.operators import checks, quality, rollup, units
from strata.sources import seeds
from strata.plans.base import r2, r6, register
from strata.plans.inputs import t, trade_lines

# Fixed lookup rows used by the twins (seed-sized literal tables).
TWIN_FACTOR_RANGES = [("F", 1995, 1997, 1.5), ("F", 1998, 2001, 2.0), ("O", 1995, 1999, 0.5)]
TWIN_UNIT_FAMILIES = [
    ("Toneladas", "massa", "t", 1.0),
    ("Quilogramas", "massa", "t", 0.001),
    ("Mil litros", "volume", "m³", 1.0),
]
TWIN_PRODUCT_OVERRIDES = [("tpch", "Brand#13", "Quilogramas", "massa", "t", 0.002)]
TWIN_SUCCESSION = [("Brand#1", "Brand#10", "merged"), ("Brand#2", "Brand#20", "merged"), ("Brand#3", "Brand#30", "renamed")]

_RANGE_SCHEMA = "unit_of_measure string, year_from int, year_to int, brl_factor double"


def _value() -> F.Column:
    return F.col("value_cents") / F.lit(100.0)


@register
def range_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Value x factor(unit, year between from and to); no factor -> NULL.

    Lines are reduced to (unit, year) first; the factor is constant there."""
    li = trade_lines(spark, sf).groupBy("unit", "year").agg(F.sum("value_cents").alias("cents"), F.count(F.lit(1)).alias("n_rows"))
    ranges = seeds.seed_frame(spark, TWIN_FACTOR_RANGES, _RANGE_SCHEMA)
    j = units.range_lookup(li, ranges, "unit", "year")
    val = F.col("cents") / F.lit(100.0)
    return j.select("unit", "year", "n_rows", r2(val).alias("val"), "brl_factor", r2(val * F.col("brl_factor")).alias("val_converted"))


@register
def factor_overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    """Ship-year ranges per (status, flag) overlapping within a status."""
    ranges = trade_lines(spark, sf).groupBy("unit", "flow").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return checks.range_overlaps(ranges, "unit", "lo", "hi", "flow")


def _unit_raw() -> F.Column:
    return (
        F.when((F.col("flow") == "R") & (F.col("unit") == "O"), F.lit("Caixas"))
        .when(F.col("unit") == "F", F.lit(" Toneladas"))
        .otherwise(F.lit("quilogramas"))
    )


@register
def unit_harmonise(spark: SparkSession, sf: str) -> DataFrame:
    """Family, base unit, base quantity with a product override;
    an unknown unit is 'desconhecida' with NULL base quantity."""
    li = trade_lines(spark, sf, product=True).withColumn("unit_raw", _unit_raw())
    fam = seeds.seed_frame(spark, TWIN_UNIT_FAMILIES, "unit_raw string, family string, base_unit string, to_base double")
    ov = seeds.seed_frame(
        spark, TWIN_PRODUCT_OVERRIDES, "source string, product_code string, unit_raw string, family string, base_unit string, to_base double"
    )
    h = units.harmonise_units(li, "unit_raw", "qty", fam, ov, product_col="product", source="tpch")
    return h.groupBy("product", "family", "base_unit").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("qty_native"), r6(F.sum("qty_base")).alias("qty_base")
    )


@register
def succession_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Reported brand -> current brand, unknown brands kept."""
    p = t(spark, sf, "part").select("p_partkey", "p_brand")
    s = seeds.seed_frame(spark, TWIN_SUCCESSION, "reported_code string, current_code string, note string")
    return units.succession_remap(p, "p_brand", s, "current_brand")


@register
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A long (key, variable, value) table pivoted back to one row per key."""
    li = t(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        "l_suppkey",
        F.col("l_returnflag").alias("flow"),
        F.explode(
            F.array(
                F.struct(F.lit("qty").alias("variable"), F.col("l_quantity").alias("v")),
                F.struct(F.lit("val").alias("variable"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).alias("v")),
                F.struct(F.lit("disc").alias("variable"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("v")),
            )
        ).alias("kv"),
    )
    long = li.groupBy("year", "l_suppkey", "flow", F.col("kv.variable").alias("variable")).agg(F.sum("kv.v").alias("numeric_value"))
    wide = rollup.long_to_wide(long, ["year", "l_suppkey", "flow"], "variable", "numeric_value", {"qty": "qty", "val": "val", "disc": "disc"})
    return wide.select("year", "l_suppkey", "flow", "qty", r2(F.col("val") / 100.0).alias("val"), r6("disc").alias("disc"))


@register
def dominant_unit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per (flow, year, month, supplier) cell the unit of the
    largest-quantity line; quantity summed over that unit only."""
    li = trade_lines(spark, sf).withColumn(
        "unit_name", F.when(F.col("unit") == "F", "finished").otherwise("open")
    )
    out = rollup.dominant_unit_rollup(
        li, ["flow", "year", "month", "l_suppkey"], "unit", "qty", sum_cols=["value_cents"], unit_labels=["unit_name"],
        labels_are_keys=True,
    )
    return out.select("flow", "year", "month", "l_suppkey", "unit", "unit_name", "qty",
                      r2(F.col("value_cents") / 100.0).alias("value"), "source_rows")


# Detector parameters of the twin (the library defaults are the reference's).
TWIN_MIN_OBS, TWIN_VALUE_FLOOR, TWIN_PRICE_K, TWIN_OUTLIER_K = 100, 10000.0, 2.0, 1.5


@register
def implied_price_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Implied-price outlier levels per (flow, brand)
    with exact distributed percentiles, then the 8-value flag."""
    li = trade_lines(spark, sf, product=True).withColumn("value", _value())
    s = quality.implied_price_levels(
        li, ["flow", "product"], "value", "qty", TWIN_MIN_OBS, TWIN_VALUE_FLOOR, TWIN_PRICE_K, TWIN_OUTLIER_K
    )
    f = quality.flag_rows(s, "qty", "value")
    return f.select("l_orderkey", "l_linenumber", "flow", "product", "val_level", "qty_level", "data_quality_flag")


@register
def quality_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness flags of two sources with the share per source."""
    li = t(spark, sf, "lineitem").select(
        C.quality_flag_basic(C.zero_as_missing("l_tax"), C.zero_as_missing("l_discount")).alias("data_quality_flag")
    )
    o = t(spark, sf, "orders").select(
        C.quality_flag_basic(
            F.nullif(F.col("o_custkey") % 7, F.lit(0)),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        ).alias("data_quality_flag")
    )
    q = quality.quality_by_source({"lineitem": li, "orders": o})
    return q.select("source", "data_quality_flag", "n_rows", r6("share").alias("share"))


@register
def mart_annual(spark: SparkSession, sf: str) -> DataFrame:
    """Annual trade mart (month collapsed) per flow, product, reporter."""
    li = trade_lines(spark, sf, product=True, reporter=True)
    m = li.groupBy("flow", "year", "product", "reporter").agg(
        F.sum("value_cents").alias("cents"),
        F.sum("qty").alias("weight"),
        F.count(F.lit(1)).alias("source_rows"),
        F.count_distinct("month").alias("n_months"),
    )
    return m.select("flow", "year", "product", "reporter", r2(F.col("cents") / 100.0).alias("value"), "weight", "source_rows", "n_months")


@register
def mart_seasonality(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly seasonality mart."""
    m = trade_lines(spark, sf).groupBy("flow", "year", "month").agg(
        F.sum("value_cents").alias("cents"), F.sum("qty").alias("weight"), F.count(F.lit(1)).alias("source_rows")
    )
    return m.select("flow", "year", "month", r2(F.col("cents") / 100.0).alias("value"), "weight", "source_rows")


@register
def mart_bilateral(spark: SparkSession, sf: str) -> DataFrame:
    """Annual bilateral mart (reporter x partner)."""
    m = trade_lines(spark, sf, partner=True, reporter=True).groupBy("flow", "year", "reporter", "partner").agg(
        F.sum("value_cents").alias("cents"), F.sum("qty").alias("weight"), F.count(F.lit(1)).alias("source_rows")
    )
    return m.select("flow", "year", "reporter", "partner", r2(F.col("cents") / 100.0).alias("value"), "weight", "source_rows")


@register
def source_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Per source year span, rows, distinct products and states, last refresh."""
    li = t(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("y"), F.col("l_partkey").cast("string").alias("p"),
        F.col("l_suppkey").cast("string").alias("s"), F.col("l_shipdate").alias("r"))
    o = t(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"),
        F.col("o_custkey").cast("string").alias("s"), F.col("o_orderdate").alias("r"))
    e = t(spark, sf, "events").select(
        F.year("ts").alias("y"), F.col("event_type").alias("p"), F.col("user_id").cast("string").alias("s"), F.col("ts").alias("r"))
    m = rollup.source_metadata({"lineitem": li, "orders": o, "events": e}, "y", "p", "s", "r")
    return m.select("source", "min_year", "max_year", "n_rows", "n_products", "n_states", "last_refresh")
