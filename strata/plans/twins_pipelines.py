"""The reference's pipelines end to end on Bronze derived from the driver tables.

``survey_pipeline``: per ship year, supplier (city) and brand (product), the
lineitem quantity and revenue are rendered as verbatim survey Bronze rows
(all strings: decimal comma, 'Mil Reais' values in thousands), delivered
twice (a later delivery restates 2001 quantities).  The library's Silver and
Gold steps then run unchanged: latest-wins, typed parsing, currency factors,
unit families, the long->wide pivot, deflation and the quality flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import STATES
from strata.plans.base import r2, register
from strata.plans.inputs import fx_series, index_series, orders_daily, revenue_cents, t
from strata.plans.survey import survey_gold, survey_silver
from strata.session import stored
from strata.sources import seeds

# Parameters under which every quality flag occurs on the driver tables.
CROP_BOUNDS = {"min_obs": 10, "value_floor": 1000.0, "price_k": 1.2, "outlier_k": 1.5}
DELIVERY_1, DELIVERY_2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def a_row_each(d: DataFrame, names: Sequence[str], cells: Sequence[Sequence[Column]]) -> DataFrame:
    """A row of ``d`` for each of its cells whose first value is not null."""
    return d.select("*", F.stack(F.lit(len(cells)), *[c for cell in cells for c in cell]).alias(*names)).filter(F.col(names[0]).isNotNull())


def survey_bronze(spark: SparkSession, sf: str) -> DataFrame:
    # Values are reckoned first, so that the lines are dealt to their parts with no more than these.
    lines = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity", revenue_cents().alias("cents"))
    li = lines.join(
        t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(
        t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    agg = li.groupBy("y", "l_suppkey", "s_nationkey", "p_brand").agg(
        F.sum("l_quantity").alias("q"), F.sum("cents").cast("bigint").alias("c"))
    uf = F.element_at(F.array(*[F.lit(a) for a, _, _ in STATES]), (F.col("s_nationkey") % len(STATES)) + 1)
    code = F.substring("p_brand", 7, 10)
    common = [
        F.col("y").cast("string").alias("ano"),
        F.col("l_suppkey").cast("string").alias("municipio_codigo"),
        F.concat(F.lit("Cidade "), F.col("l_suppkey").cast("string"), F.lit(" - "), uf).alias("municipio"),
        code.alias("prod_codigo"),
        F.concat(F.lit("1."), code, F.lit(" - "), F.col("p_brand")).alias("prod"),
    ]
    qty_valor = F.col("q").cast("bigint").cast("string")
    # Value in thousands with a decimal comma, rendered from integer cents.
    val_valor = F.concat(F.floor(F.col("c") / 100000).cast("string"), F.lit(","),
                         F.lpad((F.col("c") % 100000).cast("string"), 5, "0"))

    def cell(var, name, unit, valor, ts):
        return var, F.lit(name), F.lit(unit), valor, F.lit(ts).cast("timestamp_ntz")

    # All variables and deliveries come from one aggregation, names rendered once a cell.
    qty = ("Quantidade produzida", "Toneladas")
    cells = [cell(F.lit("144"), *qty, qty_valor, DELIVERY_1), cell(F.lit("145"), "Valor da produção", "Mil Reais", val_valor, DELIVERY_1),
             cell(F.when(F.col("y") == 2001, "144"), *qty, (F.col("q") + 1).cast("bigint").cast("string"), DELIVERY_2)]
    names = ["variavel_codigo", "variavel", "unidade_de_medida", "valor", "ingestion_timestamp"]
    return a_row_each(agg.select(*common, "y", "q", "c"), names, cells).select(
        "ano", "municipio_codigo", "municipio", "prod_codigo", "prod", *names[:4], F.lit("Município").alias("nivel_territorial"), names[4])


SURVEY_GOLD_COLS = ["reference_year", "reference_date", "state_acronym", "state_name", "region", "city_code",
                    "city_name", "product_code", "product_description", "family", "unit_native", "qty_native",
                    "qty_base", "data_quality_flag"]
SURVEY_MONEY_COLS = ["val_yearfx_brl", "val_yearfx_usd", "val_yearfx_eur", "val_real_ipca_brl", "val_real_ipca_usd",
                     "val_real_igpm_brl", "val_real_igpdi_eur"]


def survey_gold_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    """``levels``: parameters of the outlier levels."""
    silver = _survey_silver(spark, sf)
    daily = orders_daily(spark, sf)
    return survey_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), dealt=True, **levels)


def survey_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    gold = survey_gold_facts(spark, sf, **levels)
    return gold.select(*SURVEY_GOLD_COLS, *[r2(c).alias(c) for c in SURVEY_MONEY_COLS])


@register
def survey_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze -> Silver -> Gold survey pipeline with the reference seeds and outlier levels."""
    return survey_facts(spark, sf, **CROP_BOUNDS)


# National trade: lineitem rendered as one verbatim file per (flow, year).
FLOW_OF_RETURNFLAG = {"A": "EXP", "N": "EXP", "R": "IMP"}
UNIT_OF_LINESTATUS = {"F": "10", "O": "11"}
COMEX_UNITS = [("10", "Quilograma Liquido", "kg"), ("11", "Tonelada", "t")]


def _map(col: str, mapping: dict[str, str]) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def _joined_lines(spark: SparkSession, sf: str, part: Sequence[Column], *values: Column | str) -> DataFrame:
    """``values`` of each line with ``c_nationkey`` of its buyer, ``s_nationkey`` of its supplier and ``part`` of its part.

    Orders meet their customers before the lines, and the values are reckoned
    first, so that lines are dealt by order and by part alone, no wider than need
    be.  They are written in between, so that the disk holds one dealing at a time."""
    buyers = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").drop("o_custkey")
    bought = (t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *values)
              .join(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").drop("l_suppkey")
              .join(buyers, "l_orderkey").drop("l_orderkey"))
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), *part)
    return stored(bought, "lines_bought").join(parts, "l_partkey").drop("l_partkey")


def comex_bronze(spark: SparkSession, sf: str) -> DataFrame:
    li = _joined_lines(
        spark, sf, [F.lpad(F.substring("p_brand", 7, 10), 8, "0").alias("CO_NCM")],
        _map("l_returnflag", FLOW_OF_RETURNFLAG).alias("flow"), F.trunc("l_shipdate", "month").alias("month"),
        _map("l_linestatus", UNIT_OF_LINESTATUS).alias("CO_UNID"),
        "l_quantity", revenue_cents().alias("cents"), F.round(F.col("l_tax") * 100).alias("tax_cents"))
    uf = F.element_at(F.array(*[F.lit(a) for a, _, _ in STATES]), (F.col("s_nationkey") % len(STATES)) + 1)
    country = F.lpad(F.col("c_nationkey").cast("string"), 3, "0")
    agg = li.groupBy("flow", "month", "CO_NCM", "CO_UNID", country.alias("CO_PAIS"), uf.alias("SG_UF_NCM")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.sum("cents").cast("bigint").alias("c"),
        F.sum("tax_cents").cast("bigint").alias("f"))
    agg = agg.withColumns({"CO_ANO": F.year("month").cast("string"), "CO_MES": F.lpad(F.month("month").cast("string"), 2, "0")})
    # Whole dollars, so that cell sums of parsed values are exact in any order.
    money = F.floor(F.col("c") / 100).cast("string")
    imp = F.col("flow") == "IMP"
    # The (EXP, 2001) file is republished later without its tonne-unit rows.
    restated = (F.col("flow") == "EXP") & (F.col("CO_ANO") == "2001") & (F.col("CO_UNID") == "10")
    times = [[F.lit(DELIVERY_1).cast("timestamp_ntz")], [F.when(restated, F.lit(DELIVERY_2).cast("timestamp_ntz"))]]
    # Both deliveries come from one aggregation.
    return a_row_each(agg, ["ingestion_timestamp"], times).select(
        "flow", "CO_ANO", "CO_MES", "CO_NCM", "CO_UNID", "CO_PAIS", "SG_UF_NCM", F.lit("01").alias("CO_VIA"), F.lit("1").alias("CO_URF"),
        F.col("q").cast("string").alias("QT_ESTAT"), (F.col("q") * 10).cast("string").alias("KG_LIQUIDO"),
        money.alias("VL_FOB"), F.when(imp, F.col("f").cast("string")).alias("VL_FRETE"),
        F.when(imp, F.lit("0,5")).alias("VL_SEGURO"), "ingestion_timestamp")


COMEX_GOLD_COLS = ["flow", "reference_year", "reference_month", "reference_date", "ncm_code", "country_code",
                   "state_acronym", "state_name", "stat_unit_code", "unit_native", "family", "qty_native", "qty_base",
                   "net_weight_kg", "source_rows", "data_quality_flag"]
COMEX_MONEY_COLS = ["val_fob_usd", "freight_usd", "insurance_usd", "val_yearfx_brl", "val_yearfx_eur",
                    "val_real_ipca_brl", "val_real_igpm_usd"]


def comex_gold_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    """National trade Bronze -> Silver -> Gold: batch replacement per
    (flow, year), unit and succession lookups, dominant-unit cells and
    monthly deflation."""
    from strata.plans.trade import comex_gold, comex_silver

    units = seeds.seed_frame(spark, COMEX_UNITS, "co_unid string, unit_name string, unit_symbol string")
    succ = seeds.seed_frame(spark, [("00000001", "00000010", "merged")], seeds.SUCCESSION_SCHEMA)
    silver = comex_silver(stored(comex_bronze(spark, sf), "bronze_comex"), units, seeds.unit_families(spark), seeds.product_unit_factors(spark), succ)
    daily = orders_daily(spark, sf)
    return comex_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), **levels)


def comex_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    gold = comex_gold_facts(spark, sf, **levels)
    return gold.select(*COMEX_GOLD_COLS, *[r2(c).alias(c) for c in COMEX_MONEY_COLS])


@register
def comex_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """National trade facts with outlier levels."""
    return comex_facts(spark, sf, **CROP_BOUNDS)


# Bilateral trade: one verbatim chunk per (year, reporter), all strings.
COMTRADE_FLOW_OF_RETURNFLAG = {"A": "X", "R": "M", "N": "RX"}
COMTRADE_UNITS = [("8", "Weight in kilograms", "kg", "kg"), ("-1", "No quantity", "", "")]


def comtrade_bronze(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 10)
    # Small parts are reported as legacy 4-digit headings, the rest as HS6.
    cmd = F.when(F.col("p_size") <= 5, F.lpad(brand, 4, "0")).otherwise(F.lpad(brand, 6, "0"))
    li = _joined_lines(
        spark, sf, [cmd.alias("cmdCode")], F.year("l_shipdate").alias("year"), _map("l_returnflag", COMTRADE_FLOW_OF_RETURNFLAG).alias("flowCode"),
        F.when(F.col("l_linestatus") == "F", "8").otherwise("-1").alias("qtyUnitCode"),
        # Large discounts are booked under a breakdown customs code (not the total).
        F.when(F.col("l_discount") >= 0.09, "C01").otherwise("C00").alias("customsCode"),
        "l_quantity", revenue_cents().alias("cents"))
    agg = li.groupBy("year", "s_nationkey", "flowCode", "c_nationkey", "cmdCode", "qtyUnitCode", "customsCode").agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.sum("cents").cast("bigint").alias("c"))
    agg = agg.select(F.col("year").cast("string").alias("refYear"), F.col("s_nationkey").cast("string").alias("reporterCode"), "flowCode",
                     F.col("c_nationkey").cast("string").alias("partnerCode"), "cmdCode", "qtyUnitCode", "customsCode", "q", "c")

    def rows(ts, cond=None):
        d = agg if cond is None else agg.filter(cond)
        no_qty = F.col("qtyUnitCode") == "-1"
        return d.select(
            "refYear", "reporterCode", "flowCode", "partnerCode", F.lit("0").alias("partner2Code"), "cmdCode",
            "customsCode", F.lit("0").alias("mosCode"), F.lit("0").alias("motCode"), "qtyUnitCode",
            F.when(no_qty, F.lit("0.0")).otherwise(F.col("q").cast("string")).alias("qty"),
            (F.col("q") * 10).cast("string").alias("netWgt"), (F.col("q") * 11).cast("string").alias("grossWgt"),
            F.floor(F.col("c") / 100).cast("string").alias("primaryValue"), F.lit(None).cast("string").alias("cifvalue"),
            F.floor(F.col("c") / 100).cast("string").alias("fobvalue"),
            F.lit(ts).cast("timestamp_ntz").alias("ingestion_timestamp"))

    # Reporter 7's 2001 chunk is re-downloaded later without its import rows.
    restated = (F.col("refYear") == "2001") & (F.col("reporterCode") == "7") & (F.col("flowCode") != "M")
    return rows(DELIVERY_1).unionByName(rows(DELIVERY_2, restated))


COMTRADE_SILVER_COLS = ["flow", "reference_year", "reporter_code", "partner_code", "cmd_code", "cmd_code_reported",
                        "hs_chapter", "qty_unit_code", "unit_native", "family", "qty_native", "qty_base", "net_weight_kg",
                        "gross_weight_kg", "primary_value_usd", "fob_value_usd", "cif_value_usd"]


@register
def comtrade_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Bilateral trade Bronze -> Silver: batch replacement per (year,
    reporter), totals only (no World partner, X/M, C00, HS6, no breakdowns),
    real unit preferred over '-1', zero quantity -> missing, succession."""
    from strata.plans.trade import comtrade_silver

    units = seeds.seed_frame(spark, COMTRADE_UNITS, "qty_unit_code string, unit_name string, unit_symbol string, unit_raw string")
    succ = seeds.seed_frame(spark, [("000001", "000010", "merged")], seeds.SUCCESSION_SCHEMA)
    silver = comtrade_silver(stored(comtrade_bronze(spark, sf), "bronze_comtrade"), units, seeds.unit_families(spark), succ)
    return silver.select(*COMTRADE_SILVER_COLS)


COMTRADE_GOLD_COLS = ["reference_year", "reference_date", "flow", "customs_code", "cmd_code", "hs_chapter",
                      "cmd_description", "reporter_code", "reporter_name", "partner_code", "partner_name",
                      "partner_is_group", "family", "qty_unit_code", "unit_native", "qty_native", "qty_base",
                      "net_weight_kg", "gross_weight_kg", "source_rows", "data_quality_flag"]
COMTRADE_MONEY_COLS = ["val_yearfx_usd", "val_yearfx_brl", "val_yearfx_eur", "val_real_ipca_brl", "val_real_igpm_usd",
                       "val_real_igpdi_eur", "val_fob_usd"]


def comtrade_gold_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    """Bilateral trade Bronze -> Silver -> Gold with annual deflation and
    reporter/partner names from the nation table (region 0 marks a group)."""
    from strata.plans.trade import comtrade_gold, comtrade_silver

    units = seeds.seed_frame(spark, COMTRADE_UNITS, "qty_unit_code string, unit_name string, unit_symbol string, unit_raw string")
    succ = seeds.seed_frame(spark, [("000001", "000010", "merged")], seeds.SUCCESSION_SCHEMA)
    silver = comtrade_silver(stored(comtrade_bronze(spark, sf), "bronze_comtrade_g"), units, seeds.unit_families(spark), succ)
    countries = t(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("m49_code"), F.col("n_name").alias("country_name"),
        F.substring("n_name", 1, 3).alias("iso_a3"), (F.col("n_regionkey") == 0).alias("is_group"))
    hs = t(spark, sf, "part").select(F.lpad(F.substring("p_brand", 7, 10), 6, "0").alias("cmd_code"),
                                     F.col("p_brand").alias("description")).distinct()
    daily = orders_daily(spark, sf)
    return comtrade_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), countries, hs, **levels)


def comtrade_facts(spark: SparkSession, sf: str, **levels) -> DataFrame:
    gold = comtrade_gold_facts(spark, sf, **levels)
    return gold.select(*COMTRADE_GOLD_COLS, *[r2(c).alias(c) for c in COMTRADE_MONEY_COLS])


@register
def comtrade_gold_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Bilateral trade facts with outlier levels."""
    return comtrade_facts(spark, sf, **CROP_BOUNDS)


SURVEY_MART_SUMS = ["qty_native", "val_yearfx_brl", "val_real_ipca_brl", "val_real_igpm_usd"]


def _survey_silver(spark: SparkSession, sf: str) -> DataFrame:
    """Read once by its latest-wins, so Bronze is not written in between."""
    return survey_silver(survey_bronze(spark, sf), "prod_codigo", "prod",
                         seeds.currency_factors(spark), seeds.unit_families(spark), seeds.product_unit_factors(spark), "pevs")


def _survey_gold(spark: SparkSession, sf: str, silver: DataFrame | None = None) -> DataFrame:
    dealt = silver is None
    silver = _survey_silver(spark, sf) if silver is None else silver
    daily = orders_daily(spark, sf)
    return survey_gold(silver, index_series(spark, sf, daily), fx_series(spark, sf, daily), dealt=dealt)


def _hidden_products(spark: SparkSession, sf: str) -> DataFrame:
    from strata.operators import scd
    from strata.plans.twins_logs import _log

    return scd.hidden_registry(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(
        F.col("user_id").cast("string").alias("code"))


def _product_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Crosswalk: product code -> group (brands grouped in fours)."""
    b = t(spark, sf, "part").select(F.substring("p_brand", 7, 10).alias("code")).distinct()
    return b.withColumn("group_id", F.concat(F.lit("grp_"), ((F.col("code").cast("int") - 1) / 4).cast("int").cast("string")))


@register
def survey_serving_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The annual survey mart over the pipeline's Gold with the
    hidden-code gate and the product-group crosswalk."""
    from strata.plans.serving import serving_mart

    gold = _survey_gold(spark, sf)
    # Gold money is published at cent precision; mart sums of cents stay
    # next to an exact cent whatever the summation order.
    gold = gold.select(*[r2(c).alias(c) if c in SURVEY_MART_SUMS[1:] else F.col(c) for c in gold.columns])
    mart, _ = serving_mart(gold, ["reference_year", "state_acronym", "product_code", "family"],
                           _hidden_products(spark, sf), "product_code", SURVEY_MART_SUMS, {"n_cities": "city_code"},
                           refresh_col=None, crosswalk=_product_groups(spark, sf))
    return mart.select("reference_year", "state_acronym", "product_code", "family", "group_id", "n_cities",
                       "source_rows", "qty_native", *[r2(c).alias(c) for c in SURVEY_MART_SUMS[1:]])


@register
def survey_mart_checks(spark: SparkSession, sf: str) -> DataFrame:
    """L02/L03/L05 over stored layers: Silver's control totals in Gold, crosswalk
    uniqueness, and the gated Gold in the mart."""
    from strata.operators import checks as CK
    from strata.operators import conservation as CV
    from strata.plans.twins_controls import layer
    from strata.plans.serving import conserved_to_gold, serving_mart

    stored_layer = lambda name, build, measures: layer(spark, name, build, measures, ("reference_year",))
    value = F.when(F.col("is_monetary_value"), F.col("numeric_value"))
    silver = stored_layer("silver_checked", lambda: _survey_silver(spark, sf), {"qty": "qty_native", "value": value})
    gold = stored_layer("gold_checked", lambda: _survey_gold(spark, sf, silver.read()), {m: m for m in SURVEY_MART_SUMS})
    hidden = _hidden_products(spark, sf)
    keys = ["reference_year", "state_acronym", "product_code", "family"]
    built, violations = serving_mart(gold.read(), keys, hidden, "product_code", SURVEY_MART_SUMS, refresh_col=None, crosswalk=_product_groups(spark, sf))
    mart = stored_layer("mart_checked", lambda: built, {}).read()
    return CK.run_suite({
        "silver_conserved_in_gold": (CV.unconserved(silver, gold.read(), {"qty": "qty_native", "value": "val_raw"}), CK.ERROR),
        "crosswalk_unique": (violations, CK.ERROR),
        "mart_conserves_gated_gold": (conserved_to_gold(mart, gold.read(), hidden, "product_code", SURVEY_MART_SUMS), CK.ERROR),
        "mart_grain_unique": (CK.unique_combination(mart, ["reference_year", "state_acronym", "product_code", "family"]), CK.ERROR),
    })
