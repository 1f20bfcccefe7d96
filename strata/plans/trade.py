"""Trade pipelines: national (monthly, per state) and bilateral (annual,
reporter x partner) flows from Bronze to Gold.

National Silver: the newest delivery per (flow, year) replaces the older
one, then row-level latest-wins on the natural key; values typed; unit
family and code succession looked up from seeds.

Bilateral Silver: the same batch replacement per (year, reporter); only
fully aggregated totals are kept (no World partner, X/M flows, all-regimes
customs code, HS6, no breakdown rows) so every SUM is a true total; a real
unit code is preferred over '-1' on ties; zero quantity and weights read as
missing.

National Gold: the dominant-unit roll-up per cell, monthly FX and index
deflation and the weight-based quality flag.  The unit labels come from the
unit table (a function of the unit and product), so they are grouping keys
of the roll-up; the chapter is taken from the cell's (current) code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import deflate as D
from strata.operators.dedup import latest_batch, latest_wins, prefer_not
from strata.operators.quality import implied_price_levels
from strata.operators.rollup import dominant_unit_rollup
from strata.session import stored

COMEX_KEY = ["flow", "CO_ANO", "CO_MES", "CO_NCM", "CO_PAIS", "SG_UF_NCM", "CO_VIA", "CO_URF", "CO_UNID"]
COMTRADE_KEY = ["refYear", "reporterCode", "partnerCode", "partner2Code", "cmdCode", "flowCode", "customsCode",
                "mosCode", "motCode"]
# The bilateral totals-only filter and first year.
WORLD_PARTNER, TOTAL_CUSTOMS, TOTAL_CODE, HS6_LEN, MIN_YEAR = "0", "C00", "0", 6, 2000


def _unit_lookup(df: DataFrame, unit_name_col: str, families: DataFrame, overrides: DataFrame | None, source: str,
                 product_col: str) -> DataFrame:
    key = C.norm_key(unit_name_col)
    g = families.select(F.col("unit_raw").alias("_gu"), F.col("family").alias("_gf"), F.col("base_unit").alias("_gb"),
                        F.col("to_base").alias("_gt"))
    out = df.join(g, key == F.col("_gu"), "left")
    fam, base, to = F.col("_gf"), F.col("_gb"), F.col("_gt")
    drop = ["_gu", "_gf", "_gb", "_gt"]
    if overrides is not None:
        o = overrides.filter(F.col("source") == source).select(
            F.col("product_code").alias("_op"), F.col("unit_raw").alias("_ou"), F.col("family").alias("_of"),
            F.col("base_unit").alias("_ob"), F.col("to_base").alias("_ot"))
        out = out.join(o, (F.col(product_col) == F.col("_op")) & (key == F.col("_ou")), "left")
        fam, base, to = F.coalesce("_of", fam), F.coalesce("_ob", base), F.coalesce("_ot", to)
        drop += ["_op", "_ou", "_of", "_ob", "_ot"]
    return (out.withColumn("family", F.coalesce(fam, F.lit("desconhecida"))).withColumn("base_unit", base)
            .withColumn("_to_base", to).drop(*drop))


def comex_silver(bronze: DataFrame, units: DataFrame, families: DataFrame, overrides: DataFrame,
                 succession: DataFrame) -> DataFrame:
    """National trade Silver at the full source grain.

    ``units``: (co_unid, unit_name, unit_symbol); ``succession``:
    (reported_code, current_code)."""
    b = latest_batch(bronze, ["flow", "CO_ANO"], "ingestion_timestamp")
    b = latest_wins(b, COMEX_KEY, ["ingestion_timestamp"])
    y, m = F.col("CO_ANO").try_cast("int"), F.col("CO_MES").try_cast("int")
    p = b.select(
        "flow", y.alias("reference_year"), m.alias("reference_month"),
        C.safe_date_from_parts(y, m).alias("reference_date"),
        F.col("CO_NCM").alias("ncm_code_reported"), C.chapter("CO_NCM").alias("hs_chapter"),
        F.col("CO_PAIS").alias("country_code"), F.col("SG_UF_NCM").alias("state_acronym"),
        F.col("CO_VIA").alias("transport_route_code"), F.col("CO_URF").alias("customs_office_code"),
        F.col("CO_UNID").alias("stat_unit_code"),
        C.safe_numeric("QT_ESTAT").alias("qty_native"), C.safe_numeric("KG_LIQUIDO").alias("net_weight_kg"),
        C.safe_numeric("VL_FOB").alias("val_fob_usd"), C.safe_numeric("VL_FRETE").alias("freight_usd"),
        C.safe_numeric("VL_SEGURO").alias("insurance_usd"), "ingestion_timestamp",
    ).filter(F.col("reference_date").isNotNull())
    u = units.select(F.col("co_unid").alias("stat_unit_code"), F.col("unit_name").alias("unit_native"),
                     F.col("unit_symbol").alias("unit_native_symbol"))
    p = p.join(u, "stat_unit_code", "left")
    s = succession.select(F.col("reported_code").alias("ncm_code_reported"), F.col("current_code").alias("_cur"))
    p = p.join(s, "ncm_code_reported", "left").withColumn(
        "ncm_code", F.coalesce("_cur", "ncm_code_reported")).drop("_cur")
    p = _unit_lookup(p, "unit_native", families, overrides, "comex", "ncm_code")
    return p.withColumn("qty_base", F.col("qty_native") * F.col("_to_base")).drop("_to_base")


def comtrade_silver(bronze: DataFrame, units: DataFrame, families: DataFrame, succession: DataFrame,
                    min_year: int = MIN_YEAR) -> DataFrame:
    """Bilateral trade Silver: one row per (reporter, partner, HS6, flow, year).

    ``units``: (qty_unit_code, unit_name, unit_symbol, unit_raw)."""
    b = latest_batch(bronze, ["refYear", "reporterCode"], "ingestion_timestamp")
    totals = (
        (F.col("partnerCode") != WORLD_PARTNER) & F.col("flowCode").isin("X", "M")
        & (F.col("customsCode") == TOTAL_CUSTOMS) & (F.length("cmdCode") == HS6_LEN)
        & (F.col("motCode") == TOTAL_CODE) & (F.col("partner2Code") == TOTAL_CODE) & (F.col("mosCode") == TOTAL_CODE)
        & (F.col("refYear").try_cast("int") >= min_year)
    )
    b = latest_wins(b.filter(totals), COMTRADE_KEY, ["ingestion_timestamp", prefer_not("qtyUnitCode", "-1")])
    p = b.select(
        C.flow_name("flowCode").alias("flow"), F.col("refYear").try_cast("int").alias("reference_year"),
        F.col("reporterCode").alias("reporter_code"), F.col("partnerCode").alias("partner_code"),
        F.col("cmdCode").alias("cmd_code_reported"), C.chapter("cmdCode").alias("hs_chapter"),
        F.col("customsCode").alias("customs_code"), F.col("qtyUnitCode").alias("qty_unit_code"),
        C.zero_as_missing(C.safe_numeric("qty")).alias("qty_native"),
        C.zero_as_missing(C.safe_numeric("netWgt")).alias("net_weight_kg"),
        C.zero_as_missing(C.safe_numeric("grossWgt")).alias("gross_weight_kg"),
        C.safe_numeric("primaryValue").alias("primary_value_usd"), C.safe_numeric("cifvalue").alias("cif_value_usd"),
        C.safe_numeric("fobvalue").alias("fob_value_usd"), "ingestion_timestamp",
    ).filter(F.col("flow").isNotNull())
    u = units.select("qty_unit_code", F.col("unit_name").alias("unit_native"),
                     F.col("unit_symbol").alias("unit_native_symbol"), F.nullif(F.col("unit_raw"), F.lit("")).alias("_raw"))
    p = p.join(u, "qty_unit_code", "left")
    g = families.select(F.col("unit_raw").alias("_raw"), F.col("family").alias("_f"), F.col("base_unit"),
                        F.col("to_base").alias("_t"))
    p = p.join(g, "_raw", "left").withColumn("family", F.coalesce("_f", F.lit("desconhecida"))) \
        .withColumn("qty_base", F.col("qty_native") * F.col("_t")).drop("_raw", "_f", "_t")
    s = succession.select(F.col("reported_code").alias("cmd_code_reported"), F.col("current_code").alias("_cur"))
    return p.join(s, "cmd_code_reported", "left").withColumn(
        "cmd_code", F.coalesce("_cur", "cmd_code_reported")).drop("_cur")


COMEX_CELL = ["flow", "reference_year", "reference_month", "ncm_code", "country_code", "state_acronym",
              "transport_route_code"]


def month_index(index: DataFrame, deflators=D.DEFLATORS) -> DataFrame:
    """The index of each deflator per (year, month)."""
    return index.filter(F.col("index_value").isNotNull()).groupBy("reference_year", "reference_month").agg(
        *[F.max(F.when(F.col("series_code") == code, F.col("index_value"))).alias(f"{name}_index")
          for name, code in deflators.items()])


def comex_gold(silver: DataFrame, index: DataFrame, fx: DataFrame, outliers: bool = True, **bounds: float) -> DataFrame:
    """National trade Gold: D09/D10 dominant unit per cell, C06 monthly
    deflation, state names and the B27 weight-based flag."""
    base = dominant_unit_rollup(
        silver, COMEX_CELL, "stat_unit_code", "qty_native",
        sum_cols=["net_weight_kg", "val_fob_usd", "freight_usd", "insurance_usd"],
        unit_sum_cols=["qty_base"], unit_labels=["unit_native", "unit_native_symbol", "family", "base_unit"],
        max_cols=["ingestion_timestamp"], labels_are_keys=True,
    ).withColumnRenamed("ingestion_timestamp", "last_refresh").withColumn("hs_chapter", C.chapter("ncm_code"))
    if outliers:  # read by the pass over the logs and by the rows themselves
        base = stored(base, "gold_base")
    # One row a month: broadcast, as in deflate.
    fm, mi = F.broadcast(D.fx_month_average(fx)), F.broadcast(month_index(index))
    j = (base.join(fm, ["reference_year", "reference_month"], "left")
         .join(mi, ["reference_year", "reference_month"], "left")
         .crossJoin(F.broadcast(D.latest_index(index))).crossJoin(F.broadcast(D.fx_latest(fx))))
    nominal = F.col("val_fob_usd") * F.col("brl_per_usd_avg")
    j = j.withColumn("val_yearfx_usd", F.col("val_fob_usd")).withColumn("val_yearfx_brl", nominal).withColumn(
        "val_yearfx_eur", C.safe_divide(nominal, F.col("brl_per_eur_avg")))
    for d in D.DEFLATORS:
        j = j.withColumn(f"val_real_{d}_brl", nominal * C.safe_divide(F.col(f"{d}_current"), F.col(f"{d}_index")))
        for cur in D.CURRENCIES:
            j = j.withColumn(f"val_real_{d}_{cur}", C.safe_divide(F.col(f"val_real_{d}_brl"), F.col(f"brl_per_{cur}_current")))
    j = j.withColumn("reference_date", C.safe_date_from_parts("reference_year", "reference_month")).withColumn(
        "state_name", C.state_name("state_acronym")).withColumn("region", C.state_region("state_acronym"))
    if outliers:
        j = implied_price_levels(j, ["flow", "ncm_code"], "val_fob_usd", "net_weight_kg", **bounds)
        j = j.withColumn("data_quality_flag", C.trade_quality_flag("net_weight_kg", "val_fob_usd", "qty_level", "val_level"))
        j = j.drop("qty_level", "val_level")
    else:
        j = j.withColumn("data_quality_flag", C.trade_quality_flag("net_weight_kg", "val_fob_usd"))
    drop = [f"brl_per_{c}_avg" for c in D.CURRENCIES] + [f"brl_per_{c}_current" for c in D.CURRENCIES]
    drop += [f"{d}_index" for d in D.DEFLATORS] + [f"{d}_current" for d in D.DEFLATORS]
    return j.drop(*drop)


COMTRADE_CELL = ["flow", "customs_code", "reference_year", "reporter_code", "partner_code", "cmd_code"]


def comtrade_gold(silver: DataFrame, index: DataFrame, fx: DataFrame, countries: DataFrame, hs: DataFrame,
                  outliers: bool = True, **bounds: float) -> DataFrame:
    """Bilateral trade Gold: D09/D10 dominant unit per cell, C05 annual
    deflation of the USD value through the year-average rate (V5: NULL
    before 1994), C07/C08 descriptions with the country list joined twice
    (reporter, partner), and the B26/B28 flag where quantity presence is
    ``coalesce(qty, net weight)``.

    ``countries``: (m49_code, country_name, iso_a3, is_group); ``hs``:
    (cmd_code, description)."""
    from strata.operators.units import describe

    base = dominant_unit_rollup(
        silver, COMTRADE_CELL, "qty_unit_code", "qty_native",
        sum_cols=["net_weight_kg", "gross_weight_kg", "primary_value_usd", "cif_value_usd", "fob_value_usd"],
        unit_sum_cols=["qty_base"], unit_labels=["unit_native", "unit_native_symbol", "family", "base_unit"],
        max_cols=["ingestion_timestamp"], labels_are_keys=True,
    ).withColumnRenamed("ingestion_timestamp", "last_refresh").withColumn("hs_chapter", C.chapter("cmd_code"))
    if outliers:
        base = stored(base, "gold_base")
    j = (base.join(F.broadcast(D.fx_year_average(fx)), "reference_year", "left")
         .join(F.broadcast(D.year_end_index(index)), "reference_year", "left")
         .crossJoin(F.broadcast(D.latest_index(index))).crossJoin(F.broadcast(D.fx_latest(fx))))
    valid = F.col("reference_year") >= D.FIRST_FX_YEAR
    nominal = F.when(valid, F.col("primary_value_usd") * F.col("brl_per_usd_avg"))
    j = j.withColumn("val_yearfx_usd", F.col("primary_value_usd")).withColumn("val_yearfx_brl", nominal).withColumn(
        "val_yearfx_eur", C.safe_divide(nominal, F.col("brl_per_eur_avg")))
    for d in D.DEFLATORS:
        j = j.withColumn(f"val_real_{d}_brl", F.when(valid, F.col("primary_value_usd") * F.col("brl_per_usd_avg")
                                                     * C.safe_divide(F.col(f"{d}_current"), F.col(f"{d}_year_end"))))
        for cur in D.CURRENCIES:
            j = j.withColumn(f"val_real_{d}_{cur}", C.safe_divide(F.col(f"val_real_{d}_brl"), F.col(f"brl_per_{cur}_current")))
    j = j.withColumn("val_cif_usd", F.col("cif_value_usd")).withColumn("val_fob_usd", F.col("fob_value_usd")).withColumn(
        "reference_date", C.year_end_date("reference_year"))
    rep = countries.select(F.col("m49_code").alias("_rk"), F.col("country_name").alias("reporter_name"),
                           F.col("iso_a3").alias("reporter_iso_a3"))
    par = countries.select(F.col("m49_code").alias("_pk"), F.col("country_name").alias("partner_name"),
                           F.col("iso_a3").alias("partner_iso_a3"), F.col("is_group").alias("partner_is_group"))
    desc = hs.select(F.col("cmd_code").alias("_hk"), F.col("description").alias("cmd_description"))
    j = describe(j, [(rep, "reporter_code", "_rk"), (par, "partner_code", "_pk"), (desc, "cmd_code", "_hk")])
    presence = F.coalesce(F.col("qty_native"), F.col("net_weight_kg"))
    if outliers:
        j = implied_price_levels(j, ["flow", "cmd_code"], "primary_value_usd", "net_weight_kg", **bounds)
        j = j.withColumn("data_quality_flag", C.quality_flag(presence, F.col("primary_value_usd"), "qty_level", "val_level"))
        j = j.drop("qty_level", "val_level")
    else:
        j = j.withColumn("data_quality_flag", C.quality_flag(presence, F.col("primary_value_usd")))
    drop = [f"brl_per_{c}_avg" for c in D.CURRENCIES] + [f"brl_per_{c}_current" for c in D.CURRENCIES]
    drop += [f"{d}_year_end" for d in D.DEFLATORS] + [f"{d}_current" for d in D.DEFLATORS]
    drop += ["cif_value_usd", "fob_value_usd"]
    return j.drop(*drop)
