"""Survey pipeline: Bronze -> Silver (long) -> Gold (wide, value matrix).

Bronze rows are verbatim strings plus ``ingestion_timestamp``.  Silver keeps
the newest ingestion per natural key, types the value (sentinels, decimal
comma, measured zero), converts historical currency on monetary rows and
harmonises units on quantity rows.  Gold pivots the long rows to one row per
(year, state, city, product) and adds the deflated value matrix and the
quality flag.  All steps are DataFrame transforms; seeds are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import deflate as D
from strata.operators.dedup import latest_wins
from strata.operators.quality import implied_price_levels
from strata.session import stored

# The reference's default survey variable codes.
VAR_QUANTITY = "144"
VAR_VALUE = "145"
TERRITORIAL_LEVEL = "Município"
# The reference's crop survey variable codes.
CROP_AREA_PLANTED = "8331"
CROP_AREA_HARVESTED = "216"
CROP_QUANTITY = "214"
CROP_YIELD = "112"
CROP_VALUE = "215"
# The reference's livestock survey variable codes.
HERD_QUANTITY = "105"
ANIMAL_QUANTITY = "106"
ANIMAL_VALUE = "215"


def survey_silver(
    bronze: DataFrame,
    product_code_col: str,
    product_desc_col: str,
    currency_factors: DataFrame,
    unit_families: DataFrame,
    product_overrides: DataFrame,
    source: str,
    quantity_vars: Sequence[str] = (VAR_QUANTITY,),
    value_vars: Sequence[str] = (VAR_VALUE,),
    measure_kind: str | None = None,
    cruzado_correction: bool = False,
    other_vars: Sequence[str] = (),
    coded_descriptions: bool = True,
) -> DataFrame:
    """Silver survey rows (one per year, city, product, variable).

    ``other_vars`` are measures kept as reported (areas, yields); without
    ``coded_descriptions`` product names carry no code prefix to strip.
    """
    wanted = [*quantity_vars, *value_vars, *other_vars]
    b = bronze.filter(F.col("variavel_codigo").isin(wanted) & (F.col("nivel_territorial") == TERRITORIAL_LEVEL))
    # Dealt once, by the cell that Gold pivots: all rows of a key are rows of one cell, so neither latest-wins
    # nor the pivot deals them again.  Cities come first, as the values that tell most rows apart in the sort.
    b = b.withColumn("_year", F.col("ano").try_cast("int")).repartition("_year", "municipio_codigo", product_code_col)
    b = b.withColumn("_unit_key", C.norm_key("unidade_de_medida"))
    b = latest_wins(b, ["municipio_codigo", product_code_col, "_year", "ano", "variavel_codigo", "_unit_key"], ["ingestion_timestamp"])
    city, uf = C.split_name_state("municipio")
    p = b.select(
        F.col("_year").alias("reference_year"),
        F.col("municipio_codigo").alias("city_code"),
        city.alias("city_name"),
        uf.alias("state_acronym"),
        F.col(product_code_col).alias("product_code"),
        (C.strip_code_prefix(product_desc_col) if coded_descriptions else F.trim(product_desc_col)).alias("product_description"),
        F.col("variavel_codigo").alias("variable_code"),
        F.col("variavel").alias("variable_name"),
        F.col("unidade_de_medida").alias("unit_of_measure"),
        C.safe_numeric("valor", dash_is_zero=True).alias("raw_numeric_value"),
        "_unit_key",
        "ingestion_timestamp",
    )
    fx = currency_factors.select(
        C.norm_key("unit_of_measure").alias("_fx_unit"), F.col("year_from").alias("_fx_from"),
        F.col("year_to").alias("_fx_to"), F.col("brl_factor").alias("_fx_factor"))
    p = p.join(
        fx,
        (F.col("_unit_key") == F.col("_fx_unit")) & F.col("reference_year").between(F.col("_fx_from"), F.col("_fx_to")),
        "left",
    )
    gen = unit_families.select(F.col("unit_raw").alias("_g_unit"), F.col("family").alias("_g_family"),
                               F.col("base_unit").alias("_g_base"), F.col("to_base").alias("_g_to"))
    p = p.join(gen, F.col("_unit_key") == F.col("_g_unit"), "left")
    ov = product_overrides.filter(F.col("source") == source).select(
        F.col("product_code").alias("_o_product"), F.col("unit_raw").alias("_o_unit"), F.col("family").alias("_o_family"),
        F.col("base_unit").alias("_o_base"), F.col("to_base").alias("_o_to"))
    p = p.join(ov, (F.col("product_code") == F.col("_o_product")) & (F.col("_unit_key") == F.col("_o_unit")), "left")

    is_value = F.col("variable_code").isin(list(value_vars))
    is_qty = F.col("variable_code").isin(list(quantity_vars))
    factor = F.col("_fx_factor")
    if cruzado_correction:
        factor = factor * C.cruzado_factor("reference_year", "unit_of_measure")
    raw = F.col("raw_numeric_value")
    out = p.select(
        *([F.lit(measure_kind).alias("measure_kind")] if measure_kind else []),
        "reference_year", "city_code", "city_name", "state_acronym", "product_code", "product_description",
        "variable_code", "variable_name", "unit_of_measure",
        F.when(is_value, raw * factor).otherwise(raw).alias("numeric_value"),
        is_value.alias("is_monetary_value"),
        F.when(is_qty, F.col("unit_of_measure")).alias("unit_native"),
        F.when(is_qty, F.coalesce("_o_family", "_g_family", F.lit("desconhecida"))).alias("family"),
        F.when(is_qty, F.coalesce("_o_base", "_g_base")).alias("base_unit"),
        F.when(is_qty, raw).alias("qty_native"),
        F.when(is_qty, raw * F.coalesce("_o_to", "_g_to")).alias("qty_base"),
        "ingestion_timestamp",
    )
    return out


def survey_gold(
    silver: DataFrame,
    index: DataFrame,
    fx: DataFrame,
    outliers: bool = True,
    group: Sequence[str] = ("product_code", "family"),
    measures: Mapping[str, str] | None = None,
    present: Sequence[str] = (),
    dealt: bool = False,
    **bounds: float,
) -> DataFrame:
    """Gold survey fact: D01 pivot + C05 deflation + B23 names + B25/B26 flag.

    ``measures`` (column: variable code) are pivoted too; a cell stays when its
    quantity, its value or one of ``present`` is reported.  ``dealt``: Silver comes
    straight from ``survey_silver``, its rows of a cell together.  ``bounds`` are
    parameters of the outlier levels.
    """
    measures = measures or {}
    # In the order of Silver's own sort; cities tell most rows apart.
    cell = ["city_code", "product_code", "reference_year", "state_acronym"]
    # Silver has one row a cell, variable and unit, so a partial aggregate would combine nothing;
    # dealt by the cell first, the names (a sorted aggregate) are sorted once and not twice.
    base = (silver if dealt else silver.repartition(*cell)).groupBy(*cell).agg(
        F.max("city_name").alias("city_name"),
        F.max("product_description").alias("product_description"),
        F.max("family").alias("family"),
        F.max("unit_native").alias("unit_native"),
        F.max("base_unit").alias("base_unit"),
        F.max("qty_native").alias("qty_native"),
        F.max("qty_base").alias("qty_base"),
        F.max(F.when(F.col("is_monetary_value"), F.col("numeric_value"))).alias("val_raw"),
        F.max("ingestion_timestamp").alias("last_refresh"),
        *[F.max("measure_kind").alias("measure_kind") for _ in range("measure_kind" in silver.columns)],
        *[F.max(F.when(F.col("variable_code") == code, F.col("numeric_value"))).alias(c) for c, code in measures.items()],
    ).filter(F.coalesce("qty_native", "val_raw", *present).isNotNull())
    if outliers:  # read by the pass over the logs and by the rows themselves
        base = stored(base, "gold_base")
    g = D.deflate(base, "val_raw", D.year_end_index(index), D.latest_index(index), D.fx_year_average(fx), D.fx_latest(fx))
    g = g.withColumn("reference_date", C.year_end_date("reference_year")).withColumn(
        "state_name", C.state_name("state_acronym")).withColumn("region", C.state_region("state_acronym"))
    if outliers:
        g = implied_price_levels(g, list(group), "val_real_ipca_brl", "qty_native", **bounds)
        flag = C.quality_flag("qty_native", "val_raw", "qty_level", "val_level")
        g = g.withColumn("data_quality_flag", flag).drop("qty_level", "val_level")
    else:
        g = g.withColumn("data_quality_flag", C.quality_flag_basic("qty_native", "val_raw"))
    return g.select("reference_year", "state_acronym", *[c for c in g.columns if c not in ("reference_year", "state_acronym")])


def crop_silver(
    bronze: DataFrame,
    product_code_col: str,
    product_desc_col: str,
    currency_factors: DataFrame,
    unit_families: DataFrame,
    product_overrides: DataFrame,
) -> DataFrame:
    """Silver crop rows: five measures, and the documented 1985 currency correction."""
    return survey_silver(
        bronze, product_code_col, product_desc_col, currency_factors, unit_families, product_overrides, "pam",
        [CROP_QUANTITY], [CROP_VALUE], cruzado_correction=True,
        other_vars=[CROP_AREA_PLANTED, CROP_AREA_HARVESTED, CROP_YIELD], coded_descriptions=False)


def crop_gold(silver: DataFrame, index: DataFrame, fx: DataFrame, outliers: bool = True, dealt: bool = False, **bounds: float) -> DataFrame:
    """Gold crop fact: D02 pivot of five measures; B30 overrides the quality flag."""
    areas = {"area_planted_ha": CROP_AREA_PLANTED, "area_harvested_ha": CROP_AREA_HARVESTED}
    g = survey_gold(silver, index, fx, outliers, measures=areas | {"yield_kg_ha": CROP_YIELD}, present=list(areas), dealt=dealt, **bounds)
    return g.withColumn("data_quality_flag", C.area_consistency_flag(*areas, "data_quality_flag"))


def livestock_silver(
    herd: DataFrame,
    animal: DataFrame,
    product_code_col: str,
    product_desc_col: str,
    currency_factors: DataFrame,
    unit_families: DataFrame,
    product_overrides: DataFrame,
) -> DataFrame:
    """Silver livestock rows (G01): herds are a stock without value, animal
    products a flow; each table is deduplicated on its own key."""
    args = (product_code_col, product_desc_col, currency_factors, unit_families, product_overrides, "ppm")
    stock = survey_silver(herd, *args, [HERD_QUANTITY], [], "stock", coded_descriptions=False)
    flow = survey_silver(animal, *args, [ANIMAL_QUANTITY], [ANIMAL_VALUE], "flow", cruzado_correction=True, coded_descriptions=False)
    return stock.unionByName(flow)


def livestock_gold(silver: DataFrame, index: DataFrame, fx: DataFrame, outliers: bool = True, **bounds: float) -> DataFrame:
    """Gold livestock fact (D03): B29, a stock row lacks no value."""
    g = survey_gold(silver, index, fx, outliers, **bounds)
    stock = F.when(F.col("qty_native").isNotNull(), "OK").otherwise("MISSING_QUANTITY")
    return g.withColumn("data_quality_flag", F.when(F.col("measure_kind") == "stock", stock).otherwise(F.col("data_quality_flag")))
