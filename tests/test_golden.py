"""The reference's golden unit cases (FIXTURES.md section 5) as data."""

import datetime as dt

from pyspark.sql import functions as F

from strata.operators import scd
from strata.plans.indices import fx_silver, index_silver, series_codes
from strata.plans.survey import crop_gold, crop_silver, livestock_gold, livestock_silver, survey_gold, survey_silver
from strata.sources import seeds

BRONZE_COLS = ["ano", "municipio_codigo", "municipio", "prod_codigo", "prod", "variavel_codigo", "variavel",
               "unidade_de_medida", "valor", "nivel_territorial", "ingestion_timestamp"]
TS = dt.datetime(2024, 1, 1)


def _bronze(spark, rows):
    return spark.createDataFrame([(*r, TS) for r in rows], BRONZE_COLS[:-1] + ["ingestion_timestamp"])


def test_g2_unit_families(spark):
    rows = [
        ("2020", "1", "Foo - SP", code, "x", "144", "Quantidade", unit, valor, "Município")
        for code, unit, valor in [
            ("0001", "Toneladas", "120"), ("0002", "Metros cúbicos", "50"), ("0003", "kWh", "5000"),
            ("0004", "milheiro", "2"), ("0005", "alqueire", "50"), ("9999", "saca", "10"),
            ("0006", "Toneladas", "-"), ("0007", "Toneladas", "..."),
        ]
    ]
    ov = seeds.product_unit_factors(spark, [("pevs", "9999", "saca", "massa", "t", 0.06)])
    s = survey_silver(_bronze(spark, rows), "prod_codigo", "prod", seeds.currency_factors(spark),
                      seeds.unit_families(spark), ov, "pevs")
    got = {r.product_code: (r.family, r.qty_base) for r in s.collect()}
    assert got["0001"] == ("massa", 120.0)
    assert got["0002"] == ("volume", 50.0)
    assert got["0003"][0] == "energia" and abs(got["0003"][1] - 5.0) < 1e-9
    assert got["0004"] == ("contagem", 2000.0)
    assert got["0005"][0] == "area" and abs(got["0005"][1] - 121.0) < 1e-9
    assert got["9999"][0] == "massa" and abs(got["9999"][1] - 0.6) < 1e-9
    assert got["0006"] == ("massa", 0.0)
    assert got["0007"] == ("massa", None)


def test_g3_livestock_union(spark):
    herd = _bronze(spark, [("2020", "3500001", "Foo - SP", "2670", "Bovino", "105", "Efetivo", "Cabeças", "120", "Município")])
    animal = _bronze(spark, [
        ("2020", "3500001", "Foo - SP", "2682", "Leite", "106", "Produção", "Mil litros", "5", "Município"),
        ("2020", "3500001", "Foo - SP", "2685", "Ovos", "106", "Produção", "Mil dúzias", "3", "Município"),
        ("2020", "3500001", "Foo - SP", "2687", "Mel", "106", "Produção", "Quilogramas", "2000", "Município"),
        ("2020", "3500001", "Foo - SP", "2682", "Leite", "215", "Valor", "Mil Reais", "100", "Município"),
    ])
    fx = seeds.currency_factors(spark, [("Mil Reais", 1994, 2030, 1000.0)])
    fam, ov = seeds.unit_families(spark), seeds.product_unit_factors(spark)
    s = survey_silver(herd, "prod_codigo", "prod", fx, fam, ov, "ppm", ["105"], [], "stock").unionByName(
        survey_silver(animal, "prod_codigo", "prod", fx, fam, ov, "ppm", ["106"], ["215"], "flow", cruzado_correction=True))
    got = {(r.product_code, r.variable_code): r for r in s.collect()}
    assert got[("2670", "105")].measure_kind == "stock" and got[("2670", "105")].qty_base == 120
    assert got[("2682", "106")].family == "volume" and got[("2682", "106")].qty_base == 5
    assert got[("2685", "106")].qty_base == 36000 and got[("2685", "106")].numeric_value == 3
    assert abs(got[("2687", "106")].qty_base - 2) < 1e-9 and got[("2687", "106")].numeric_value == 2000
    v = got[("2682", "215")]
    assert v.is_monetary_value and v.family is None and v.qty_base is None and v.numeric_value == 100000


def test_g1_deflation_and_fx(spark):
    silver = _bronze(spark, [
        ("2000", "1", "Foo - SP", "0001", "Açaí", "145", "Valor", "Mil Reais", "1", "Município"),
        ("2000", "1", "Foo - SP", "0001", "Açaí", "144", "Quantidade", "Toneladas", "5", "Município"),
    ])
    s = survey_silver(silver, "prod_codigo", "prod", seeds.currency_factors(spark), seeds.unit_families(spark),
                      seeds.product_unit_factors(spark), "pevs")
    index = spark.createDataFrame(
        [("433", dt.date(2000, 12, 1), 2000, 12, 100.0), ("433", dt.date(2024, 12, 1), 2024, 12, 300.0)],
        "series_code string, reference_date date, reference_year int, reference_month int, index_value double")
    fx = spark.createDataFrame(
        [("USD", dt.date(2000, 6, 1), 2000, 6, 2.0), ("USD", dt.date(2024, 6, 1), 2024, 6, 5.0)],
        "currency string, reference_date date, reference_year int, reference_month int, brl_per_foreign_unit double")
    g = survey_gold(s, index, fx).collect()
    assert len(g) == 1
    r = g[0]
    assert r.val_yearfx_brl == 1000 and r.val_yearfx_usd == 500
    assert r.val_real_ipca_brl == 3000 and r.val_real_ipca_usd == 600
    assert r.val_yearfx_eur is None and r.state_name == "São Paulo" and r.region == "Sudeste"
    assert r.data_quality_flag == "OK" and r.reference_date == dt.date(2000, 12, 31)


def test_crop_areas_and_1985_currency(spark):
    def city(year, code, unit, planted, harvested, qty, value):
        return [(year, code, "Foo - SP", "7", "Milho - grão ", v, "x", u, x, "Município") for v, u, x in (
            ("8331", "Hectares", planted), ("216", "Hectares", harvested), ("112", "Quilogramas por Hectare", "-"),
            ("214", "Toneladas", qty), ("215", unit, value))]

    rows = (city("1985", "1", "Mil Cruzeiros", "10", "10", "5", "2") + city("1984", "1", "Mil Cruzeiros", "10", "12", "5", "2")
            + city("2000", "2", "Mil Reais", "10", "...", "...", "...") + city("2000", "3", "Mil Reais", "...", "...", "...", "..."))
    silver = crop_silver(_bronze(spark, rows), "prod_codigo", "prod", seeds.currency_factors(spark), seeds.unit_families(spark),
                         seeds.product_unit_factors(spark))
    index = spark.createDataFrame(
        [("433", dt.date(2000, 12, 1), 2000, 12, 100.0)],
        "series_code string, reference_date date, reference_year int, reference_month int, index_value double")
    fx = spark.createDataFrame(
        [("USD", dt.date(2000, 6, 1), 2000, 6, 2.0)],
        "currency string, reference_date date, reference_year int, reference_month int, brl_per_foreign_unit double")
    got = {(r.reference_year, r.city_code): r for r in crop_gold(silver, index, fx).collect()}
    # a yield alone does not keep a cell: 2000/3 has no quantity, value or area
    assert set(got) == {(1985, "1"), (1984, "1"), (2000, "2")}
    a, b = got[1985, "1"], got[1984, "1"]
    assert abs(a.val_yearfx_brl / b.val_yearfx_brl - 1000) < 1e-9 and a.val_yearfx_usd is None
    assert (a.data_quality_flag, b.data_quality_flag) == ("OK", "AREA_INCONSISTENT")
    assert a.product_description == "Milho - grão" and a.yield_kg_ha == 0.0
    assert got[2000, "2"].data_quality_flag == "INCOMPLETE" and got[2000, "2"].area_planted_ha == 10


def test_livestock_stock_rows_lack_no_value(spark):
    herd = _bronze(spark, [("2000", "1", "Foo - SP", "2670", "Bovino", "105", "x", "Cabeças", "120", "Município"),
                           ("2000", "1", "Foo - SP", "2671", "Suíno", "105", "x", "Cabeças", "...", "Município")])
    animal = _bronze(spark, [("2000", "1", "Foo - SP", "2682", "Leite", "106", "x", "Mil litros", "5", "Município"),
                             ("2000", "1", "Foo - SP", "2687", "Mel", "215", "x", "Mil Reais", "1", "Município")])
    silver = livestock_silver(herd, animal, "prod_codigo", "prod", seeds.currency_factors(spark), seeds.unit_families(spark),
                              seeds.product_unit_factors(spark))
    index = spark.createDataFrame(
        [("433", dt.date(2000, 12, 1), 2000, 12, 100.0)],
        "series_code string, reference_date date, reference_year int, reference_month int, index_value double")
    fx = spark.createDataFrame(
        [("USD", dt.date(2000, 6, 1), 2000, 6, 2.0)],
        "currency string, reference_date date, reference_year int, reference_month int, brl_per_foreign_unit double")
    got = {r.product_code: (r.measure_kind, r.data_quality_flag, r.val_yearfx_usd) for r in livestock_gold(silver, index, fx).collect()}
    assert got == {"2670": ("stock", "OK", None), "2682": ("flow", "MISSING_VALUE", None), "2687": ("flow", "MISSING_QUANTITY", 500.0)}


def test_index_and_fx_from_strings(spark):
    schema = "series_code string, series_name string, currency string, reference_date_str string, value_str string, ingestion_timestamp timestamp"
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    b = spark.createDataFrame([
        ("433", "IPCA", None, "01/01/2020", "1,0", t1), ("433", "IPCA", None, "01/01/2020", "10,0", t2),
        ("433", "IPCA", None, "01/02/2020", "...", t1), ("433", "IPCA", None, "01/03/2020", "10", t1),
        ("433", "IPCA", None, "31/02/2020", "50", t1), ("999", "old", None, "01/01/2020", "50", t1)], schema)
    got = [(r.reference_month, round(r.index_value, 6)) for r in index_silver(b).orderBy("reference_date").collect()]
    assert got == [(1, 110.0), (3, 121.0)]
    assert series_codes("1:USD, 21619:EUR,, ") == ["1", "21619"]
    b = spark.createDataFrame([
        ("1", None, "USD", "02/01/2020", "5,25", t1), ("1", None, "USD", "03/01/2020", "X", t1), ("5", None, "GBP", "02/01/2020", "7", t1)], schema)
    assert [(r.currency, r.brl_per_foreign_unit) for r in fx_silver(b).orderBy("reference_date").collect()] == [("USD", 5.25), ("USD", None)]


LOG_SCHEMA = ("codigo_produto string, banco string, agrupamento string, descricao_produto string, ciclo_de_vida string, "
              "ingestao string, visibilidade string, active boolean, edited_at timestamp, change_id string")


def _ts(d):
    return dt.datetime(2026, 1, d)


def test_g4_hidden_registry(spark):
    H, V = "Fazer Ingestão mas deixar indisponível", "Fazer Ingestão e deixar disponível"
    rows = [
        ("11", "pevs", "g", "d", V, None, None, True, _ts(1), "a"),
        ("22", "pevs", "g", "d", H, None, None, True, _ts(1), "a"),
        ("33", "pevs", "g", "d", None, None, "oculto", True, _ts(1), "a"),
        ("33", "pevs", "g", "d", None, None, "oculto", False, _ts(2), "b"),
        ("44", "pevs", "g", "d", V, None, None, True, _ts(1), "a"),
        ("44", "pevs", "g", "d", None, None, "oculto", True, _ts(2), "b"),
        ("55", "comex", "g", "d", None, None, "visivel", True, _ts(1), "a"),
        ("66", "comex", "g", "d", None, None, "oculto", True, _ts(1), "a"),
        ("77", "comex", "g", "d", None, "pausada", "visivel", True, _ts(1), "a"),
        ("88", "comex", "g", "d", None, "pausada", "oculto", True, _ts(1), "a"),
        ("99", "comex", None, None, None, None, None, True, _ts(1), "a"),
    ]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    got = sorted((r.banco, r.codigo_produto) for r in scd.hidden_registry(log).collect())
    assert got == [("comex", "66"), ("comex", "88"), ("pevs", "22"), ("pevs", "44")]


def test_g5_current_catalog(spark):
    rows = [
        ("11", "pevs", "Açaí", "d", None, None, None, True, _ts(1), "a"),
        ("22", "pevs", "Velho", "d", None, None, None, True, _ts(1), "a"),
        ("22", "pevs", "Castanha-do-pará", "d", None, None, None, True, _ts(2), "b"),
        ("33", "pevs", "X", "d", None, None, None, True, _ts(1), "a"),
        ("33", "pevs", "X", "d", None, None, None, False, _ts(2), "b"),
        ("44", "pevs", "Y", "d", None, None, None, True, _ts(1), "a"),
        ("44", "pevs", "Y", "d", None, None, None, False, _ts(2), "b"),
        ("44", "pevs", "Reativado", "d", None, None, None, True, _ts(3), "c"),
        ("55", "pevs", "Perde", "d", None, None, None, True, _ts(1), "a1"),
        ("55", "pevs", "Vence", "d", None, None, None, True, _ts(1), "z9"),
    ]
    cur = scd.current_catalog(spark.createDataFrame(rows, LOG_SCHEMA))
    got = {r.codigo_produto: r.agrupamento for r in cur.collect()}
    assert got == {"11": "Açaí", "22": "Castanha-do-pará", "44": "Reativado", "55": "Vence"}


def test_growth_and_share_are_percent_and_refetch_counts_its_years(spark):
    """Growth and market share in percent; a batch of the year end - n is still refetched."""
    from strata.operators.incremental import scope_growth
    from strata.operators.gate import oversize_scope, resolve_scope
    from strata.operators.series import yoy
    from strata.plans.analyses import market_share

    s = spark.createDataFrame([("x", 2000, 10.0), ("x", 2001, 15.0), ("x", 2002, 0.0), ("x", 2003, 5.0)], "k string, y int, v double")
    assert [r.yoy for r in yoy(s, ["k"], "y", "v").orderBy("y").collect()] == [None, 50.0, -100.0, 0.0]
    country, world = (spark.createDataFrame([(2001, v)], "y int, v double") for v in (25.0, 100.0))
    settled = spark.createDataFrame([(2001, 3)], "settled_year int, max_reporters int")
    assert [r.share for r in market_share(country, world, settled, "y", "v").collect()] == [25.0]
    man = spark.createDataFrame([("b0", 2021, ["a"]), ("b1", 2022, ["a"]), ("b2", 2024, ["a"])], "batch_id string, year int, scope array<string>")
    codes = spark.createDataFrame([("a",)], "code string")
    assert {r.batch_id for r in scope_growth(man, codes, "scope", "year", "code", 2024).collect()} == {"b1", "b2"}
    cat = spark.createDataFrame([(str(i), None) for i in range(30)], "code string, ingestao string")
    scope = resolve_scope(cat, codes, "code")
    assert scope.count() == 30 and oversize_scope(scope, 10).count() == 1 and oversize_scope(scope, 30).count() == 0
    assert [r.origin for r in resolve_scope(cat.limit(0), codes, "code").collect()] == ["configured"]


def test_export_coefficient_over_the_common_window(spark):
    """Per year on common years; per state cumulative from the first to the last common year; 0 over nothing produced."""
    from strata.plans.analyses import export_coefficient

    produced = spark.createDataFrame([("PA", 2000, 900.0), ("PA", 2001, 100.0), ("PA", 2003, 300.0), ("AM", 2002, 50.0)], "uf string, year int, produced double")
    exported = spark.createDataFrame([("PA", 2001, 40.0), ("SP", 2001, 10.0), ("PA", 2003, 60.0), ("PA", 2004, 500.0)], "uf string, year int, exported double")
    got = {(r.scope, r.uf, r.year): (r.produced, r.exported, r.coefficient) for r in export_coefficient(produced, exported, "uf", "year").collect()}
    assert got == {
        ("year", None, 2001): (100.0, 50.0, 50.0), ("year", None, 2003): (300.0, 60.0, 20.0),
        ("state", "PA", None): (400.0, 100.0, 25.0), ("state", "AM", None): (50.0, 0.0, 0.0), ("state", "SP", None): (0.0, 10.0, 0.0),
        ("national", None, None): (450.0, 110.0, 110.0 / 450.0 * 100),
    }
    assert export_coefficient(produced, exported.filter("year = 2004"), "uf", "year").count() == 0


def test_premium_needs_two_priced_levels(spark):
    from strata.plans.analyses import discrepancy_pct, predominant, processing_premium

    rank = {"raw": 1, "sawn": 2, "made": 3}
    rows = [(2000, "raw", 9.0), (2000, "made", 90.0), (2001, "raw", 2.0), (2001, "sawn", 5.0), (2001, "made", 0.0)]
    lv = spark.createDataFrame(rows, "year int, level string, unit_price double")
    assert processing_premium(lv, "year", "level", rank).collect() == [(2001, "sawn", "raw", 2.5)]
    one = lv.filter("unit_price <> 5.0")
    assert [(r.year, r.premium) for r in processing_premium(one, "year", "level", rank).collect()] == [(2001, 0.0)]
    v = spark.createDataFrame([(2000, "raw", 30.0), (2000, "made", 10.0), (2001, "raw", 0.0)], "year int, level string, value double")
    assert {r.year: r.share for r in predominant(v, "year", "level").collect()} == {2000: 75.0, 2001: 0.0}
    d = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0)], "a double, b double").select(discrepancy_pct(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in d.collect()] == [100.0, 0.0]


def test_choropleth_bucket_floors_the_max_and_clamps(spark):
    from strata.functions.columns import choropleth_bucket

    d = spark.createDataFrame([(0.5, 0.5), (3.0, 5.0), (9.0, 5.0), (5.0, 5.0), (0.0, 5.0), (None, 5.0)], "v double, m double")
    assert [r.b for r in d.select(choropleth_bucket("v", "m", 6).alias("b")).collect()] == [2, 3, 5, 5, None, None]


def test_month_profile_averages_calendar_months_over_the_years(spark):
    from strata.plans.analyses import month_matrix, month_profile

    rows = [(2000, m, 10.0) for m in range(1, 13)] + [(2001, 3, 50.0), (2001, 5, 0.0)]
    d = spark.createDataFrame(rows, "year int, month int, v double")
    got = {r.month: r for r in month_profile(d, "year", "month", "v").collect()}
    assert {m: r.mean_value for m, r in got.items()} == {m: 30.0 if m == 3 else 5.0 if m == 5 else 10.0 for m in range(1, 13)}
    assert (got[1].peak_month, got[1].trough_month, got[1].amplitude) == (3, 5, 6.0)
    assert [tuple(r)[1:] for r in month_matrix(d.filter("year = 2001"), "year", "month", "v").collect()] == [(0.0, 0.0, 50.0, *[0.0] * 9)]
    none = month_profile(d.limit(0), "year", "month", "v").collect()
    assert len(none) == 12 and {(r.mean_value, r.amplitude) for r in none} == {(0.0, 0.0)}
