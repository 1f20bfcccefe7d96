"""Trade pipelines on small fixtures (national and bilateral)."""

import datetime as dt

from strata.plans.trade import comex_gold, comex_silver, comtrade_silver
from strata.sources import seeds

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
COMEX_COLS = ("flow string, CO_ANO string, CO_MES string, CO_NCM string, CO_UNID string, CO_PAIS string, SG_UF_NCM string, "
              "CO_VIA string, CO_URF string, QT_ESTAT string, KG_LIQUIDO string, VL_FOB string, VL_FRETE string, "
              "VL_SEGURO string, ingestion_timestamp timestamp")


def _comex(spark):
    rows = [
        # (flow, 2020) first delivery: two rows; the second delivery restates one and retracts the other.
        ("EXP", "2020", "01", "12010010", "10", "160", "SP", "01", "1", "100", "1000", "500", None, None, T1),
        ("EXP", "2020", "01", "08011100", "10", "160", "SP", "01", "1", "5", "50", "20", None, None, T1),
        ("EXP", "2020", "01", "12010010", "10", "160", "SP", "01", "1", "120", "1200", "600", None, None, T2),
        ("EXP", "2020", "01", "12010010", "11", "160", "SP", "01", "1", "300", "-", "40", None, None, T2),
        ("EXP", "2020", "13", "12010010", "10", "160", "SP", "01", "1", "1", "1", "1", None, None, T2),  # bad month
        # (flow, 2021) single delivery kept.
        ("IMP", "2021", "02", "08011100", "10", "249", "RJ", "04", "2", "...", "70", "30", "1,5", "0,5", T1),
    ]
    return spark.createDataFrame(rows, COMEX_COLS)


def test_comex_silver_batch_replacement_and_lookups(spark):
    units = spark.createDataFrame([("10", "Quilograma Liquido", "kg"), ("11", "Tonelada", "t")],
                                  "co_unid string, unit_name string, unit_symbol string")
    succ = spark.createDataFrame([("12010010", "12011000", "soja")], seeds.SUCCESSION_SCHEMA)
    s = comex_silver(_comex(spark), units, seeds.unit_families(spark), seeds.product_unit_factors(spark), succ)
    rows = sorted((r.flow, r.reference_year, r.ncm_code, r.ncm_code_reported, r.stat_unit_code, r.qty_native,
                   r.qty_base, r.family, r.net_weight_kg) for r in s.collect())
    assert rows == [
        ("EXP", 2020, "12011000", "12010010", "10", 120.0, 0.12, "massa", 1200.0),
        ("EXP", 2020, "12011000", "12010010", "11", 300.0, 300.0, "massa", None),
        ("IMP", 2021, "08011100", "08011100", "10", None, None, "massa", 70.0),
    ]


def test_comex_gold_dominant_unit_and_monthly_deflation(spark):
    units = spark.createDataFrame([("10", "Quilograma Liquido", "kg"), ("11", "Tonelada", "t")],
                                  "co_unid string, unit_name string, unit_symbol string")
    succ = spark.createDataFrame([], seeds.SUCCESSION_SCHEMA)
    s = comex_silver(_comex(spark), units, seeds.unit_families(spark), seeds.product_unit_factors(spark), succ)
    index = spark.createDataFrame(
        [("433", dt.date(2020, 1, 1), 2020, 1, 100.0), ("433", dt.date(2024, 6, 1), 2024, 6, 200.0)],
        "series_code string, reference_date date, reference_year int, reference_month int, index_value double")
    fx = spark.createDataFrame(
        [("USD", dt.date(2020, 1, 10), 2020, 1, 4.0), ("USD", dt.date(2020, 1, 20), 2020, 1, 6.0),
         ("USD", dt.date(2024, 6, 1), 2024, 6, 5.0)],
        "currency string, reference_date date, reference_year int, reference_month int, brl_per_foreign_unit double")
    g = {r.flow: r for r in comex_gold(s, index, fx).collect()}
    e = g["EXP"]
    # Dominant unit: the row with the largest quantity (300 t) -> unit 11; qty summed over that unit only.
    assert (e.stat_unit_code, e.qty_native, e.family) == ("11", 300.0, "massa")
    assert e.val_fob_usd == 640.0 and e.net_weight_kg == 1200.0 and e.source_rows == 2
    assert e.val_yearfx_brl == 640.0 * 5.0 and e.val_real_ipca_brl == 640.0 * 5.0 * 2.0
    assert e.val_real_ipca_usd == e.val_real_ipca_brl / 5.0 and e.data_quality_flag == "OK"
    assert g["IMP"].data_quality_flag == "OK" and g["IMP"].state_name == "Rio de Janeiro"


COMTRADE_COLS = ("refYear string, reporterCode string, flowCode string, partnerCode string, partner2Code string, "
                 "cmdCode string, customsCode string, mosCode string, motCode string, qtyUnitCode string, qty string, "
                 "netWgt string, grossWgt string, primaryValue string, cifvalue string, fobvalue string, "
                 "ingestion_timestamp timestamp")


def test_comtrade_totals_only_and_tie_breaks(spark):
    base = ("2020", "76", "X", "156", "0", "080111", "C00", "0", "0")
    rows = [
        (*base, "-1", "10", "10", "11", "100", None, "100", T1),
        (*base, "8", "10", "10", "11", "100", None, "100", T1),           # same key: real unit wins over -1
        ("2020", "76", "X", "0", "0", "080111", "C00", "0", "0", "8", "1", "1", "1", "1", None, "1", T1),   # World
        ("2020", "76", "X", "156", "0", "0801", "C00", "0", "0", "8", "1", "1", "1", "1", None, "1", T1),   # HS4
        ("2020", "76", "X", "156", "0", "080111", "C01", "0", "0", "8", "1", "1", "1", "1", None, "1", T1), # breakdown
        ("2020", "76", "RX", "156", "0", "080111", "C00", "0", "0", "8", "1", "1", "1", "1", None, "1", T1),# sub-flow
        ("1999", "76", "X", "156", "0", "080111", "C00", "0", "0", "8", "1", "1", "1", "1", None, "1", T1), # too old
        ("2020", "76", "M", "156", "0", "440710", "C00", "0", "0", "8", "0.0", "0.0", "5", "50", "55", None, T1),
    ]
    units = spark.createDataFrame([("8", "Weight in kilograms", "kg", "kg"), ("-1", "No quantity", "", "")],
                                  "qty_unit_code string, unit_name string, unit_symbol string, unit_raw string")
    succ = spark.createDataFrame([], seeds.SUCCESSION_SCHEMA)
    s = comtrade_silver(spark.createDataFrame(rows, COMTRADE_COLS), units, seeds.unit_families(spark), succ)
    got = sorted((r.flow, r.cmd_code, r.qty_unit_code, r.qty_native, r.net_weight_kg, r.family, r.qty_base)
                 for r in s.collect())
    assert got == [("export", "080111", "8", 10.0, 10.0, "massa", 0.01),
                   ("import", "440710", "8", None, None, "massa", None)]
