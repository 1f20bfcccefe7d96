"""Work that grows with the input: what is stored once, dealt to several tasks, or compared whole."""

import contextlib
import glob
import io
import math
import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.functions.columns import STATES, state_name, state_region, wtrim
from strata.operators import quality
from strata.plans import serving, twins_crops, twins_pipelines
from strata.plans.inputs import fx_series, index_series, orders_daily
from strata.plans.survey import crop_gold, crop_silver, survey_silver
from strata.sources import seeds
from strata.sources.bronze import append_bronze

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_reconcile_compares_the_snapshot_and_the_delivery(tmp_path, spark):
    rows = "(11, 'N', 5.0, TIMESTAMP '1999-01-01'), (12, 'R', 4.0, TIMESTAMP '1999-01-01'), (13, 'N', 3.0, TIMESTAMP '2001-05-01'), (14, 'N', 1.0, TIMESTAMP '1999-01-01'), (14, 'R', 2.0, TIMESTAMP '1999-01-01')"
    duckdb.sql(f"SELECT * FROM (VALUES {rows}) t(l_orderkey, l_returnflag, l_quantity, l_shipdate)").write_parquet(str(tmp_path / "lineitem.parquet"))
    got = E.queries()["reconcile_cells"](spark, str(tmp_path)).first().asDict()
    assert (got["compared"], got["diverged"], got["only_source"], got["only_live"]) == (2, 1, 1, 1)
    assert (got["delivery_compared"], got["delivery_diverged"], got["delivery_only_source"], got["delivery_only_live"]) == (3, 1, 1, 1)


def test_a_large_folder_of_bronze_is_written_by_several_tasks(tmp_path, spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    d = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(2001).alias("year"),
                                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ingestion_timestamp"))
    spark.conf.set(key, "1m")
    try:
        append_bronze(d, str(tmp_path / "b"), "year")
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{tmp_path}/b/ingestion_date=*/year=2001/*.parquet")) > 1
    assert spark.read.parquet(str(tmp_path / "b")).count() == 200_000


def test_percentiles_of_logs_are_exact(spark):
    r = random.Random(1)
    rows = [(k, x) for k, n in (("a", 4000), ("b", 7), ("c", 1), (None, 5)) for x in [math.log(r.uniform(1e-9, 1e9)) for _ in range(n)]]
    rows += [("a", None), ("b", 0.0), ("d", 3.5), ("d", 3.5), ("e", 1.0), ("e", 1.0 + 1e-9), ("e", 1.0 + 2e-9)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p50": 0.5, "p75": 0.75}
    narrowed = quality.log_percentiles(df, ["k"], "v", probs, count="n")
    assert sorted(map(tuple, narrowed.collect())) == sorted(map(tuple, quality.exact_percentiles(df, ["k"], "v", probs, count="n").collect()))


def test_gold_is_built_once_for_its_levels_and_its_rows(spark):
    p = plan(E.queries()["survey_pipeline"](spark, SF))
    assert "gold_base" in p and "bronze_survey" not in p


def test_gold_facts_read_once_are_not_written_in_between(spark):
    assert "gold_pevs_production" not in "".join(line for line in plan(E.queries()["gold_source_metadata"](spark, SF)).splitlines() if "Location" in line)


def test_silver_and_its_pivot_share_one_dealing_of_the_rows(spark):
    daily = orders_daily(spark, SF)
    silver = crop_silver(twins_crops.crop_bronze(spark, SF), "prod_codigo", "prod", seeds.currency_factors(spark), seeds.unit_families(spark), seeds.product_unit_factors(spark))
    p = plan(crop_gold(silver, index_series(spark, SF, daily), fx_series(spark, SF, daily), outliers=False, dealt=True))
    dealt = [line for line in p.splitlines() if "hashpartitioning" in line and ("municipio_codigo" in line or "city_code" in line)]
    assert len(dealt) == 1 and "_year" in dealt[0]


def test_latest_wins_of_one_cell_goes_by_year_text_variable_and_unit(spark):
    rows = [("2000", "1", "A - SP", "5", "p", "144", "Toneladas", "1", 1), ("2000", "1", "B - SP", "5", "p", "144", " toneladas ", "2", 2),
            ("2000", "1", "B - SP", "5", "p", "145", "Mil Reais", "3", 1), (" 2000", "1", "B - RJ", "5", "p", "144", "Toneladas", "4", 1),
            ("x", "1", "B - RJ", "5", "p", "144", "Toneladas", "5", 1), (None, "1", "B - RJ", "5", "p", "144", "Toneladas", "6", 1)]
    b = spark.createDataFrame(rows, "ano string, municipio_codigo string, municipio string, prod_codigo string, prod string, variavel_codigo string, unidade_de_medida string, valor string, n int").selectExpr(
        "*", "'Município' AS nivel_territorial", "'' AS variavel", "timestamp_seconds(n) AS ingestion_timestamp")
    s = survey_silver(b, "prod_codigo", "prod", seeds.currency_factors(spark), seeds.unit_families(spark), seeds.product_unit_factors(spark), "pevs")
    got = sorted((r.reference_year or 0, r.state_acronym, r.variable_code, r.numeric_value) for r in s.collect())
    assert [x[:3] for x in got] == [(0, "RJ", "144"), (0, "RJ", "144"), (2000, "RJ", "144"), (2000, "SP", "144"), (2000, "SP", "145")]
    assert [x[3] for x in got[:4]] == [5.0, 6.0, 4.0, 2.0]


def test_mart_counts_cities_beside_its_sums(spark):
    r = random.Random(2)
    rows = [(r.choice([1999, 2000, None]), r.choice(["SP", "RJ", None]), r.choice(["1", "2"]), r.choice(["massa", None]), r.choice(["a", "b", None]),
             r.choice([None, *"12345"]), r.choice([None, 1.0, 2.0]), r.choice([None, 4.0])) for _ in range(500)]
    gold = spark.createDataFrame(rows, "reference_year int, state_acronym string, product_code string, family string, unit_native string, city_code string, qty_native double, val_yearfx_brl double")
    hidden = spark.createDataFrame([("pam", "2")], "source string, code string")
    cw = spark.createDataFrame([("pam", "1", "g", "G")], "source string, code string, group_id string, group_name string")
    grain = ["reference_year", "state_acronym", "product_code", "family"]
    m = serving.annual_mart(gold, "pam", "product_code", grain, ["unit_native"], ["qty_native"], hidden, cw, None, "city_code")
    columns = [*grain, "unit_native", "qty_native", "val_yearfx_brl", "n_cities", "source_rows"]
    want = gold.filter("product_code = '1'").groupBy(*grain).agg(
        F.max("unit_native").alias("unit_native"), F.sum("qty_native").alias("qty_native"), F.sum("val_yearfx_brl").alias("val_yearfx_brl"),
        F.count_distinct("city_code").alias("n_cities"), F.count(F.lit(1)).alias("source_rows"))
    rows = lambda d: sorted(map(repr, d.select(*columns).collect()))
    assert rows(m) == rows(want)
    assert "count(distinct" not in plan(m).lower()


def test_crop_mart_reads_its_pivot_and_no_second_copy(spark):
    p = plan(E.queries()["crop_serving_mart"](spark, SF))
    assert "gold_base" in p and "gold_crop" not in p


def test_trimmed_as_by_patterns(spark):
    texts = ["", " ", "a", " a ", "\t\n a b \r\f\x0b", "a \u0085", " a ", "a  ", " a ", "Mil Reais", "\u0085", " \n\u0085", None]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    by_pattern = F.regexp_replace(F.regexp_replace("x", r"^\s+", ""), r"\s+$", "")
    assert d.filter(~wtrim("x").eqNullSafe(by_pattern)).count() == 0


def test_survey_bronze_comes_from_one_aggregation(spark):
    p = plan(twins_pipelines.survey_bronze(spark, SF))
    assert sum("lineitem.parquet" in line for line in p.splitlines() if "Location" in line) == 1
    n = {r.variavel_codigo: (r.n, r.again) for r in twins_pipelines.survey_bronze(spark, SF).groupBy("variavel_codigo").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ingestion_timestamp") > F.lit("2024-01-15").cast("timestamp_ntz")).alias("again")).collect()}
    restated = twins_pipelines.survey_bronze(spark, SF).filter("ano = '2001' AND variavel_codigo = '145'").count()
    assert restated > 0 and n == {"144": (n["145"][0] + restated, restated), "145": (n["145"][0], 0)}


def test_survey_layers_are_built_without_a_written_bronze(spark):
    assert "bronze_survey" not in plan(twins_pipelines._survey_silver(spark, SF))


def test_code_of_the_gold_rows_is_short_enough_to_be_compiled(spark):
    buf = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(buf):
            twins_pipelines._survey_gold(spark, SF).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", buf.getvalue())]
    assert sizes and max(sizes) < 8000  # HotSpot interprets longer methods


def test_states_are_looked_up_as_listed(spark):
    want = {(a, n, r) for a, n, r in STATES} | {("EX", None, None), ("sp", None, None), (None, None, None)}
    d = spark.createDataFrame([(a,) for a, _, _ in want], "uf string")
    assert {tuple(x) for x in d.select("uf", state_name("uf"), state_region("uf")).collect()} == want
