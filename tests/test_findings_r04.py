"""Work files on disk: one Gold at a time, shuffle files freed, lines dealt by order and by part alone."""

import glob
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.plans import serving, twins_crops, twins_golds, twins_pipelines
from strata.session import Built, ensure_checkpoint_dir, stored, stored_alone
from tests.test_findings_r03 import SF, plan


def folders(spark, name: str) -> list[str]:
    return glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/strata/{name}-*")


def test_what_was_stored_on_the_way_is_removed(spark):
    def build():
        return stored(spark.range(5), "way_one").join(stored(spark.range(3, 9), "way_two"), "id")

    d = stored_alone(spark, build, "end_of_way")
    assert not folders(spark, "way_one") + folders(spark, "way_two") and len(folders(spark, "end_of_way")) == 1
    assert sorted(r.id for r in d.collect()) == [3, 4]
    assert stored(spark.range(2), "way_three").count() == 2 and folders(spark, "way_three")  # none other is


def test_inner_result_is_on_the_way_of_the_outer(spark):
    d = stored_alone(spark, lambda: stored_alone(spark, lambda: stored(spark.range(4), "way_deep"), "way_inner").filter("id > 1"), "way_outer")
    assert not folders(spark, "way_deep") + folders(spark, "way_inner") and d.count() == 2


def test_shuffle_files_go_with_the_write(spark):
    def shuffles() -> set[str]:
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in blocks.mkString(" ").split() if x.startswith("shuffle_")}

    before = shuffles()
    d = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "freed")
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and d.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


@pytest.fixture()
def one_at_a_time(spark):
    """Golds that are stored as they are built, and the work folders each finds when it is built."""
    found = []

    def built(word: str, code: str, rows: list[tuple]):
        def build():
            found.append(folders(spark, "work"))
            return stored(spark.createDataFrame(rows, f"{code} string, data_quality_flag string"), f"work-{word}")
        return build

    golds = Built({"pevs": built("pevs", "product_code", [("1", "OK"), ("1", "OK"), ("9", "OK"), (None, None)]),
                   "pam": built("pam", "product_code", []), "comtrade": built("comtrade", "cmd_code", [("000001", "MISSING_VALUE")])})
    return golds, found


def test_quality_holds_one_gold_at_a_time(spark, one_at_a_time):
    golds, found = one_at_a_time
    d = serving.gold_quality(golds, spark.createDataFrame([("pevs", "9")], "source string, code string"))
    assert found == [[], [], []] and not folders(spark, "work")
    assert sorted((r.source, r.data_quality_flag or "", r.n_rows, round(r.share, 3)) for r in d.collect()) == [
        ("ibge_pevs", "", 1, 0.333), ("ibge_pevs", "OK", 2, 0.667), ("un_comtrade", "MISSING_VALUE", 1, 1.0)]


def test_bridge_holds_one_gold_at_a_time(spark, one_at_a_time):
    golds, found = one_at_a_time
    catalog = [("pevs", "1", "a", "A"), ("pam", "1", "a", "A"), ("comtrade", "000001", "b", "B")]
    bridge, _ = serving.product_bridge(golds, spark.createDataFrame(catalog, "source string, code string, group_id string, group_name string"))
    assert found == [[], [], []] and not folders(spark, "work")
    assert sorted(map(tuple, bridge.select("source", "code", "group_id").collect())) == [("comtrade", "000001", "b"), ("pevs", "1", "a")]


def test_golds_are_built_when_they_are_asked_for(spark):
    before = folders(spark, "bronze_comex")
    golds = twins_golds.golds(spark, SF, outliers=False)
    assert list(golds) == ["pevs", "pam", "ppm", "comex", "comtrade"] and folders(spark, "bronze_comex") == before


def test_lines_are_dealt_by_order_and_by_part_alone(spark):
    def dealings(d) -> list[str]:
        return [line for line in plan(d).splitlines() if "hashpartitioning" in line]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bronze = twins_pipelines.comex_bronze(spark, SF)
        p = plan(bronze)
        assert "lines_bought" in p and not any("custkey" in x or "orderkey" in x for x in dealings(bronze))
        assert sum("lines_bought" in x for x in p.splitlines() if "Location" in x) == 1  # both deliveries from one aggregation
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "crop_cells" in plan(twins_crops.crop_bronze(spark, SF))


def test_trade_bronze_of_repeated_missing_and_odd_keys(tmp_path, spark):
    con = duckdb.connect()
    tables = {
        "customer(c_custkey, c_nationkey)": "(1::BIGINT, 3), (1, 4), (2, NULL), (3, 1234), (NULL, 5), (4, 1235)",
        "orders(o_orderkey, o_custkey)": "(10::BIGINT, 1::BIGINT), (10, 2), (11, 3), (12, NULL), (NULL, 1), (13, 4)",
        "supplier(s_suppkey, s_nationkey)": "(5::BIGINT, 7), (6, 8), (5, 34), (NULL, 1)",
        "part(p_partkey, p_brand, p_size)": "(20::BIGINT, 'Brand#11', 3), (20, 'Brand#12', 9), (21, NULL, 9), (22, 'Brand#1234567890', NULL), (NULL, 'Brand#13', 9)",
        "lineitem(l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)":
            ", ".join(f"({o}::BIGINT, {p}::BIGINT, {s}::BIGINT, {q}::DOUBLE, {100 + q}.37::DOUBLE, {d}::DOUBLE, 0.04::DOUBLE, {f}, {u}, {at}::TIMESTAMP)"
                      for o, p, s, q, d, f, u, at in [
                          (10, 20, 5, 1, 0.05, "'A'", "'F'", "'2001-03-31 23:59:59'"), (10, 20, 5, 1, 0.05, "'A'", "'F'", "'2001-03-31 23:59:59'"),
                          (11, 20, 5, 2, 0.1, "'R'", "'O'", "'2001-03-01'"), (10, 21, 6, 4, 0.09, "'N'", "'F'", "'2001-12-31'"),
                          (11, 22, 5, 8, "NULL", "NULL", "NULL", "NULL"), (13, 20, 5, 16, 0.0, "'N'", "'F'", "'2001-01-15'"),
                          (12, 20, 5, 32, 0.0, "'A'", "'F'", "'2001-01-15'"), ("NULL", 20, 5, 64, 0.0, "'A'", "'F'", "'2001-01-15'"), (13, "NULL", 5, 3, 0.0, "'A'", "'F'", "'2001-01-15'")])}
    for head, rows in tables.items():
        con.execute(f"CREATE TABLE {head.partition('(')[0]} AS SELECT * FROM (VALUES {rows}) {head}")
        con.execute(f"COPY {head.partition('(')[0]} TO '{tmp_path}/{head.partition('(')[0]}.parquet' (FORMAT PARQUET)")
    states = ", ".join(f"'{a}'" for a, _, _ in twins_pipelines.STATES)
    joined = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""
    cents = "sum(round(l_extendedprice * (1 - l_discount) * 100))::BIGINT"
    flow = "CASE WHEN l_returnflag IN ('A', 'N') THEN 'EXP' WHEN l_returnflag = 'R' THEN 'IMP' END"
    unit = "CASE l_linestatus WHEN 'F' THEN '10' WHEN 'O' THEN '11' END"
    first = f"""SELECT {flow} flow, year(l_shipdate)::VARCHAR y, lpad(month(l_shipdate)::VARCHAR, 2, '0') m, lpad(substr(p_brand, 7, 10), 8, '0') ncm, {unit} u,
        lpad(c_nationkey::VARCHAR, 3, '0') pais, list_extract([{states}], s_nationkey % 27 + 1) uf, sum(l_quantity)::BIGINT::VARCHAR q, floor({cents} / 100)::BIGINT::VARCHAR fob FROM {joined} GROUP BY ALL"""
    want = con.execute(f"WITH a AS ({first}) SELECT *, 1 AS n FROM a UNION ALL SELECT *, 2 FROM a WHERE flow = 'EXP' AND y = '2001' AND u = '10'").fetchall()
    got = twins_pipelines.comex_bronze(spark, str(tmp_path)).select("flow", "CO_ANO", "CO_MES", "CO_NCM", "CO_UNID", "CO_PAIS", "SG_UF_NCM", "QT_ESTAT", "VL_FOB", F.month("ingestion_timestamp")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 6

    first = f"""SELECT year(l_shipdate)::VARCHAR y, s_nationkey::VARCHAR r, CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'R' THEN 'M' WHEN 'N' THEN 'RX' END f, c_nationkey::VARCHAR p,
        CASE WHEN p_size <= 5 THEN lpad(substr(p_brand, 7, 10), 4, '0') ELSE lpad(substr(p_brand, 7, 10), 6, '0') END cmd, CASE WHEN l_linestatus = 'F' THEN '8' ELSE '-1' END u,
        CASE WHEN l_discount >= 0.09 THEN 'C01' ELSE 'C00' END c, (sum(l_quantity)::BIGINT * 10)::VARCHAR w, floor({cents} / 100)::BIGINT::VARCHAR fob FROM {joined} GROUP BY ALL"""
    want = con.execute(f"WITH a AS ({first}) SELECT *, 1 AS n FROM a UNION ALL SELECT *, 2 FROM a WHERE y = '2001' AND r = '7' AND f <> 'M'").fetchall()
    got = twins_pipelines.comtrade_bronze(spark, str(tmp_path)).select("refYear", "reporterCode", "flowCode", "partnerCode", "cmdCode", "qtyUnitCode", "customsCode", "netWgt", "fobvalue", F.month("ingestion_timestamp")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 6
