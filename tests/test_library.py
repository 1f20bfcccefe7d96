"""Library pieces without a driver twin: SQL functions, landed readers,
archive bookkeeping, curation rules, streaming jobs."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.functions.sql import register_read_functions, register_sql_functions
from strata.operators import curation as K
from strata.operators import incremental as I
from strata.sources import bronze, landed, raw
from strata.sources.published import Published
from strata.streaming import jobs


def _tmp():
    return tempfile.mkdtemp(prefix="strata-test-")


def test_sql_functions_match_column_functions(spark):
    register_sql_functions(spark)
    vals = ["12,5", " 7 ", "\t3", "...", "-", "1d", "X", "", None, "2e2"]
    df = spark.createDataFrame([(v, uf) for v in vals for uf in ("SP", "AC", "ZZ")], "s string, uf string")
    df.createOrReplaceTempView("t_sql_fn")
    via_sql = spark.sql("SELECT s, uf, safe_numeric(s) a, safe_numeric_dash_zero(s) b, state_name(uf) n, "
                        "state_region(uf) r, catalog_visibilidade(NULL, 'Fazer Ingestão mas deixar indisponível') v, "
                        "catalog_ingestao(NULL) i FROM t_sql_fn")
    via_col = df.select("s", "uf", C.safe_numeric("s").alias("a"), C.safe_numeric("s", True).alias("b"),
                        C.state_name("uf").alias("n"), C.state_region("uf").alias("r"),
                        C.visibility_effective(F.lit(None).cast("string"), F.lit("Fazer Ingestão mas deixar indisponível")).alias("v"),
                        C.ingestion_effective(F.lit(None).cast("string")).alias("i"))
    assert sorted(map(tuple, via_sql.collect()), key=str) == sorted(map(tuple, via_col.collect()), key=str)
    assert spark.sql("SELECT data_quality_flag(1.0, NULL, NULL, NULL) f").first().f == "MISSING_VALUE"
    assert spark.sql("SELECT cruzado_factor(1985, ' Mil Cruzeiros ') f").first().f == 1000.0


def test_read_table_functions(spark):
    spark.createDataFrame([(2000, "SP", "a", 1.0, 1.0), (2001, "SP", "a", 2.0, 1.0), (2001, "AC", "b", 3.0, 1.0)],
                          "year int, state string, product string, value double, qty double").createOrReplaceTempView("mart_v")
    register_read_functions(spark, "mart_v")
    assert sorted(map(tuple, spark.sql("SELECT * FROM read_overview(2000, 2001)").collect())) == [(2000, 1.0, 1), (2001, 5.0, 2)]
    assert sorted(map(tuple, spark.sql("SELECT * FROM read_by_state_latest()").collect())) == [("AC", 3.0), ("SP", 2.0)]


def test_delimited_latin1_and_union(spark):
    d = _tmp()
    with open(os.path.join(d, "exp.csv"), "w", encoding="latin-1") as f:
        f.write("CO_ANO;CO_NCM;VL_FOB\n2020;08011100;12,5\n2020;0801;ção\n")
    e = landed.read_delimited(spark, d, ["CO_ANO", "CO_NCM", "VL_FOB"])
    rows = sorted(map(tuple, e.collect()))
    assert rows[0] == ("2020", "0801", "ção") and rows[1][1] == "08011100"
    imp = spark.createDataFrame([("2020", "0802", "1", "2")], "CO_ANO string, CO_NCM string, VL_FOB string, VL_FRETE string")
    u = landed.union_schemas([e, imp])
    assert u.filter(F.col("VL_FRETE").isNull()).count() == 2
    scoped = u.filter(landed.scope_filter("CO_NCM", exact=["08011100"], chapters=["08"]))
    assert scoped.count() == 3


def test_json_payloads(spark):
    d = _tmp()
    with open(os.path.join(d, "p1.json"), "w") as f:
        json.dump([{"D1C": "Ano", "V": "Valor", "MN": "Unidade de Medida"}, {"D1C": "2020", "V": "12", "MN": "Toneladas"}], f)
    body = landed.header_row_payload(spark, d)
    assert body.columns == ["ano", "unidade_de_medida", "valor"] or set(body.columns) == {"ano", "unidade_de_medida", "valor"}
    assert body.count() == 1
    s = _tmp()
    with open(os.path.join(s, "s.json"), "w") as f:
        json.dump([{"data": "01/01/2020", "valor": "0,5"}], f)
    sp = landed.series_payload(spark, s, "433", {"series_name": "IPCA"})
    assert sp.first().series_code == "433" and sp.first().series_name == "IPCA"
    tdir = _tmp()
    with open(os.path.join(tdir, "t.json"), "w") as f:
        json.dump({"data": [{"reporterCode": 76.0, "qtyUnitCode": "-1.0", "cmdCode": "0801"}]}, f)
    tp = landed.trade_payload(spark, tdir, ["reporterCode", "qtyUnitCode", "cmdCode"]).first()
    assert (tp.reporterCode, tp.qtyUnitCode, tp.cmdCode) == ("76", "-1", "0801")
    assert landed.normalise_header("Tipo de Produto Extrativo (Código)") == "tipo_de_produto_extrativo_codigo"


def test_flatten_mesh_refuses_short(spark):
    df = spark.createDataFrame([({"a": {"b": "x"}, "c": None},)], "r struct<a:struct<b:string>, c:string>")
    out = landed.flatten_mesh(df, {"name": ("r.c", "r.a.b")})
    assert out.first().name == "x"
    with pytest.raises(Exception, match="refusing a short result: 1 < 5000"):
        landed.flatten_mesh(df, {"name": ("r.c", "r.a.b")}, min_rows=5000).collect()


def test_archive_manifest_bookkeeping(spark):
    root = _tmp()
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    raw.archive_batch(df, root, "src", "ds", "b2", {"etag": '"x1"'}, ts)
    raw.archive_batch(df.limit(0), root, "src", "ds", "b1", {"etag": 'W/"weak"'}, ts)  # empty sentinel
    m = raw.read_manifest(spark, root)
    assert sorted((r.batch_id, r.rows) for r in m.collect()) == [("b1", 0), ("b2", 1)]
    assert [r.batch_id for r in raw.list_batches(m, "src", "ds").collect()] == ["b1", "b2"]
    loaded = spark.createDataFrame([("src", "ds", "b2")], "source string, dataset string, batch_id string")
    assert [r.batch_id for r in raw.pending_batches(m, loaded).collect()] == ["b1"]
    remote = spark.createDataFrame([("src", "ds", "b2", '"x1"'), ("src", "ds", "b1", 'W/"weak"')],
                                   "source string, dataset string, batch_id string, remote_etag string")
    cur = {r.batch_id: r.is_current for r in raw.etag_current(m, remote).collect()}
    assert cur == {"b2": True, "b1": False}
    assert raw.read_batch(spark, root, "src", "ds", "b2").count() == 1
    exp = spark.createDataFrame([("b1", 2019), ("b3", 2019), ("b4", 2020)], "batch_id string, year int")
    st = {r.batch_id: r.status for r in raw.expected_missing(exp, m, "year", 2020).collect()}
    assert st == {"b3": "error", "b4": "skip"}


def test_bronze_and_calendar(spark):
    d = _tmp()
    ts = dt.datetime(2024, 3, 1, 12)
    b = bronze.to_bronze(spark.createDataFrame([(1, 2.5)], "a int, b double"), ts)
    assert dict(b.dtypes) == {"a": "string", "b": "string", "ingestion_timestamp": "timestamp"}
    bronze.append_bronze(b, d)
    bronze.append_bronze(b, d)
    assert spark.read.parquet(d).count() == 2
    cal = bronze.calendar_spine(spark)
    assert cal.count() == 81 * 12
    assert cal.filter("date_month = date'2024-02-01'").first().month_name_pt == "Fevereiro"
    assert bronze.states_dimension(spark).filter("state_acronym = 'DF'").first().region_abbrev == "CO"
    outcome = bronze.run_batches(["ok", "bad"], lambda x: (_ for _ in ()).throw(IOError("x")) if x == "bad" else None)
    assert outcome == [("ok", "ok", ""), ("bad", "transient", "x")]


def test_fingerprints_and_delta_window(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, c string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (2, "x"), (2, "z")], "k int, c string")
    fa = {r.k: r.fingerprint for r in I.set_fingerprint(a, ["k"], "c").collect()}
    fb = {r.k: r.fingerprint for r in I.set_fingerprint(b, ["k"], "c").collect()}
    assert fa[1] == fb[1] and fa[2] != fb[2]
    sa = {r.k: r.fingerprint for r in I.scope_fingerprint(a, ["k"], "c").collect()}
    assert len(sa[1]) == 16
    w = spark.createDataFrame([(2020,), (None,)], "h int").select(I.delta_window_start(F.col("h"), 1990, 12).alias("s"))
    assert [r.s for r in w.collect()] == [2008, 1990]


def test_curation_rules(spark):
    ts = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([
        ("11", "pevs", "G1", "desc", True, ts, "a"),
        ("22", "pevs", "G2", "old", True, ts, "a"),
        ("22", "pevs", "G2", "old", False, ts + dt.timedelta(days=1), "b"),
    ], "codigo_produto string, banco string, agrupamento string, descricao_produto string, active boolean, edited_at timestamp, change_id string")
    incoming = spark.createDataFrame([("11", "pevs", None, "new desc"), ("22", "pevs", None, None)],
                                     "codigo_produto string, banco string, agrupamento string, descricao_produto string")
    up = {r.codigo_produto: (r.agrupamento, r.descricao_produto)
          for r in K.catalog_upsert(log, incoming, ["codigo_produto", "banco"], ["agrupamento", "descricao_produto"]).collect()}
    assert up == {"11": ("G1", "new desc"), "22": (None, None)}  # re-add after a tombstone inherits nothing

    edits = spark.createDataFrame([("c1", "11", ts), ("c1", "11", ts), ("c9", "99", ts), ("a", "33", ts)],
                                  "change_id string, codigo_produto string, edited_at timestamp")
    acc, conf = K.idempotent_intake(log.select("change_id", "codigo_produto"), edits, ["codigo_produto"])
    assert sorted(r.change_id for r in acc.collect()) == ["c1", "c9"]
    assert [r.change_id for r in conf.collect()] == ["a"]

    groups = spark.createDataFrame([("g1", "Frutas", True), ("g2", "Grãos", True)], "group_id string, group_name string, active boolean")
    members = spark.createDataFrame([("g1", "11")], "group_id string, code string")
    req = spark.createDataFrame([("create", "g3", "frutas"), ("create", "g4", "Novos"), ("delete", "g1", None),
                                 ("delete", "g2", None), ("rename", "g9", "X")], "op string, group_id string, group_name string")
    ok, bad = K.group_guards(groups, members, req)
    assert sorted(r.group_id for r in ok.collect()) == ["g2", "g4"]
    assert {r.group_id: r.reason for r in bad.collect()} == {"g3": "name_taken", "g1": "has_members", "g9": "not_found"}


def test_streaming_jobs(spark):
    ev = spark.createDataFrame(
        [(1, "a", dt.datetime(2024, 1, 1, 1), 10, 2020), (2, "a", dt.datetime(2024, 1, 2, 1), 11, 2021),
         (3, "b", dt.datetime(2024, 1, 1, 5), 12, 2020), (4, "b", dt.datetime(2024, 1, 3, 5), 13, 2021)],
        "event_id long, k string, ts timestamp, v int, year int")
    land = jobs.shared_path(spark, "t_land")
    ev.write.parquet(land)
    schema = ev.schema
    # Newest batch per scope wins; a late older batch is ignored.
    tgt = jobs.shared_path(spark, "t_scope")
    step = jobs.batch_replacement(tgt, ["year"], "v")
    step(ev, 0)
    step(ev.filter("v = 10").withColumn("v", F.lit(1)), 1)
    assert sorted(r.v for r in Published(spark, tgt, ["year"]).read().collect()) == [12, 13]
    # Partitions touched by a batch are recomputed from the full history.
    mart = jobs.shared_path(spark, "t_mart")
    build = lambda s, touched: spark.read.parquet(land).join(touched, "year", "left_semi").groupBy("year").agg(F.sum("v").alias("v"))
    jobs.affected_partition_refresher(mart, "year", build)(ev.filter("year = 2021"), 0)
    assert [tuple(r) for r in Published(spark, mart, ["year"]).read().select("year", "v").collect()] == [(2021, 24)]


def test_registries_bundle_overrides_and_layout(spark):
    from strata.operators import checks as CK
    from strata.operators.series import index_paired_growth
    from strata.plans import analyses as A
    from strata.plans import reads as R
    from strata.plans.layout import write_clustered
    from strata.sources import seeds

    assert R.product_source("mdic_comex") == ("serving_comex_annual", "ncm_code", "ncm_description", "val_yearfx_usd")
    assert R.CROSS_METRICS["un_comtrade:partner_exp"][2:] == ("import", "cmd_code", "partner_iso_a3")
    try:
        R.product_source("nope")
        raise AssertionError("expected a rejection")
    except R.InvalidIdentifier:
        pass
    mart = spark.createDataFrame(
        [(2020, "SP", "a", 10.0, "massa", 1.0, "OK"), (2021, "SP", "a", 20.0, "massa", 2.0, "OK"),
         (2021, "AC", "b", 5.0, "volume", 3.0, "MISSING_VALUE")],
        "year int, state string, product string, value double, family string, qty double, flag string")
    b = A.snapshot_bundle(mart, "year", "product", "state", "value", "family", "qty", "flag")
    assert set(b) >= {"products", "overview", "by_state", "state_year", "quality_total"}
    assert sorted(map(tuple, b["overview"].collect())) == [(2020, 10.0, 1), (2021, 25.0, 2)]
    meta = spark.createDataFrame([("pevs", "Extrativa", 1990), ("pam", "Lavouras", 1974)], "source string, label string, min_year int")
    ov = spark.createDataFrame([("pevs", "Extração vegetal", None)], "source string, label string, min_year int")
    got = {r.source: (r.label, r.min_year) for r in A.metadata_with_overrides(meta, ov, "source", ["label", "min_year"]).collect()}
    assert got == {"pevs": ("Extração vegetal", 1990), "pam": ("Lavouras", 1974)}
    s = spark.createDataFrame([("x", 2000, 10.0), ("x", 2002, 0.0), ("x", 2003, 5.0)], "k string, y int, v double")
    assert [r.growth for r in index_paired_growth(s, ["k"], "y", "v").orderBy("y").collect()] == [None, -1.0, 0.0]
    assert CK.family_base_coherent(seeds.unit_families(spark)).count() == 0
    child = spark.createDataFrame([("c1", "SP", "Sudeste"), ("c2", "SP", "Sul")], "city string, uf string, region string")
    parent = spark.createDataFrame([("SP", "Sudeste")], "uf string, region string")
    assert [r.city for r in CK.hierarchy_consistent(child, parent, "city", "uf", "uf", "region", "region").collect()] == ["c2"]
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("mart_present_v")
    spark.createDataFrame([], "a int").createOrReplaceTempView("mart_empty_v")
    pres = {r.table: (r.exists, r.non_empty) for r in CK.marts_present(spark, ["mart_present_v", "mart_empty_v", "missing_v"]).collect()}
    assert pres == {"mart_present_v": (True, True), "mart_empty_v": (True, False), "missing_v": (False, False)}
    path = _tmp() + "/gold"
    write_clustered(mart, path, ["year"], ["state", "product"], files_per_partition=2)
    back = spark.read.parquet(path)
    assert back.count() == 3 and sorted(r.year for r in back.select("year").distinct().collect()) == [2020, 2021]


def test_small_rules(spark):
    from strata.operators import checks as CK
    from strata.plans import analyses as A
    from strata.plans import reads as R

    d = spark.createDataFrame([(dt.date(2024, 1, 15),), (dt.date(2024, 7, 1),)], "d date")
    assert [r.s for r in d.select(I.fx_window_start("d").alias("s")).collect()] == [dt.date(2023, 1, 1), dt.date(2024, 1, 1)]
    man = spark.createDataFrame([("b1", 2020, ["a", "b"]), ("b2", 2021, ["a", "b", "c"]), ("b3", 2024, ["a"])],
                                "batch_id string, year int, scope array<string>")
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    g = {r.batch_id: (r.reason, r.added) for r in I.scope_growth(man, now, "scope", "year", "code", 2024).collect()}
    assert g == {"b1": ("scope_grew", ["c"]), "b3": ("recent", ["b", "c"])}
    df = spark.createDataFrame([("N",), ("nordeste",), ("Sul",), ("X",)], "r string")
    assert [r.n for r in df.select(C.normalise_region("r").alias("n")).collect()] == ["Norte", "Nordeste", "Sul", "X"]
    codes = spark.createDataFrame([("10",), ("9",), ("A1",), ("100",)], "c string")
    assert [r.c for r in codes.orderBy(*R.code_order("c")).collect()] == ["9", "10", "100", "A1"]
    lv = spark.createDataFrame([("x",), ("b",), ("a",)], "v string")
    assert [r.v for r in lv.orderBy(R.domain_order("v", ["b", "a"])).collect()] == ["b", "a", "x"]
    cat = spark.createDataFrame([("pevs", "1", "g1"), ("comex", "2", "g1"), ("comex", "2", "g2")],
                                "source string, code string, group_id string")
    cw, dup = A.build_crosswalk({"pevs": spark.createDataFrame([("1",), ("1",)], "code string"),
                                 "comex": spark.createDataFrame([("2",), ("3",)], "code string")}, cat)
    assert cw.count() == 3 and [(r.source, r.code) for r in dup.collect()] == [("comex", "2")]
    inv, cons = A.inventory({"pevs": spark.createDataFrame([("1", "Açaí"), ("5", "X")], "code string, description string")},
                            cw, spark.createDataFrame([("g1", "Frutas")], "group_id string, group_name string"))
    assert inv.count() == 2 and sorted((r.group_name, r.pevs) for r in cons.collect()) == [("(sem agrupamento)", 1), ("Frutas", 1)]
    pub = spark.createDataFrame([("076", "Brazil"), ("156", "China")], "m49 string, name string")
    cur = spark.createDataFrame([("076", "Brasil")], "m49 string, name string")
    assert sorted(r.name for r in A.rebuild_reference(pub, cur, "m49", "name").collect()) == ["Brasil", "China"]
    units = spark.createDataFrame([("kg",), ("Quilograma Bruto",)], "u string")
    assert CK.forbidden_values(units, "u", ["quilograma bruto"]).count() == 1
    series = spark.createDataFrame([("433",), ("189",)], "series_code string")
    rows = spark.createDataFrame([("433", 1.0)], "series_code string, v double")
    assert [r.series_code for r in CK.series_nonempty(rows, series, "series_code").collect()] == ["189"]


def test_describe_and_key_sets(spark):
    from strata.operators.units import describe
    from strata.plans import analyses as A

    fact = spark.createDataFrame([("0801", "076", 1.0), ("9999", "156", 2.0)], "ncm string, country string, v double")
    ncm = spark.createDataFrame([("0801", "Cocos")], "co_ncm string, ncm_description string")
    ctry = spark.createDataFrame([("076", "Brasil"), ("156", "China")], "co_pais string, country_name string")
    d = {r.ncm: (r.ncm_description, r.country_name) for r in describe(fact, [(ncm, "ncm", "co_ncm"), (ctry, "country", "co_pais")]).collect()}
    assert d == {"0801": ("Cocos", "Brasil"), "9999": (None, "China")}
    a = spark.createDataFrame([(2000,), (2001,), (2001,)], "y int")
    b = spark.createDataFrame([(2001,), (2002,)], "y int")
    assert [r.y for r in A.key_intersection(a, b, ["y"]).collect()] == [2001]
    assert sorted(r.y for r in A.key_union(a, b, ["y"]).collect()) == [2000, 2001, 2002]
    assert [r.y for r in A.key_difference(a, b, ["y"]).collect()] == [2000]


def test_stateful_latest_equals_batch(spark):
    from strata.operators.dedup import latest_wins

    rows = [(i, f"u{i % 4}", dt.datetime(2024, 1, 1 + (i * 7) % 20, i % 24), float(i)) for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, value double")
    land = jobs.shared_path(spark, "t_stateful_land")
    ev.repartition(6).write.parquet(land)
    stream = jobs.landing_stream(spark, land, ev.schema, files_per_trigger=1)
    agg = jobs.latest_state_aggregate(stream, ["user_id"], ["ts", "event_id"])
    state = jobs.shared_path(spark, "t_stateful_state")
    merge = jobs.latest_state_merger(state, ["user_id"], ["ts", "event_id"], buckets=4)
    q = (agg.writeStream.outputMode("update").foreachBatch(merge)
         .option("checkpointLocation", jobs.shared_path(spark, "t_stateful_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(tuple(r) for r in jobs.read_state(spark, state).select("user_id", "event_id", "ts", "value").collect())
    want = sorted(tuple(r) for r in latest_wins(ev, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "ts", "value").collect())
    assert got == want


def test_range_overlaps_matches_brute_force(spark):
    from strata.operators import checks as CK

    rows = [("a", "r1", 1990, 1995), ("a", "r2", 1996, 2000), ("a", "r3", 1998, 1999), ("a", "r4", 2000, 2005),
            ("b", "s1", 1990, 2010), ("b", "s2", 1995, 1996), ("c", "t1", 2000, 2000)]
    df = spark.createDataFrame(rows, "k string, id string, lo int, hi int")
    got = sorted(r.id for r in CK.range_overlaps(df, "k", "lo", "hi", "id").collect())
    # Brute force: a range is flagged when it overlaps any range that sorts before it in (lo, hi, id).
    def flagged(r):
        earlier = [x for x in rows if x[0] == r[0] and (x[2], x[3], x[1]) < (r[2], r[3], r[1])]
        return any(x[2] <= r[3] and r[2] <= x[3] for x in earlier)
    assert got == sorted(r[1] for r in rows if flagged(r)) == ["r3", "r4", "s2"]
