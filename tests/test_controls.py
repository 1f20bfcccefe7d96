"""Control totals, snapshots, purge plans, pages, co-moments, sketches and payloads."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.operators import conservation as CV
from strata.operators import curation as K
from strata.operators import series
from strata.operators.reconcile import reconcile_cells, reconcile_report
from strata.plans import pages
from strata.sources import landed, snapshot
from strata.sources.published import Published

NOW = dt.datetime(2024, 2, 1)


def test_a_lost_row_turns_the_conservation_check_red(spark, tmp_path):
    rows = spark.createDataFrame([(2000 + i % 5, i, i * 1.5 if i % 7 else None) for i in range(100)], "year int, q int, v double")
    before = Published(spark, str(tmp_path / "a"), ["year"])
    before.publish(lambda: rows, "x", CV.totals_of({"q": "q", "v": "v"}))
    after = Published(spark, str(tmp_path / "b"), ["year"])
    after.publish(lambda: before.read(), "x")
    assert CV.unconserved(before, after.read(), {"q": "q", "v": "v"}).count() == 0
    after.publish(lambda: before.read().filter("q <> 57"), "y", whole=True)
    bad = CV.unconserved(before, after.read(), {"q": "q", "v": "v"}).collect()
    assert {(r.measure, r.control - r.stored) for r in bad} == {("q", 57.0), ("v", 85.5)}
    after.publish(lambda: before.read().limit(0), "z", whole=True)
    assert CV.unconserved(before, after.read(), {"q": "q"}).count() == 1


def test_snapshots_refuse_what_is_partial_foreign_or_changed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    t1 = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k int, v string")
    t2 = t1.limit(0)
    assert snapshot.backup_status(spark, root, "gold", NOW, 7) == (False, "no snapshot")
    snapshot.snapshot({"t1": t1, "t2": t2}, root, "r1", "gold", NOW)
    assert snapshot.read_snapshot(spark, root, "r1", "gold", "t1").count() == 3
    assert snapshot.read_snapshot(spark, root, "r1", "gold", "t2").count() == 0
    for run, dataset, table in (("r1", "dev", "t1"), ("r9", "gold", "t1"), ("r1", "gold", "t9")):
        with pytest.raises(snapshot.PartialSnapshot):
            snapshot.read_snapshot(spark, root, run, dataset, table)
    t1.dropDuplicates().write.mode("overwrite").parquet(f"{root}/run=r1/t1")  # a repeated row is lost
    with pytest.raises(snapshot.PartialSnapshot, match="not what was written"):
        snapshot.read_snapshot(spark, root, "r1", "gold", "t1")
    assert snapshot.backup_status(spark, root, "gold", NOW, 7)[0]
    assert not snapshot.backup_status(spark, root, "dev", NOW, 7)[0]
    assert not snapshot.backup_status(spark, root, "gold", NOW + dt.timedelta(days=8), 7)[0]

    # a run that fails at its second table has no marker
    broken = t1.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        snapshot.snapshot({"a": t1, "b": broken}, root, "r2", "gold", NOW)
    assert [r.run_id for r in snapshot.complete_runs(spark, root).collect()] == ["r1"]
    with pytest.raises(snapshot.PartialSnapshot):
        snapshot.read_snapshot(spark, root, "r2", "gold", "a")


def test_orphans_are_marked_once_a_removal(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda d: t0 + dt.timedelta(days=d)
    orphans = spark.createDataFrame([("pevs", "1", at(5), "Frutas"), ("pevs", "2", at(5), None), ("pevs", "3", at(5), "X"), ("pam", "4", at(5), "X"), ("pam", "5", None, "X")],
                                    "banco string, code string, removed_at timestamp, grp string")
    log = spark.createDataFrame([("pevs", "2", "descontinuado", at(1), "a"), ("pevs", "3", "descontinuado", at(5), "b"), ("pam", "4", "purged", at(9), "c"), ("pam", "5", "purged", at(1), "d")],
                                "banco string, code string, status string, edited_at timestamp, change_id string")
    got = {r.code: r for r in K.auto_mark_orphans(orphans, log, ["banco", "code"], NOW, group_col="grp").collect()}
    assert sorted(got) == ["1", "2"]  # 2 was removed again after it was marked
    assert got["1"].change_id == "descontinuado:commodity:pevs:1:2024-01-06T00:00:00" and got["1"].edited_by == "system:orphan-detector"
    assert got["1"].reason == "Removida do cadastro; dados em Gold pendentes (agrupamento Frutas)." and "agrupamento —" in got["2"].reason


def test_purge_plans(spark):
    t0 = dt.datetime(2024, 1, 1)
    ask = spark.createDataFrame([("pevs", "1"), (" pevs ", " 1 "), ("pevs", "12a"), ("pevs", ""), ("pam", "2"), ("comex", "3"), ("comtrade", "4"), ("other", "5")], "banco string, code string")
    log = spark.createDataFrame([("pevs", "1", "descontinuado", t0, "a"), ("pam", "2", "purged", t0, "b"), ("comex", "3", "descontinuado", t0, "c"), ("comtrade", "4", "purged", t0, "d"),
                                 ("comtrade", "4", "descontinuado", t0 + dt.timedelta(1), "e"), ("other", "5", "descontinuado", t0, "f"), ("pevs", "12a", "descontinuado", t0, "g")],
                                "banco string, code string, status string, edited_at timestamp, change_id string")
    active = spark.createDataFrame([("comex", "3"), ("pevs", "3")], "banco string, code string")
    rows = {(r.banco, r.code): r for r in K.purge_plan(ask, log, active, "banco", "code", (True, "ok"), "gold").collect()}
    assert {k: r.refused for k, r in rows.items()} == {("pevs", "1"): None, ("pevs", "12a"): "invalid", ("pevs", ""): "invalid", ("pam", "2"): "not_marked",
                                                       ("comex", "3"): "re_added", ("comtrade", "4"): None, ("other", "5"): None}
    assert rows["pevs", "1"].statement == "DELETE FROM `gold.gold_pevs_production` WHERE product_code = '1';" and rows["pevs", "1"].allowed
    assert rows["comtrade", "4"].statement.endswith("WHERE cmd_code = '4';") and rows["other", "5"].statement is None and rows["comex", "3"].statement is None
    held = K.purge_plan(ask, log, active, "banco", "code", (False, "no snapshot"))
    assert held.filter("allowed").count() == 0 and held.filter("statement is not null").count() == 2
    assert [r.change_id for r in K.purge_event(K.purge_plan(ask.limit(1), log, active, "banco", "code", (True, "")), ["banco", "code"], NOW).collect()] == ["purge:pevs:1"]


def test_a_deep_page_reads_a_bounded_number_of_blocks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), f"v{rng.randrange(300)}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    path = str(tmp_path / "p")
    pages.write_pages(df, path, rows_per_block=250)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for offset, limit in ((0, 10), (4300, 200), (4990, 50), (9999, 5), (240, 20)):
        page = pages.read_page(spark, path, offset=offset, limit=limit)
        assert [tuple(r) for r in page.collect()] == want[offset:offset + limit]
    plan = pages.read_page(spark, path, offset=4300, limit=200)._jdf.queryExecution().toString()
    blocks = re.search(r"PartitionFilters: \[.*?_block#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert blocks and len((blocks[1] or blocks[2]).split(",")) <= 3, plan  # of 20 blocks
    odd = F.col("c") % 2 == 1
    page = pages.read_page(spark, path, [odd, None], offset=1700, limit=40)
    assert [tuple(r) for r in page.collect()] == [r for r in want if r[2] % 2][1700:1740]
    pages.write_pages(df.limit(0), str(tmp_path / "e"))
    assert pages.read_page(spark, str(tmp_path / "e")).count() == 0


def test_co_moments_of_loads_add_up(spark):
    rng = random.Random(2)
    rows = [(y, s, float(rng.randrange(1000))) for y in range(2000, 2012) for s in "abcd" for _ in range(3) if not (s == "d" and y > 2000)] + [(y, "flat", 5.0) for y in range(2000, 2012)]
    df = spark.createDataFrame(rows, "y int, s string, v double")
    whole = {(r.series_a, r.series_b): (round(r.r, 9), r.n_years) for r in series.correlations(series.co_moments(df, "y", "s", "v")).collect()}
    loads = series.co_moments(df.filter("y < 2006"), "y", "s", "v").unionByName(series.co_moments(df.filter("y >= 2006"), "y", "s", "v"))
    assert {(r.series_a, r.series_b): (round(r.r, 9), r.n_years) for r in series.correlations(loads).collect()} == whole
    import numpy as np
    by = {s: {y: sum(v for yy, ss, v in rows if (yy, ss) == (y, s)) for y in range(2000, 2012)} for s in "abc"}
    assert whole["a", "b"][0] == pytest.approx(np.corrcoef(list(by["a"].values()), list(by["b"].values()))[0, 1], abs=1e-9)
    assert whole["a", "d"] == (0.0, 1) and whole["a", "flat"] == (0.0, 12) and len(whole) == 10
    plan = series.co_moments(df, "y", "s", "v")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_sketches_of_loads_merge_within_their_rank_error(spark):
    df = spark.range(0, 60_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 100_000).cast("double").alias("v"))
    parts = [series.quantile_sketches(df.filter(F.col("id") % 5 == k), ["g"], "v") for k in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    for p in (0.25, 0.5, 0.9):
        for r in series.merged_quantiles(merged, ["g"], p, "q").collect():
            rank = df.filter((F.col("g") == r.g) & (F.col("v") <= r.q)).count() / r.n_rows
            assert r.n_rows == 20_000 and abs(rank - p) <= series.SKETCH_RANK_ERROR


def test_each_file_has_its_own_header(spark, tmp_path):
    files = [[{"A": "Município (Código)", "B": "Valor"}, {"A": "1", "B": "10"}, {"A": "2", "B": "..."}],
             [{"B": "MUNICIPIO - CÓDIGO", "Z": "Unidade"}, {"B": "3", "Z": "t"}],
             [{"A": "Valor"}], []]
    for i, rows in enumerate(files):
        (tmp_path / f"f{i}.json").write_text(json.dumps(rows, indent=i % 2 or None))
    got = landed.header_row_payload(spark, str(tmp_path))
    assert got.columns == ["municipio_codigo", "unidade", "valor"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", None, "10"), ("2", None, "..."), ("3", "t", None)]
    fixed = landed.header_row_payload(spark, str(tmp_path), ["valor", "ano"])
    assert sorted(map(tuple, fixed.collect()), key=str) == [("...", None), ("10", None), (None, None)]


def test_reconcile_compares_text_and_samples_the_smallest_keys(spark):
    live = spark.createDataFrame([(i, "1.0" if i != 3 else "2") for i in range(20)] + [(99, None)], "k int, v string")
    source = spark.createDataFrame([(i, "1.0" if i % 2 else "1.00") for i in range(5, 30)] + [(3, "2"), (99, None)], "k int, v string")
    got = {r.status: (r.n, r.samples) for r in reconcile_report(reconcile_cells(live, source, ["k"], "v"), ["k"]).collect()}
    assert got["equal"] == (10, None) and got["diverged"][0] == 7 and got["only_live"] == (4, "0: source=- live=1.0; 1: source=- live=1.0; 2: source=- live=1.0; 4: source=- live=1.0")
    assert got["diverged"][1] == "; ".join(f"{k}: source=1.00 live=1.0" for k in (6, 8, 10, 12, 14))
    assert got["only_source"][0] == 10 and got["only_source"][1].startswith("20: source=1.00 live=-; 21:")


def test_creates_of_one_name_in_a_batch(spark):
    groups = spark.createDataFrame([("frutas", "Frutas", True), ("velho", "Velho", False)], "group_id string, group_name string, active boolean")
    members = spark.createDataFrame([("frutas", "11")], "group_id string, code string")
    req = spark.createDataFrame([(1, "create", None, "Grãos & Cia"), (2, "create", None, "graos cia"), (3, "create", None, "Frutas"), (4, "create", None, "!!!"),
                                 (5, "create", None, "Velho"), (6, "rename", "frutas", "Frutas finas"), (7, "delete", "frutas", None), (8, "create", "frutas", "Outras")],
                                "seq int, op string, group_id string, group_name string")
    ok, bad = K.group_guards(groups, members, req)
    assert sorted((r.seq, r.group_id) for r in ok.collect()) == [(1, "graos_cia"), (5, "velho"), (6, "frutas")]
    assert {r.seq: r.reason for r in bad.collect()} == {2: "exists", 3: "exists", 4: "no_id", 7: "has_members", 8: "exists"}


def test_catalogue_edits_are_validated(spark):
    rows = [("1", "pevs", None, None, None, None), (" 7 ", "pam", "pausada", "oculto", "", None), (None, "pevs", None, None, None, "key_missing"), ("1", " ", None, None, None, "key_missing"),
            ("1" * 33, "pevs", None, None, None, "code_too_long"), ("1.5", "pevs", None, None, None, "code_not_digits"), ("1", "ibge", None, None, None, "unknown_source"),
            ("1", "pevs", "x", None, None, "unknown_ingestion"), ("1", "pevs", None, "ocluto", None, "unknown_visibility"), ("1", "pevs", None, None, "prosa", "unknown_lifecycle"),
            ("1", "pevs", None, None, "Fazer Ingestão e deixar disponível", None)]
    df = spark.createDataFrame(rows, "codigo_produto string, banco string, ingestao string, visibilidade string, ciclo_de_vida string, want string")
    for r in K.validate_catalog_edits(df).collect():
        assert r.rejected == r.want, r
