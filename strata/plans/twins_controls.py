"""Controls over stored layers, snapshots and purge plans, pages, co-moments, sketches and landed JSON."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import checks as CK
from strata.operators import conservation as CV
from strata.operators import curation as K
from strata.operators import scd, series
from strata.operators.reconcile import reconcile_cells, reconcile_report
from strata.plans import pages
from strata.plans.base import r6, register
from strata.plans.inputs import t, trade_lines
from strata.plans.twins_logs import _log
from strata.plans.twins_reads import _browse_preds
from strata.sources import landed, snapshot
from strata.sources.published import Published
from strata.streaming.jobs import shared_path

NOW = dt.datetime(2024, 2, 1)


def layer(spark: SparkSession, name: str, build, measures: dict, parts: tuple[str, ...] = ("year",)) -> Published:
    """Store a layer, its control totals taken in the job that writes it."""
    table = Published(spark, shared_path(spark, name), parts)
    table.publish(build, "load", CV.totals_of(measures))
    return table


@register
def conservation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Totals are conserved from the stored lines to the stored mart, overall and per flow."""
    measures = {"value_cents": "value_cents", "qty": "qty"}
    lines = layer(spark, "lines", lambda: trade_lines(spark, sf, product=True, reporter=True), measures)
    rolled = lambda: lines.read().groupBy("flow", "year", "product", "reporter").agg(*[F.sum(m).alias(m) for m in measures])
    mart = layer(spark, "mart", rolled, measures).read()
    return CK.run_suite({
        "value_qty_conserved": (CV.unconserved(lines, mart, measures), CK.ERROR),
        "value_conserved_per_flow": (CK.conserved(lines.read(), mart, ["value_cents"], keys=["flow"]), CK.ERROR),
        "mart_has_rows": (CK.non_empty(mart), CK.ERROR),
    })


# --- A30, K14, K16 -----------------------------------------------------------


def _marts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    lines = trade_lines(spark, sf, reporter=True)
    return {
        "gold_by_year": lines.groupBy("flow", "year").agg(F.sum("value_cents").alias("cents"), F.sum("qty").alias("qty")),
        "gold_by_month": lines.groupBy("flow", "year", "month", "reporter").agg(F.sum("value_cents").alias("cents")),
        "gold_orders": t(spark, sf, "orders"),
    }


@register
def gold_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table read back from a complete snapshot, held against its manifest."""
    root = shared_path(spark, "snapshots")
    tables = _marts(spark, sf)
    snapshot.snapshot(tables, root, "r1", "gold", NOW)
    out = None
    for name in sorted(tables):
        back = snapshot.read_snapshot(spark, root, "r1", "gold", name).agg(F.count(F.lit(1)).alias("n_rows"))
        row = back.select(F.lit(name).alias("table"), "n_rows", F.lit("gold").alias("dataset"))
        out = row if out is None else out.unionByName(row)
    return out


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    data = t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    found = scd.orphans(_log(spark, sf), data, ["user_id"], "group_name", ts="ts", tiebreak="event_id")
    return found.select(F.lit("comex").alias("banco"), F.col("user_id").cast("string").alias("code"), "removed_at", "last_group_name")


@register
def auto_mark_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """A 'descontinuado' event per orphan whose latest lifecycle event is older than its removal."""
    # of some users a purge was recorded after the removal
    log = t(spark, sf, "events").filter(F.col("event_type") == "purchase").select(
        F.lit("comex").alias("banco"), F.col("user_id").cast("string").alias("code"), F.lit(K.PURGED).alias("status"),
        F.when(F.col("value") > 95, F.lit(NOW).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("edited_at"),
        F.col("event_id").cast("string").alias("change_id"))
    return K.auto_mark_orphans(_orphans(spark, sf), log, ["banco", "code"], NOW, group_col="last_group_name")


@register
def purge_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is requested, by code and with a letter before it; removed
    users are marked, those that came back are in the catalogue again."""
    root = shared_path(spark, "snapshots_purge")
    snapshot.snapshot({"gold_orders": t(spark, sf, "orders")}, root, "r1", "gold", NOW - dt.timedelta(days=3))
    backup = snapshot.backup_status(spark, root, "gold", NOW, 7)
    log = _log(spark, sf)
    code = F.col("user_id").cast("string")
    asked = log.select(F.lit("comex").alias("banco"), F.explode(F.array(code, F.concat(F.lit("N"), code))).alias("code"))
    marked = log.filter(F.col("event_type") == "error").select(
        F.lit("comex").alias("banco"), code.alias("code"), F.lit(K.DISCONTINUED).alias("status"), F.col("ts").alias("edited_at"),
        F.col("event_id").alias("change_id"))
    active = scd.current_catalog(log, ["user_id"], ts="ts", tiebreak="event_id").select(F.lit("comex").alias("banco"), code.alias("code"))
    return K.purge_plan(asked, marked, active, "banco", "code", backup).drop("backup_msg")


@register
def catalog_edit_validation(spark: SparkSession, sf: str) -> DataFrame:
    """An edit of every part, by kinds of malformed ones, and how many of each are refused."""
    n, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    edits = t(spark, sf, "part").select(
        F.when(n % 11 == 0, F.concat(key, F.lit("a"))).when(n % 13 == 0, F.lit("  ")).when(n % 17 == 0, F.lpad(key, 33, "0")).otherwise(F.concat(F.lit(" "), key)).alias("codigo_produto"),
        F.when(n % 7 == 0, "anvisa").otherwise("comex").alias("banco"), F.when(n % 5 == 0, "ocluto").when(n % 5 == 1, "oculto").alias("visibilidade"),
        F.when(n % 3 == 0, "parada").when(n % 3 == 1, "pausada").alias("ingestao"), F.when(n % 19 == 0, "Outra").when(n % 19 == 1, "").alias("ciclo_de_vida"))
    return K.validate_catalog_edits(edits).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


# --- A36, J03, D24, A31 -------------------------------------------------------


@register
def browse_page(spark: SparkSession, sf: str) -> DataFrame:
    """A 500-row page at offset 100 in a total order over all columns, from its blocks alone."""
    path = shared_path(spark, "pages_orders")
    pages.write_pages(t(spark, sf, "orders"), path, rows_per_block=5_000)
    return pages.read_page(spark, path, _browse_preds(), offset=100, limit=500)


@register
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson r of the yearly values of every two of the brands."""
    moments = series.co_moments(trade_lines(spark, sf, product=True), "year", "product", "value_cents")
    return series.correlations(moments).select("series_a", "series_b", r6("r").alias("r"), "n_years")


@register
def median_price_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Median unit price by year from sketches of two loads, merged;
    whether its rank lies within the sketch's error of the middle."""
    lines = trade_lines(spark, sf).withColumn("price", F.try_divide(F.col("value_cents") / 100.0, F.col("qty")))
    path = shared_path(spark, "price_sketches")
    for unit in ("F", "O"):
        series.quantile_sketches(lines.filter(F.col("unit") == unit), ["year"], "price").write.mode("append").parquet(path)
    med = series.merged_quantiles(spark.read.parquet(path), ["year"], 0.5, "median_price")
    j = lines.join(med, "year").groupBy("year", "n_rows").agg(
        (F.count_if(F.col("price") < F.col("median_price")) / F.count("price")).alias("below"),
        (F.count_if(F.col("price") <= F.col("median_price")) / F.count("price")).alias("up_to"))
    e = series.SKETCH_RANK_ERROR
    return j.select("year", "n_rows", ((F.col("below") <= 0.5 + e) & (F.col("up_to") >= 0.5 - e)).alias("within_error"))


@register
def reconcile_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and the five smallest keys a status, of all lines against a
    rendered delivery where every 7th order is one unit higher and every 11th stands under another key."""
    live = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("qty"))
    k = F.col("l_orderkey")
    source = live.select(F.when(k % 11 == 0, -k - 1).otherwise(k).alias("l_orderkey"), F.when(k % 7 == 0, F.col("qty") + 1).otherwise(F.col("qty")).alias("qty"))
    return reconcile_report(reconcile_cells(live, source, ["l_orderkey"], "qty"), ["l_orderkey"])


# --- A09, A10, A34 -------------------------------------------------------------


@register
def header_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers landed as JSON arrays of a hundred, each with a header
    row; every other file uses other keys, another order and another column."""
    s = t(spark, sf, "supplier").withColumn("chunk", F.floor(F.col("s_suppkey") / 100))
    text = lambda c: F.col(c).cast("string")
    even = F.col("chunk") % 2 == 0
    row = F.when(even, F.create_map(F.lit("D1C"), text("s_suppkey"), F.lit("D1N"), F.col("s_name"), F.lit("V"), text("s_nationkey"))).otherwise(
        F.create_map(F.lit("V"), F.col("s_name"), F.lit("NC"), text("s_suppkey")))
    head = F.when(F.first(even), F.create_map(*[F.lit(x) for x in ("D1C", "Fornecedor (Código)", "D1N", "Razão  Social", "V", "Nação")])).otherwise(
        F.create_map(*[F.lit(x) for x in ("V", "Razão Social", "NC", "FORNECEDOR - código")]))
    files = s.groupBy("chunk").agg(F.to_json(F.concat(F.array(head), F.collect_list(row))).alias("value"))
    path = shared_path(spark, "payloads")
    files.select(F.col("chunk"), "value").write.partitionBy("chunk").text(path)
    return landed.header_row_payload(spark, f"{path}/chunk=*")


@register
def mesh_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Customers landed as nested JSON, every other one with the second
    branch of its hierarchy alone; flattened with fallback, and not short."""
    d = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    uf = F.struct(F.col("n_name").alias("sigla"), F.struct(F.col("r_name").alias("nome")).alias("regiao"))
    first = F.col("c_custkey") % 2 == 0
    nested = d.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"),
                      F.when(first, F.struct(F.struct(uf.alias("UF")).alias("mesorregiao"))).alias("microrregiao"),
                      F.when(~first, F.struct(F.struct(uf.alias("UF")).alias("intermediaria"))).alias("imediata"))
    path = shared_path(spark, "mesh")
    nested.write.json(path)
    back = spark.read.schema(nested.schema).json(path)
    return landed.flatten_mesh(back, {
        "code": ("id",), "name": ("nome",), "uf": ("microrregiao.mesorregiao.UF.sigla", "imediata.intermediaria.UF.sigla"),
        "region": ("microrregiao.mesorregiao.UF.regiao.nome", "imediata.intermediaria.UF.regiao.nome")}, min_rows=1)
