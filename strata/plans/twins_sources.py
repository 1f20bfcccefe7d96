"""Twins of source bookkeeping (A*) and curation (K*) operators.

Each twin reads the driver tables (or data Spark derives from them and
writes under the shared checkpoint folder) over whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import curation as K
from strata.operators import incremental as I
from strata.operators import scd
from strata.sources import seeds
from strata.plans.base import r6, register
from strata.plans.inputs import t, trade_lines
from strata.plans.twins_logs import _log
from strata.sources import raw
from strata.streaming.jobs import shared_path

NOW = dt.datetime(2024, 2, 1, 0, 0, 0)  # the fixed "current time" of the twins


@register
def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders archived verbatim as one batch per order year in a
    single job; manifest rows counted from the written files, read back."""
    root = shared_path(spark, "raw")
    o = t(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    manifest = raw.archive_partitioned(o, root, "tpch", "orders", "order_year", NOW, {"etag": '"abc"'})
    back = raw.read_batch(spark, root, "tpch", "orders").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_read"))
    listed = raw.list_batches(manifest, "tpch", "orders")
    return listed.join(back, "batch_id").select("batch_id", "rows", "n_read")


@register
def bronze_high_water(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an all-string Bronze (dd/MM/yyyy dates), high-water
    mark per series (priority) and the delta window start (12-month overlap,
    floor 1996-01-01)."""
    b = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_code"),
                                      F.date_format("o_orderdate", "dd/MM/yyyy").alias("reference_date_str"))
    h = I.high_water_mark_date(b, ["series_code"], "reference_date_str")
    start = F.greatest(F.lit("1996-01-01").cast("date"), F.add_months(F.col("hwm"), -12))
    return h.select("series_code", "hwm", start.alias("window_start"))


@register
def scope_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Per ship year, a fingerprint of the set of shipping suppliers
    (distributive form: the set grows with the data)."""
    li = t(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_suppkey")
    return I.set_fingerprint(li, ["year"], "l_suppkey")


@register
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Ship years x batches of 25 sorted supplier codes, stable ids."""
    li = t(spark, sf, "lineitem")
    span = li.agg(F.min(F.year("l_shipdate")).alias("y0"), F.max(F.year("l_shipdate")).alias("y1"))
    years = span.select(F.explode(F.sequence("y0", "y1")).alias("year"))
    members = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("member"))
    chunks = raw.member_chunks(members, "member", 25)
    return years.crossJoin(chunks)


@register
def source_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Age of the newest event against 24 h warn / 72 h error."""
    f = raw.source_freshness(t(spark, sf, "events"), "ts", 24.0, 72.0, NOW)
    return f.select("newest", r6("age_hours").alias("age_hours"), "status")


@register
def groups_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as groups with their current members, zero-filled."""
    groups = t(spark, sf, "events").select(F.col("event_type").alias("group_id")).distinct()
    cur = scd.current_catalog(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(
        "user_id", F.col("group_name").alias("group_id"))
    return K.groups_with_counts(groups, cur)


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    cur = scd.current_catalog(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id")
    return cur.select("user_id", F.col("group_name").alias("group_id"),
                      F.when(F.col("user_id") % 2 == 0, "pevs").otherwise("comex").alias("source"))


@register
def catalog_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Per group, code count and the distinct sources."""
    w = K.catalog_worklist(_catalog(spark, sf), "group_id", "source")
    return w.select("group_id", "n_codes", F.array_join("sources", ",").alias("sources"))


@register
def code_status(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogued users with their order rows, first/last year, has data."""
    data = t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("year"))
    return K.code_status(_catalog(spark, sf), data, "user_id", "year")


@register
def level_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their current level (from the SCD2 view of the
    events log), counted per level (NULL = still to classify)."""
    tl = scd.scd2_timeline(t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"),
                           ["user_id"], ts="ts", tiebreak="event_id")
    levels = scd.scd2_current(tl).select(F.col("user_id").alias("code"), F.col("event_type").alias("level"))
    catalog = t(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    _, counts = K.level_worklist(catalog, levels, "code", "level")
    return counts


MARKET_MAPPING = [("A", "F", "external"), ("A", "O", "external"), ("N", "F", "domestic"), ("X", "F", "domestic")]


@register
def matrix_with_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """(flow, unit) cells with values, full-outer joined with the
    market mapping (unmapped cells and mappings without data both kept)."""
    cells = trade_lines(spark, sf).groupBy("flow", "unit").agg(F.count(F.lit(1)).alias("n_rows"))
    mapping = seeds.seed_frame(spark, MARKET_MAPPING, "flow string, unit string, market string")
    return K.matrix_with_mapping(cells, mapping, ["flow", "unit"])


def _resolved(spark: SparkSession, sf: str, ingestion) -> DataFrame:
    from strata.operators.gate import resolve_scope

    log = _log(spark, sf).withColumn("ingestao", ingestion)
    cur = scd.current_catalog(log, ["user_id"], ts="ts", tiebreak="event_id")
    conf = t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return resolve_scope(cur, conf, "user_id")


@register
def resolved_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Active, not-paused catalogue codes, all of them."""
    return _resolved(spark, sf, F.when(F.col("event_type") == "signup", "pausada"))


