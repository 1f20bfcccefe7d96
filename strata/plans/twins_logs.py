"""Twins for parsing, deduplication, edit logs and series.

``events`` plays the append-only edit log: key ``user_id``, edit time
``ts``, change id ``event_id``, payload ``event_type``/``value``; the
``error`` event type plays a tombstone / cleared edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import dedup, scd
from strata.operators import deflate as DF
from strata.operators.series import month_gaps as _month_gaps
from strata.plans.base import r2, r6, register
from strata.plans.inputs import fx_series, index_series, revenue_cents, t

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a catalog edit log (tombstone = 'error')."""
    e = t(spark, sf, "events")
    return (
        e.withColumn("active", F.col("event_type") != "error")
        .withColumn(
            "visibilidade",
            F.when(F.col("event_type") == "view", "oculto").when(F.col("event_type") == "click", "visivel"),
        )
        .withColumn(
            "ciclo_de_vida",
            F.when(F.col("value") > 90, F.lit(C.LEGACY_HIDDEN_PROSE)).when(F.col("value") < 10, F.lit(C.LEGACY_VISIBLE_PROSE)),
        )
        .withColumn("group_name", F.when(F.col("event_type") != "error", F.col("event_type")))
    )


@register
def safe_numeric_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    """B01-B03 on strings rendered from lineitem with every sentinel kind."""
    li = t(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint").cast("string")
    n = F.col("l_linenumber")
    raw = (
        F.when(n == 1, F.lit("..."))
        .when(n == 2, F.lit("-"))
        .when(n == 3, F.concat(F.lit(" "), q, F.lit(",5 ")))
        .when(n == 4, F.concat(q, F.lit("d")))
        .when(n == 5, F.lit(""))
        .when(n == 6, F.lit("X"))
        .otherwise(q)
    )
    d = li.select("l_orderkey", "l_linenumber", raw.alias("raw"), "l_discount", "l_tax")
    return d.select(
        "l_orderkey",
        "l_linenumber",
        "raw",
        C.safe_numeric("raw").alias("num"),
        C.safe_numeric("raw", dash_is_zero=True).alias("num_dash_zero"),
        C.zero_as_missing("l_discount").alias("discount_or_null"),
        C.zero_as_missing("l_tax").alias("tax_or_null"),
    )


@register
def safe_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Strict dd/MM/yyyy parse (bad rows dropped), date from parts
    (impossible month -> NULL) and calendar attributes."""
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    s = (
        F.when(k == 1, F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string")))
        .when(k == 2, F.lit("n/a"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    d = o.select("o_orderkey", s.alias("date_str"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 14).cast("int").alias("m"))
    d = d.withColumn("parsed", C.safe_date("date_str")).filter(F.col("parsed").isNotNull())
    p = F.col("parsed")
    return d.select(
        "o_orderkey",
        "date_str",
        "parsed",
        C.safe_date_from_parts("y", "m").alias("from_parts"),
        C.year_end_date("y").alias("year_end"),
        F.year(p).alias("reference_year"),
        F.month(p).alias("reference_month"),
        F.quarter(p).alias("quarter"),
        F.when(F.month(p) <= 6, 1).otherwise(2).alias("semester"),
        F.last_day(p).alias("month_end_date"),
        F.date_format(p, "yyyy-MM").alias("year_month"),
        (F.month(p) == 12).alias("is_year_end"),
        C.month_name_pt(F.month(p)).alias("month_name_pt"),
    )


@register
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event per (user, type), ties broken by event id."""
    return dedup.latest_wins(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@register
def latest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Per event type only the newest day's batch survives."""
    e = t(spark, sf, "events").withColumn("batch_date", F.to_date("ts"))
    return dedup.latest_batch(e, ["event_type"], "batch_date")


@register
def two_stage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """E02 then E01: newest hour batch per (type, day), then newest row per (user, type)."""
    e = t(spark, sf, "events").withColumn("batch_date", F.to_date("ts")).withColumn("batch_hour", F.hour("ts"))
    return dedup.batch_then_row_dedup(e, ["event_type", "batch_date"], "batch_hour", ["user_id", "event_type"], ["ts", "event_id"])


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    tl = scd.scd2_timeline(e, ["user_id"], ts="ts", tiebreak="event_id")
    return tl.select("user_id", "event_id", "event_type", "version", "valid_from", "valid_to", "is_current")


@register
def scd2_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """E07/E08/K04 on the events log (skew-safe ordered scan)."""
    return _timeline(spark, sf)


@register
def scd2_current(spark: SparkSession, sf: str) -> DataFrame:
    return scd.scd2_current(_timeline(spark, sf))


@register
def scd2_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """K05: 'error' clears the key; filtered after versioning."""
    return scd.scd2_without_cleared(_timeline(spark, sf), "event_type", "error")


@register
def catalog_current(spark: SparkSession, sf: str) -> DataFrame:
    """Latest edit per user, dropped when it is a tombstone."""
    cur = scd.current_catalog(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id")
    return cur.select("user_id", "event_id", "event_type", "value", "ts")


@register
def hidden_registry(spark: SparkSession, sf: str) -> DataFrame:
    """K07 + B32: active latest edits whose effective visibility is hidden."""
    return scd.hidden_registry(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id")


@register
def visibility_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem totals per flow with hidden supplier codes removed."""
    from strata.operators.gate import visibility_gate as gate

    hidden = scd.hidden_registry(_log(spark, sf), ["user_id"], ts="ts", tiebreak="event_id").select(
        F.col("user_id").alias("code")
    )
    li = t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", revenue_cents().alias("cents"))
    g = gate(li, hidden, "l_suppkey")
    return g.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), r2(F.sum("cents") / F.lit(100.0)).alias("revenue")
    )


@register
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """E12 + C21: tombstoned users that still have orders, with their last group."""
    data = t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    return scd.orphans(_log(spark, sf), data, ["user_id"], "group_name", ts="ts", tiebreak="event_id")


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").withColumn("change_id", F.col("event_id") % 1000)


@register
def idempotent_append(spark: SparkSession, sf: str) -> DataFrame:
    """The first edit per change id is applied, repeats are no-ops."""
    first = dedup.first_seen(_edits(spark, sf), "change_id", ["ts", "event_id"])
    return first.select("change_id", "event_id", "user_id", "event_type")


@register
def change_id_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """A change id reused for a different key is a conflict."""
    return (
        _edits(spark, sf)
        .groupBy("change_id")
        .agg(F.count_distinct("user_id").alias("n_keys"))
        .filter(F.col("n_keys") > 1)
    )


@register
def chain_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chain-linked index of the monthly mean order price per status."""
    i = index_series(spark, sf)
    return i.select(
        "series_code", "reference_date", "reference_year", "reference_month",
        r6("monthly_pct_change").alias("monthly_pct_change"), r6("index_value").alias("index_value"),
    )


@register
def month_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Months skipped between a customer's consecutive order months."""
    m = t(spark, sf, "orders").select(
        "o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("reference_date")
    ).distinct()
    return _month_gaps(m, ["o_custkey"], "reference_date").select("o_custkey", "reference_date", "prev_date", "gap_months")


@register
def year_end_index(spark: SparkSession, sf: str) -> DataFrame:
    """D04."""
    y = DF.year_end_index(index_series(spark, sf))
    return y.select("reference_year", *[r6(c).alias(c) for c in ("ipca_year_end", "igpm_year_end", "igpdi_year_end")])


@register
def latest_index(spark: SparkSession, sf: str) -> DataFrame:
    """D05."""
    li = DF.latest_index(index_series(spark, sf))
    return li.select(*[r6(c).alias(c) for c in ("ipca_current", "igpm_current", "igpdi_current")])


@register
def fx_year_average(spark: SparkSession, sf: str) -> DataFrame:
    """D06 with the euro guard (NULL before 1999)."""
    f = DF.fx_year_average(fx_series(spark, sf))
    return f.select("reference_year", r6("brl_per_usd_avg").alias("brl_per_usd_avg"), r6("brl_per_eur_avg").alias("brl_per_eur_avg"))



@register
def dedup_prefer_real(spark: SparkSession, sf: str) -> DataFrame:
    """One event per (user, day), preferring non-error rows over error
    rows (boolean tie-break first), then the newest."""
    e = t(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return dedup.latest_wins(e, ["user_id", "day"], [dedup.prefer_not("event_type", "error"), "ts", "event_id"])


@register
def name_state_split(spark: SparkSession, sf: str) -> DataFrame:
    """B09/B10/B39/B11: 'Name - UF' split (no match -> NULL UF), code-prefix
    strip, join-key normalisation and ASCII slug on customer attributes."""
    c = t(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 2 == 0,
                 F.concat(F.col("c_name"), F.lit(" - "), F.upper(F.substring("c_mktsegment", 1, 2)))).otherwise(F.col("c_name"))
    desc = F.concat(F.col("c_nationkey").cast("string"), F.lit(".1 - "), F.initcap("c_mktsegment"), F.lit(" Ção"))
    d = c.select("c_custkey", raw.alias("municipio"), desc.alias("descricao"))
    name, uf = C.split_name_state("municipio")
    return d.select("c_custkey", name.alias("city_name"), uf.alias("state_acronym"),
                    C.strip_code_prefix("descricao").alias("product_description"),
                    C.norm_key("descricao").alias("desc_key"), C.slug("descricao").alias("slug"))
