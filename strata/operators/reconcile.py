"""Reconciliation of a live table against its source layer (survey A31, A32)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile_cells(live: DataFrame, source: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Classify every key as equal / diverged / only_source / only_live.

    Values are compared as stored, as text.  A full outer join on the natural
    key; ``reconcile_report`` counts and samples it."""
    a = live.select(*keys, F.col(value).cast("string").alias("live_value"), F.lit(True).alias("_in_live"))
    b = source.select(*keys, F.col(value).cast("string").alias("source_value"), F.lit(True).alias("_in_src"))
    status = (
        F.when(F.col("_in_live").isNull(), "only_source")
        .when(F.col("_in_src").isNull(), "only_live")
        .when(~F.col("live_value").eqNullSafe(F.col("source_value")), "diverged")
        .otherwise("equal")
    )
    return a.join(b, list(keys), "full_outer").withColumn("status", status).drop("_in_live", "_in_src")


def reconcile_report(cells: DataFrame, keys: Sequence[str], samples: int = 5) -> DataFrame:
    """One row a status with its count and its first keys with both values.

    Every task counts its rows of a status and keeps the first keys of each (a
    group-limited window before the shuffle), so a report moves a few rows a
    task, however many cells differ."""
    shown = F.concat(F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]), F.lit(": source="),
                     F.coalesce("source_value", F.lit("-")), F.lit(" live="), F.coalesce("live_value", F.lit("-")))
    w = Window.partitionBy("status").orderBy(*keys)
    first = cells.filter(F.col("status") != "equal").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples)
    listed = first.groupBy("status").agg(F.array_sort(F.collect_list(F.struct("_n", shown.alias("t")))).alias("s"))
    listed = listed.select("status", F.array_join(F.transform("s", lambda x: x["t"]), "; ").alias("samples"))
    return cells.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(listed, "status", "left")


def reconcile_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.count_if(F.col("status").isin("equal", "diverged")).alias("compared"),
        F.count_if(F.col("status") == "diverged").alias("diverged"),
        F.count_if(F.col("status") == "only_source").alias("only_source"),
        F.count_if(F.col("status") == "only_live").alias("only_live"),
    )


def reconcile_points_before(live: DataFrame, source: DataFrame, keys: Sequence[str], date_col: str, cutoff: str,
                            value: str) -> DataFrame:
    """Old series points (before ``cutoff``) missing or changed in live."""
    old = source.filter(F.col(date_col) < F.lit(cutoff).cast("date"))
    j = old.select(*keys, date_col, F.col(value).alias("src")).join(
        live.select(*keys, date_col, F.col(value).alias("live")), [*keys, date_col], "left"
    )
    return j.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("live").isNull()).alias("missing"),
        F.count_if(F.col("live").isNotNull() & (F.col("live") != F.col("src"))).alias("changed"),
    )
