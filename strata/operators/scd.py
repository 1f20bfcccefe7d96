"""Append-only edit logs and their derived views (survey E07, E08, E12,
K04-K07, K13, K15).

The log is never rewritten.  Versions, current rows and registries are
read-time derivations ordered by ``(edited_at, change_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import HIDDEN_VISIBILITY, ingestion_effective, visibility_effective
from strata.operators.dedup import latest_wins
from strata.operators.ordered import ordered_columns


def scd2_timeline(
    log: DataFrame,
    keys: Sequence[str],
    ts: str = "edited_at",
    tiebreak: str = "change_id",
    skew_safe: bool = True,
) -> DataFrame:
    """One row per edit with ``version``, ``valid_from``,
    ``valid_to`` (next edit's time) and ``is_current``.

    ``skew_safe`` range-partitions the log so one very active key is spread
    over several tasks (see ``ordered``); without it a plain window is used,
    which is the cheaper plan for small logs.
    """
    if skew_safe:
        out = ordered_columns(log, keys, [ts, tiebreak], value=ts, row_number="version", lead="valid_to")
    else:
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy(F.col(ts).asc(), F.col(tiebreak).asc())
        out = log.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.lead(ts).over(w))
    return out.withColumn("valid_from", F.col(ts)).withColumn("is_current", F.col("valid_to").isNull())


def scd2_current(timeline: DataFrame) -> DataFrame:
    return timeline.filter(F.col("is_current"))


def scd2_without_cleared(timeline: DataFrame, value_col: str, cleared_value: str = "") -> DataFrame:
    """A cleared edit ends the previous version and then vanishes, so
    the key has no current row.  Filter *after* versioning (T11)."""
    return timeline.filter(F.col(value_col) != F.lit(cleared_value))


def current_catalog(
    log: DataFrame,
    keys: Sequence[str] = ("codigo_produto", "banco"),
    ts: str = "edited_at",
    tiebreak: str = "change_id",
    active: str = "active",
) -> DataFrame:
    """Latest edit per key, kept only if it is active (a tombstone is
    an edit with ``active = false``, so a later re-add revives the key)."""
    return latest_wins(log, list(keys), [ts, tiebreak]).filter(F.col(active))


def with_lifecycle(log: DataFrame) -> DataFrame:
    """B32 on a catalog log: effective visibility and ingestion columns."""
    return log.withColumn(
        "visibilidade", visibility_effective("visibilidade", "ciclo_de_vida")
    ).withColumn("ingestao", ingestion_effective("ingestao"))


def hidden_registry(
    log: DataFrame,
    keys: Sequence[str] = ("codigo_produto", "banco"),
    ts: str = "edited_at",
    tiebreak: str = "change_id",
    active: str = "active",
    visibility: str = "visibilidade",
    lifecycle: str = "ciclo_de_vida",
) -> DataFrame:
    """Keys whose latest edit is active and hidden."""
    cur = current_catalog(log, keys, ts, tiebreak, active)
    eff = visibility_effective(visibility, lifecycle)
    return cur.filter(eff == HIDDEN_VISIBILITY).select(*keys)


def last_non_null(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """The last non-null ``value`` per key over the whole history, as
    an aggregate (combined map-side) rather than a full-frame window."""
    ordk = F.struct(*[F.col(c) for c in order])
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(F.col(value), ordk).alias(out))
    )


def orphans(
    log: DataFrame,
    data_codes: DataFrame,
    keys: Sequence[str],
    group_col: str,
    ts: str = "edited_at",
    tiebreak: str = "change_id",
    active: str = "active",
) -> DataFrame:
    """Keys whose latest edit is a tombstone but that still have
    data, with the last group they belonged to."""
    latest = latest_wins(log, list(keys), [ts, tiebreak]).filter(~F.col(active))
    last_group = last_non_null(log, keys, group_col, [ts, tiebreak], "last_" + group_col)
    present = data_codes.select(*keys).distinct()
    return (
        latest.select(*keys, F.col(ts).alias("removed_at"))
        .join(present, list(keys), "left_semi")
        .join(last_group, list(keys), "left")
    )


def status_per_key(events: DataFrame, keys: Sequence[str], ts: str = "edited_at", tiebreak: str = "change_id") -> DataFrame:
    """The latest lifecycle event per key."""
    return latest_wins(events, list(keys), [ts, tiebreak])
