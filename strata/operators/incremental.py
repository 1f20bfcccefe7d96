"""Incremental loading (survey A16-A21, A28, A27, C10).

High-water marks are scalars that prune the Bronze scan; affected partitions
are a small distinct set that prunes the second one; what is rebuilt is
published as one commit, so untouched partitions are never rewritten and
readers never see half a load.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.published import Published


def high_water_mark_date(df: DataFrame, keys: Sequence[str], date_str: str, fmt: str = "dd/MM/yyyy") -> DataFrame:
    """Newest parseable date per series."""
    return df.groupBy(*keys).agg(F.max(F.try_to_date(F.col(date_str), fmt)).alias("hwm"))


def high_water_mark_year(df: DataFrame, year_str: str) -> DataFrame:
    """Newest parseable year."""
    return df.agg(F.max(F.col(year_str).try_cast("int")).alias("hwm"))


def delta_window_start(hwm_year, floor_year: int, overlap: int) -> F.Column:
    """start = max(floor, hwm - overlap); NULL hwm (cold start) = floor."""
    return F.greatest(F.lit(floor_year), F.coalesce(hwm_year - F.lit(overlap), F.lit(floor_year)))


def new_codes(configured: DataFrame, bronze: DataFrame, code: str) -> DataFrame:
    """Configured codes that have no Bronze rows (need a full backfill)."""
    return configured.select(code).distinct().join(bronze.select(code).distinct(), code, "left_anti")


def scope_fingerprint(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """A stable 16-hex fingerprint of the sorted code set per scope."""
    return df.groupBy(*keys).agg(
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(code).cast("string"))), "\n"), 256), 1, 16)
        .alias("fingerprint"))


def affected_partitions(bronze: DataFrame | Sequence[DataFrame], hwm, part: str, ts: str, day: str | None = None) -> DataFrame:
    """The distinct values of ``part`` with Bronze rows at or after the
    target's newest ingestion ``hwm``, over one or several Bronze tables (UNION
    DISTINCT).  >=, so a same-instant reload is never missed.  ``hwm`` is a
    plain value, so with ``day``, the date column Bronze is partitioned by, the
    scan is pruned to the days from there on."""
    out = None
    for b in [bronze] if isinstance(bronze, DataFrame) else bronze:
        if hwm is not None:
            b = b.filter(F.col(ts) >= F.lit(hwm))
            b = b.filter(F.col(day) >= F.lit(hwm.date())) if day else b
        out = b.select(part) if out is None else out.unionByName(b.select(part))
    return out.distinct()


def incremental_build(target: Published, bronze: Sequence[DataFrame], part: str, ts: str, build: Callable[..., DataFrame],
                      label: str, target_ts: str | None = None, day: str | None = "ingestion_date") -> list[str]:
    """Rebuild the partitions that new Bronze rows touch, whole, and publish them.

    The first build takes all of Bronze.  After it, the target's newest
    ingestion time bounds the scan for affected values of ``part``; these prune
    the second scan of Bronze, which is partitioned by (``day``, ``part``), at
    run time.  ``build`` gets one frame a Bronze table, with every delivery of
    the affected partitions, so that latest-wins has each whole key.  Publishing
    is in two phases (data, then the pointer); returns the folders written.

    The affected values are broadcast: they are partition values of Bronze, as
    many as it has folders at most."""
    now = target.read()
    if now is None:
        return target.publish(lambda: build(*bronze), label)
    hwm = now.agg(F.max(target_ts or ts)).first()[0]

    def scoped() -> DataFrame:
        affected = F.broadcast(affected_partitions(bronze, hwm, part, ts, day))
        return build(*[b.join(affected, part, "left_semi") for b in bronze])

    return target.publish(scoped, label)


def overwrite_partitions(df: DataFrame, path: str, part: str | Sequence[str]) -> None:
    """Replace only the partitions present in ``df``."""
    parts = [part] if isinstance(part, str) else list(part)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def set_fingerprint(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """A21 for data-sized sets: an order-independent fingerprint computed
    map-side (XOR of a 60-bit SHA-256 prefix of each distinct code), plus
    the set size.  ``scope_fingerprint`` reproduces the sorted-list format
    but gathers the whole set of a scope in one task, so it is meant for
    configured scopes of bounded size."""
    distinct = df.select(*keys, F.col(code).cast("string").alias("_c")).distinct()
    h = F.conv(F.substring(F.sha2(F.col("_c"), 256), 1, 15), 16, 10).cast("bigint")
    return distinct.groupBy(*keys).agg(F.bit_xor(h).alias("fingerprint"), F.count(F.lit(1)).alias("n_codes"))


def reload_decision(current: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per scope of ``current``, whether Bronze is to be loaded again.

    ``current``: keys, ``extracted`` (fetched by this run), ``fingerprint`` of
    today's filter; ``manifest``: one row per archived scope with ``loaded`` and
    the ``fingerprint`` it was loaded under (NULL: not recorded, so load once).
    Reload when extracted, or archived but never loaded or loaded under
    another fingerprint; a scope with nothing archived has nothing to load."""
    stored = manifest.select(*keys, F.lit(True).alias("_archived"), F.coalesce("loaded", F.lit(False)).alias("_loaded"),
                             F.col("fingerprint").alias("_stored"))
    same = F.coalesce(F.col("_stored") == F.col("fingerprint"), F.lit(False))
    reload = F.coalesce("extracted", F.lit(False)) | (F.col("_archived").isNotNull() & ~(F.col("_loaded") & same))
    return current.join(stored, list(keys), "left").select(*keys, reload.alias("reload"))


def fx_window_start(hwm_date) -> F.Column:
    """A18 (FX rule): re-read from the start of the high-water year, or of the
    previous year when the high-water mark is in January."""
    d = F.col(hwm_date) if isinstance(hwm_date, str) else hwm_date
    return F.when(F.month(d) == 1, F.make_date(F.year(d) - 1, F.lit(1), F.lit(1))).otherwise(
        F.make_date(F.year(d), F.lit(1), F.lit(1)))


def scope_growth(manifest: DataFrame, current_scope: DataFrame, scope_col: str, year_col: str, code_col: str,
                 latest_year: int, recent_years: int = 2) -> DataFrame:
    """Settled batches whose scope gained codes since they were fetched,
    plus every recent batch (always refetched).

    ``manifest``: one row per batch with ``year_col`` and ``scope_col``
    (array of codes fetched); ``current_scope``: the configured codes."""
    cur = current_scope.agg(F.array_sort(F.collect_set(code_col)).alias("_now"))
    j = manifest.crossJoin(F.broadcast(cur)).withColumn("added", F.array_except("_now", F.col(scope_col)))
    recent = F.col(year_col) >= F.lit(latest_year - recent_years)
    return j.filter((F.size("added") > 0) | recent).withColumn(
        "reason", F.when(recent, "recent").otherwise("scope_grew")).drop("_now")
