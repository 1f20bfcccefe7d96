"""Data-quality assertions (survey L01-L21).

Each check returns the failing rows (empty = pass) with ``check`` and
``severity`` columns, so a suite of checks is a union of DataFrames and
runs as Spark jobs, never as driver loops over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, WARN = "error", "warn"


def _tag(df: DataFrame, name: str, severity: str) -> DataFrame:
    return df.withColumn("check", F.lit(name)).withColumn("severity", F.lit(severity))


def not_null(df: DataFrame, cols: Sequence[str], name: str = "not_null", severity: str = ERROR) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else cond | F.col(c).isNull()
    return _tag(df.filter(cond), name, severity)


def accepted_values(df: DataFrame, col: str, values: Sequence, name: str = "accepted_values", severity: str = ERROR) -> DataFrame:
    return _tag(df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(values))), name, severity)


def relationships(df: DataFrame, col: str, parent: DataFrame, parent_col: str, name: str = "relationships",
                  severity: str = ERROR) -> DataFrame:
    p = parent.select(F.col(parent_col).alias("_pk")).distinct()
    return _tag(df.filter(F.col(col).isNotNull()).join(p, F.col(col) == F.col("_pk"), "left_anti"), name, severity)


def expression_is_true(df: DataFrame, expr: Column, name: str = "expression_is_true", severity: str = ERROR) -> DataFrame:
    return _tag(df.filter(~F.coalesce(expr, F.lit(False))), name, severity)


def unique_combination(df: DataFrame, cols: Sequence[str], name: str = "unique_combination", severity: str = ERROR) -> DataFrame:
    """Keys that occur more than once."""
    return _tag(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), name, severity)


def conserved(a: DataFrame, b: DataFrame, measures: Sequence[str], keys: Sequence[str] = (), rel_tol: float = 1e-6,
              name: str = "conservation", severity: str = ERROR) -> DataFrame:
    """Totals of ``measures`` agree between two layers (per key),
    within a relative tolerance; returns the disagreeing totals.  Without
    keys the two one-row totals are cross-joined (the C27 scalar-subquery
    form)."""
    sa = (a.groupBy(*keys) if keys else a.groupBy()).agg(*[F.sum(m).alias(f"a_{m}") for m in measures])
    sb = (b.groupBy(*keys) if keys else b.groupBy()).agg(*[F.sum(m).alias(f"b_{m}") for m in measures])
    j = sa.join(sb, list(keys), "full_outer") if keys else sa.crossJoin(sb)
    bad = None
    for m in measures:
        x, y = F.coalesce(F.col(f"a_{m}"), F.lit(0.0)), F.coalesce(F.col(f"b_{m}"), F.lit(0.0))
        c = F.abs(x - y) > F.lit(rel_tol) * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        bad = c if bad is None else bad | c
    return _tag(j.filter(bad), name, severity)


def range_overlaps(ranges: DataFrame, key: str, lo: str, hi: str, id_col: str, name: str = "range_overlap",
                   severity: str = ERROR) -> DataFrame:
    """Ranges that overlap an earlier range of the same key.

    Ranges are ordered by start within the key; a range overlaps some
    earlier one exactly when its start is at or below the largest end seen
    before it.  One sorted pass per key: no pairs are formed."""
    r = ranges.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    w = Window.partitionBy("k").orderBy("lo", "hi", "id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("prev_max_hi", F.max("hi").over(w))
    return _tag(r.filter(F.col("lo") <= F.col("prev_max_hi")), name, severity)


def bounded(df: DataFrame, expr: Column, lo: float, hi: float, name: str = "bounded", severity: str = ERROR) -> DataFrame:
    """Rows whose expression falls outside [lo, hi] (NULL passes)."""
    return _tag(df.withColumn("_x", expr).filter(F.col("_x").isNotNull() & ((F.col("_x") < lo) | (F.col("_x") > hi))), name, severity)


def non_empty(df: DataFrame, name: str = "has_rows", severity: str = ERROR) -> DataFrame:
    """One failing row when the table is empty."""
    return _tag(df.agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") == 0), name, severity)


def single_value_per_key(df: DataFrame, key: Sequence[str], col: str, name: str, severity: str = WARN) -> DataFrame:
    """Keys with more than one distinct value, listed."""
    g = df.groupBy(*key).agg(
        F.count_distinct(col).alias("n_values"),
        F.array_join(F.sort_array(F.collect_set(col)), ", ").alias("values"),
    )
    return _tag(g.filter(F.col("n_values") > 1), name, severity)


def run_suite(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per check: name, severity and the number of failing rows.

    Each check is counted by its own aggregate; the report is their union,
    so the whole suite is one Spark job with no driver-side loop over rows."""
    from functools import reduce

    parts = [
        failing.agg(F.count(F.lit(1)).alias("n_failing")).select(
            F.lit(name).alias("check"), F.lit(sev).alias("severity"), "n_failing")
        for name, (failing, sev) in checks.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def hierarchy_consistent(child: DataFrame, parent: DataFrame, child_key: str, child_parent: str, parent_key: str,
                         child_attr: str, parent_attr: str, name: str = "hierarchy_consistent",
                         severity: str = ERROR) -> DataFrame:
    """Children whose denormalised ancestor attribute disagrees with the
    parent row (NULL-safe)."""
    p = parent.select(F.col(parent_key).alias("_pk"), F.col(parent_attr).alias("_pattr"))
    j = child.join(p, F.col(child_parent) == F.col("_pk"), "left")
    return _tag(j.filter(~F.col(child_attr).eqNullSafe(F.col("_pattr"))).drop("_pk", "_pattr"), name, severity)


def family_base_coherent(units: DataFrame, name: str = "family_base_coherent", severity: str = ERROR) -> DataFrame:
    """Every family maps to exactly one base unit."""
    g = units.groupBy("family").agg(F.count_distinct("base_unit").alias("n_base"))
    return _tag(g.filter(F.col("n_base") != 1), name, severity)


def marts_present(spark, names: Sequence[str]) -> DataFrame:
    """Each expected table exists and is non-empty (one row per name)."""
    rows = []
    for n in names:
        exists = spark.catalog.tableExists(n)
        rows.append((n, exists, spark.table(n).limit(1).count() > 0 if exists else False))
    return spark.createDataFrame(rows, "table string, exists boolean, non_empty boolean")


def forbidden_values(df: DataFrame, col: str, values: Sequence, name: str = "forbidden_values",
                     severity: str = WARN) -> DataFrame:
    """Rows carrying a value that must not appear (e.g. a gross-weight unit)."""
    return _tag(df.filter(F.lower(F.col(col)).isin([str(v).lower() for v in values])), name, severity)


def series_nonempty(df: DataFrame, series: DataFrame, key: str, name: str = "series_nonempty",
                    severity: str = ERROR) -> DataFrame:
    """Configured series with no rows at all (a cold, fully empty series
    is an error, while an empty delta window is not)."""
    return _tag(series.select(key).join(df.select(key).distinct(), key, "left_anti"), name, severity)
