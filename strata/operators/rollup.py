"""Roll-ups: long-to-wide pivots, dominant-unit cells, marts (survey D01-D03,
D09-D18, D20-D23, D28, E04).

Every roll-up here is an aggregate with a map-side partial step, so a hot
group is reduced per map task before the shuffle.  Window-shaped rules of
the reference (``first_value over cell order by qty``) are re-expressed as
two aggregates over a pre-aggregated (cell, unit) table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_to_wide(
    df: DataFrame,
    keys: Sequence[str],
    variable_col: str,
    value_col: str,
    variables: Mapping[str, object],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with one column per variable (conditional
    max: one row per variable per key), keeping keys with any measure."""
    aggs = [F.max(F.when(F.col(variable_col) == F.lit(v), F.col(value_col))).alias(name) for name, v in variables.items()]
    wide = df.groupBy(*keys).agg(*aggs, *extra)
    present = None
    for name in variables:
        cond = F.col(name).isNotNull()
        present = cond if present is None else present | cond
    return wide.filter(present)


def dominant_unit_rollup(
    df: DataFrame,
    cell: Sequence[str],
    unit_col: str,
    qty_col: str,
    sum_cols: Sequence[str] = (),
    unit_sum_cols: Sequence[str] = (),
    unit_labels: Sequence[str] = (),
    max_cols: Sequence[str] = (),
    labels_are_keys: bool = False,
) -> DataFrame:
    """Per cell, the dominant unit is the unit of the row with
    the largest quantity (NULL quantities last, ties to the smaller unit
    code).  Quantities (``qty_col`` and ``unit_sum_cols``) are summed only
    over that unit's rows; ``sum_cols`` (money, weight) over all rows.
    ``unit_labels`` are lifted from the dominant unit.

    ``labels_are_keys``: the labels are functionally dependent on (cell,
    unit) (e.g. joined from a unit table), so they are carried as grouping
    keys of the first aggregate.  That keeps every aggregation buffer
    fixed-width, so the large first aggregate runs as a hash aggregate
    instead of sorting on string buffers.
    """
    label_keys = list(unit_labels) if labels_are_keys else []
    per_unit = df.groupBy(*cell, unit_col, *label_keys).agg(
        F.max(qty_col).alias("_qmax"),
        F.sum(qty_col).alias("_q"),
        *[F.sum(c).alias(f"_u_{c}") for c in unit_sum_cols],
        *[F.sum(c).alias(f"_s_{c}") for c in sum_cols],
        *([] if labels_are_keys else [F.max(c).alias(f"_l_{c}") for c in unit_labels]),
        *[F.max(c).alias(f"_m_{c}") for c in max_cols],
        F.count(F.lit(1)).alias("_rows"),
    )
    if labels_are_keys:
        per_unit = per_unit.select("*", *[F.col(c).alias(f"_l_{c}") for c in unit_labels])
    rank_key = F.struct(F.col("_qmax").isNull(), -F.col("_qmax"), F.col(unit_col))
    picked = F.struct(
        F.col(unit_col).alias(unit_col),
        F.col("_q").alias(qty_col),
        *[F.col(f"_u_{c}").alias(c) for c in unit_sum_cols],
        *[F.col(f"_l_{c}").alias(c) for c in unit_labels],
    )
    out = per_unit.groupBy(*cell).agg(
        F.min_by(picked, rank_key).alias("_dom"),
        *[F.sum(f"_s_{c}").alias(c) for c in sum_cols],
        *[F.max(f"_m_{c}").alias(c) for c in max_cols],
        F.sum("_rows").alias("source_rows"),
    )
    return out.select(*cell, "_dom.*", *sum_cols, *max_cols, "source_rows")


def mart(
    df: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = (),
    distinct_counts: Mapping[str, str] | None = None,
    maxes: Sequence[str] = (),
    rows: str | None = "source_rows",
) -> DataFrame:
    """A serving mart at ``keys`` grain."""
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.count_distinct(F.col(src)).alias(name) for name, src in (distinct_counts or {}).items()]
    aggs += [F.max(c).alias(c) for c in maxes]
    if rows:
        aggs.append(F.count(F.lit(1)).alias(rows))
    return df.groupBy(*keys).agg(*aggs)


def family_sums(family_col: str, qty_col: str, families: Mapping[str, str] | None = None) -> list[Column]:
    """Conditional sums per unit family (never summed across families)."""
    families = families or {"q_mass": "massa", "q_vol": "volume", "q_count": "contagem"}
    return [F.sum(F.when(F.col(family_col) == fam, F.col(qty_col))).alias(name) for name, fam in families.items()]


def flow_only_sum(kind_col: str, value_col: str, alias: str) -> Column:
    """Value summed over flow rows only (a herd stock is not a flow)."""
    return F.sum(F.when(F.col(kind_col) == "flow", F.col(value_col))).alias(alias)


def ratio_of_sums(num: str, den: str, scale: float = 1.0) -> Column:
    """A ratio recomputed from sums, never an average of ratios."""
    return F.try_divide(F.sum(num) * F.lit(scale), F.sum(den))


def source_metadata(parts: Mapping[str, DataFrame], year: str, product: str, state: str, refresh: str) -> DataFrame:
    """Per source: year span, rows, distinct products and states, last
    refresh.  An empty source yields no row."""
    out = None
    for name, df in parts.items():
        m = df.agg(
            F.min(year).alias("min_year"),
            F.max(year).alias("max_year"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(product).alias("n_products"),
            F.count_distinct(state).alias("n_states"),
            F.max(refresh).alias("last_refresh"),
        ).withColumn("source", F.lit(name))
        m = m.filter(F.col("n_rows") > 0)
        out = m if out is None else out.unionByName(m)
    return out
