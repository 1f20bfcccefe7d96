"""Quality scoring (survey E05, E06, B25-B31, J16, D19).

Group percentiles are exact (``percentile_cont`` semantics).  Distinct values
are ranked with the range-partitioned scan of ``ordered`` and the two values
around each target rank are picked by an aggregate, so no group (a hot
product) is held in one task.  The per-group statistics (one row per
group) are then joined back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.columns import quality_flag, safe_divide, safe_ln
from strata.operators.ordered import BLOCK, blocked
from strata.session import stored, stored_alone

# The reference's defaults for the implied-price detector.
MIN_OBS = 100
VALUE_FLOOR = 100_000.0
PRICE_K = 100.0
OUTLIER_K = 4.0
# Bins of logs a unit: a power of two, so that scaling is exact. Logs of doubles lie within 746 of 0.
LOG_BINS = 64.0


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                      method: str = "auto", count: str | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value`` per group.

    Returns one row per group with one column per entry of ``probs``, and the
    number of its values as ``count`` if named.
    NULL values are ignored; a group with no values gets no row.

    Both paths start from distinct (group, value) counts, combined map-side.

    * ``aggregate``: Spark's exact ``percentile`` with those counts as
      frequencies.  One task holds a group's distinct values, so it is for
      groups of bounded cardinality.
    * ``blocks`` and ``auto``: the skew-safe path; no group is held in one task.
    """
    dist = (df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    if method == "aggregate":
        return _percentiles_aggregate(dist, keys, probs, count)
    return _percentiles_blocks(dist, keys, probs, count)


def _percentiles_aggregate(dist: DataFrame, keys: Sequence[str], probs: Mapping[str, float], count: str | None = None) -> DataFrame:
    names = list(probs)
    p = dist.groupBy(*keys).agg(
        F.percentile("_v", F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_c")).alias("_p"), F.sum("_c").alias("_n"))
    return p.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], *[F.col("_n").alias(c) for c in [count] if c])


def _percentiles_blocks(dist: DataFrame, keys: Sequence[str], probs: Mapping[str, float], count: str | None = None) -> DataFrame:
    """Skew-safe exact percentiles over distinct (group, value, count) rows.

    Plan: range-partitioned blocks pinned by a checkpoint -> one small
    per-block summary (count, offset of earlier blocks, group total) -> a
    running count inside each block -> the two values around each target
    rank are picked by an aggregate.  No group is held in one task.
    """
    b = blocked(dist, keys, ["_v"])
    summary = b.groupBy(BLOCK, *keys).agg(F.sum("_c").alias("_bc"))
    wk = Window.partitionBy(*keys)
    summary = summary.withColumn(
        "_off", F.coalesce(F.sum("_bc").over(wk.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_n", F.sum("_bc").over(wk)).drop("_bc")
    w = Window.partitionBy(BLOCK, *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_lcum", F.sum("_c").over(w))
    j = local.join(summary, [BLOCK, *keys]).withColumn("_cum", F.col("_off") + F.col("_lcum"))
    first = F.col("_cum") - F.col("_c")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo < F.col("_cum")), F.col("_v"))).alias(f"_{name}_lo"),
            F.max(F.when((first <= hi) & (hi < F.col("_cum")), F.col("_v"))).alias(f"_{name}_hi"),
            F.max(pos - lo).alias(f"_{name}_d"),
        ]
    g = j.groupBy(*keys).agg(*aggs, F.max("_n").alias("_n"))
    cols = [F.col("_n").alias(count)] if count else []
    for name in probs:
        lo, hi, d = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_d")
        cols.append((lo + d * (hi - lo)).alias(name))
    return g.select(*keys, *cols)


def log_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], count: str | None = None) -> DataFrame:
    """``exact_percentiles`` of a column of logarithms, which is read twice: store it before.

    Rows are first counted in bins (combined map-side, a bounded number a
    group).  Only rows of the bins that hold a target rank are ranked by value;
    each other bin stands as one value with its count, which leaves every rank
    as it is."""
    v = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_b", F.rint(F.col("_v") * LOG_BINS))
    n, cum = F.sum("_c").over(Window.partitionBy(*keys)), F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    bins = v.groupBy(*keys, "_b").agg(F.min("_v").alias("_v"), F.count(F.lit(1)).alias("_c")).withColumns({"_n": n, "_cum": cum})
    hit = F.lit(False)
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for rank in (F.floor(pos), F.ceil(pos)):
            hit = hit | ((F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum")))
    bins = stored(bins.select(*keys, "_b", "_v", "_c", hit.alias("_hit")), "bins")
    ranked = v.join(bins.filter("_hit").select(*keys, "_b"), [*keys, "_b"], "left_semi").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _percentiles_blocks(ranked.unionByName(bins.filter("NOT _hit").select(*keys, "_v", "_c")), keys, probs, count)


def implied_price_levels(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    qty: str,
    min_obs: int = MIN_OBS,
    value_floor: float = VALUE_FLOOR,
    price_k: float = PRICE_K,
    outlier_k: float = OUTLIER_K,
) -> DataFrame:
    """Adds ``val_level`` and ``qty_level`` ('problematic' |
    'outlier' | NULL) from implied-price consistency within ``group``.

    * problematic: |ln(price) - median ln(price)| >= ln(price_k), attributed
      to the measure with the larger |excess| (ties go to the value);
    * outlier: excess = (ln x - median) / (p75 - median) >= outlier_k;
    * guard: both measures positive, a price median, at least ``min_obs``
      priced rows in the group, value >= ``value_floor``.
    """
    d = (
        df.withColumn("_lp", safe_ln(safe_divide(value, qty)))
        .withColumn("_lv", safe_ln(value))
        .withColumn("_lq", safe_ln(qty))
    )
    # One ranked pass for all measures: the logs are stored, then stacked as (group,
    # measure id, value) so a single scan serves them (0 = implied price,
    # 1 = value, 2 = quantity, all as natural logs; 3 = a constant for each row
    # that has a price, whose count is that of the priced rows).
    priced = F.when(safe_divide(value, qty).isNotNull(), F.lit(0.0)).alias("_one")
    logs = stored(d.select(*group, "_lp", "_lv", "_lq", priced), "logs")
    stacked = logs.select(
        *group,
        F.explode(F.array(
            F.struct(F.lit(0).alias("_m"), F.col("_lp").alias("_x")),
            F.struct(F.lit(1).alias("_m"), F.col("_lv").alias("_x")),
            F.struct(F.lit(2).alias("_m"), F.col("_lq").alias("_x")),
            F.struct(F.lit(3).alias("_m"), F.col("_one").alias("_x")),
        )).alias("_s"),
    ).select(*group, "_s._m", "_s._x")
    pct = log_percentiles(stacked, [*group, "_m"], "_x", {"_p50": 0.5, "_p75": 0.75}, count="_rows")
    stats = pct.groupBy(*group).agg(
        F.max(F.when(F.col("_m") == 0, F.col("_p50"))).alias("_q_ln_med_price"),
        F.max(F.when(F.col("_m") == 1, F.col("_p50"))).alias("_q_ln_med_val"),
        F.max(F.when(F.col("_m") == 1, F.col("_p75"))).alias("_q_p75_val"),
        F.max(F.when(F.col("_m") == 2, F.col("_p50"))).alias("_q_ln_med_qty"),
        F.max(F.when(F.col("_m") == 2, F.col("_p75"))).alias("_q_p75_qty"),
        F.max(F.when(F.col("_m") == 3, F.col("_rows"))).alias("_q_n"),
    )
    # One row a group: stored, so its size is known and the rows are not shuffled by their few groups.
    s = d.join(stored(stats, "levels"), list(group), "left")

    v, q = F.col(value), F.col(qty)
    guard = (
        v.isNull() | (v <= 0) | q.isNull() | (q <= 0) | F.col("_q_ln_med_price").isNull()
        | (F.col("_q_n") < min_obs) | (v < value_floor)
    )
    dev = F.abs(F.col("_lp") - F.col("_q_ln_med_price"))
    vex = safe_divide(F.col("_lv") - F.col("_q_ln_med_val"), F.nullif(F.col("_q_p75_val") - F.col("_q_ln_med_val"), F.lit(0.0)))
    qex = safe_divide(F.col("_lq") - F.col("_q_ln_med_qty"), F.nullif(F.col("_q_p75_qty") - F.col("_q_ln_med_qty"), F.lit(0.0)))
    k = math.log(price_k)
    val_level = (
        F.when(guard, F.lit(None).cast("string"))
        .when((dev >= k) & (F.abs(vex) >= F.abs(qex)), "problematic")
        .when(vex >= outlier_k, "outlier")
    )
    qty_level = (
        F.when(guard, F.lit(None).cast("string"))
        .when((dev >= k) & (F.abs(qex) > F.abs(vex)), "problematic")
        .when(qex >= outlier_k, "outlier")
    )
    drop = ["_lp", "_lv", "_lq", "_q_n", "_q_ln_med_price", "_q_ln_med_val", "_q_p75_val", "_q_ln_med_qty", "_q_p75_qty"]
    return s.withColumn("val_level", val_level).withColumn("qty_level", qty_level).drop(*drop)


def flag_rows(df: DataFrame, qty: str, value: str) -> DataFrame:
    """B26 on already scored rows."""
    return df.withColumn("data_quality_flag", quality_flag(qty, value, "qty_level", "val_level"))


def quality_by_source(flagged: Mapping[str, DataFrame], flag_col: str = "data_quality_flag", one_by_one: SparkSession | None = None) -> DataFrame:
    """Flag counts per source with the share of the source's rows
    (the window runs over the small count table, one row per flag).

    ``one_by_one``: a session by which the counts of a source are stored before the
    next source is asked for, and what was stored on the way to them is removed."""
    parts = None
    for name in flagged:
        count = lambda: flagged[name].groupBy(flag_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("source", F.lit(name))  # noqa: B023, E731
        c = stored_alone(one_by_one, count, "flags") if one_by_one else count()
        parts = c if parts is None else parts.unionByName(c)
    w = Window.partitionBy("source")
    return parts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(w))
