"""Concentration statistics (survey J09-J12, F05, I23).

Inputs are per-entity totals (one row per state, product or partner within
a group).  Ranks over a group use the skew-safe ordered scan or a top-n
filter with a partial group limit, so a group with very many entities is
never ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.ordered import ordered_columns


def gini(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str | None = None) -> DataFrame:
    """Gini over positive values, ``2*sum(i*v)/(n*sum v) - (n+1)/n``
    with values ascending and i from 1; 0 when n < 2 or the total is 0.

    The ranks come from the range-partitioned ordered scan, so a group with
    very many entities is spread over tasks (ties do not change the sum)."""
    pos = df.filter(F.col(value) > 0)
    order = [value] + ([tiebreak] if tiebreak else [])
    ranked = ordered_columns(pos, keys, order, row_number="_i")
    g = ranked.groupBy(*keys).agg(
        F.sum(F.col("_i") * F.col(value)).alias("_cum"),
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("_tot"),
    )
    val = F.when((F.col("n") < 2) | (F.col("_tot") == 0), F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("_cum") / (F.col("n") * F.col("_tot")) - (F.col("n") + 1) / F.col("n")
    )
    return g.select(*keys, "n", val.alias("gini"))


def hhi(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum of squared percentage shares; 0 when the total is 0."""
    tot = df.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    j = df.join(tot, list(keys))
    share = F.try_divide(F.col(value), F.col("_tot")) * F.lit(100.0)
    return j.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_tot") != 0, F.pow(share, 2))), F.lit(0.0)).alias("hhi")
    )


def _top(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str, n: int) -> DataFrame:
    """The n largest rows per group.  ``row_number() <= n`` as a filter is
    planned with a partial WindowGroupLimit before the shuffle, so each map
    task forwards at most n rows per group."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tiebreak).asc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)


def top_n_share(df: DataFrame, keys: Sequence[str], value: str, n: int, tiebreak: str) -> DataFrame:
    """Share of the n largest values in the total (total 0 -> /1)."""
    top = _top(df, keys, value, tiebreak, n).groupBy(*keys).agg(F.sum(value).alias("_top"))
    tot = df.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    g = tot.join(top, list(keys), "left")
    den = F.when(F.col("_tot") == 0, F.lit(1.0)).otherwise(F.col("_tot"))
    return g.select(*keys, (F.coalesce(F.col("_top"), F.lit(0.0)) / den).alias(f"top{n}_share"))


def lorenz(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str) -> DataFrame:
    """Lorenz points (population share, cumulative value share),
    with ranks and running sums from the skew-safe ordered scan."""
    pos = df.filter(F.col(value) > 0)
    r = ordered_columns(pos, keys, [value, tiebreak], value=value, row_number="_i", running_sum="_cum")
    tot = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_tot"))
    return r.join(tot, list(keys)).select(
        *keys, tiebreak, (F.col("_i") / F.col("_n")).alias("pop_share"), (F.col("_cum") / F.col("_tot")).alias("value_share")
    )


def head_and_others(df: DataFrame, keys: Sequence[str], label: str, value: str, head: int = 6, max_all: int = 7) -> DataFrame:
    """up to ``max_all`` entries are all kept; otherwise the top ``head``
    plus one 'others' row with the remainder; shares of the group total.

    Only the top ``max_all`` rows per group travel (partial group limit);
    counts and totals are plain aggregates."""
    top = _top(df, keys, value, label, max_all)
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_tot"))
    t = top.join(stats, list(keys))
    kept = t.filter((F.col("_n") <= max_all) | (F.col("_r") <= head)).select(
        *keys, F.col(label).alias("bucket"), F.col(value).alias(value), "_tot")
    head_sum = kept.groupBy(*keys).agg(F.sum(value).alias("_kept"))
    others = stats.filter(F.col("_n") > max_all).join(head_sum, list(keys)).select(
        *keys, F.lit("others").alias("bucket"), (F.col("_tot") - F.col("_kept")).alias(value), "_tot")
    out = kept.unionByName(others)
    return out.select(*keys, "bucket", value, F.try_divide(F.col(value), F.col("_tot")).alias("share"))
