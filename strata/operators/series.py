"""Time-series operators (survey E03, E10, E14, E16, J01-J08, J13-J15, J17).

Inputs here are already aggregated series, one row per (series, period),
so a window per series holds at most one row per period and cannot grow
with the fact table.  Statistics that reduce a series to one number are
plain aggregates (combined map-side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import safe_ln


def chain_index(
    df: DataFrame, keys: Sequence[str], order: str, pct_col: str, out: str = "index_value", base: float = 100.0
) -> DataFrame:
    """``base * exp(running sum of ln(1 + p/100))`` per series.

    Rows with a NULL change are dropped first; a change <= -100 % has no
    logarithm and is skipped by the running sum (T13).
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.filter(F.col(pct_col).isNotNull()).withColumn(
        out, F.lit(base) * F.exp(F.sum(safe_ln(F.lit(1.0) + F.col(pct_col) / F.lit(100.0))).over(w))
    )


def pct_change(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Percent change against the previous period of the same series."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumn(out, F.lit(100.0) * (F.try_divide(F.col(value), prev) - F.lit(1.0)))


def month_gaps(df: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    """Rows whose previous point is more than one month earlier."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    prev = F.lag(date_col).over(w)
    gap = F.months_between(F.col(date_col), prev).cast("int")
    return (
        df.withColumn("prev_date", prev)
        .withColumn("gap_months", gap)
        .filter(F.col("gap_months") > 1)
    )


def yoy(df: DataFrame, keys: Sequence[str], year: str, value: str, out: str = "yoy") -> DataFrame:
    """Growth in percent versus the previous point; a zero or missing base gives 0."""
    w = Window.partitionBy(*keys).orderBy(year)
    prev = F.lag(value).over(w)
    growth = F.when(prev.isNull() | (prev == 0), F.lit(0.0)).otherwise((F.col(value) - prev) / prev * 100)
    return df.withColumn("_prev", prev).withColumn(
        out, F.when(F.col("_prev").isNull(), F.lit(None).cast("double")).otherwise(growth)
    ).drop("_prev")


def rebase_100(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "base100") -> DataFrame:
    """Value / first value x 100 (NULL if the first value is 0)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.lit(100.0) * F.try_divide(F.col(value), F.first(value).over(w)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson r as an aggregate; 0 when n < 2 or a variance is zero.

    Built-in ``corr`` throws on zero variance under ANSI mode (T7).
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a * b) < 2, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def growth_pairs(a: DataFrame, b: DataFrame, keys_a: Sequence[str] = (), keys_b: Sequence[str] = (),
                 year: str = "year", value: str = "v") -> DataFrame:
    """YoY growth of two series over common, calendar-adjacent years.

    ``a`` and ``b`` are (keys..., year, value) series.  Years present in both
    are aligned by an inner join; growth is taken only between consecutive
    common years that are exactly one calendar year apart.
    """
    ka = [F.col(k).alias(f"a_{k}") for k in keys_a]
    kb = [F.col(k).alias(f"b_{k}") for k in keys_b]
    sa = a.select(*ka, F.col(year).alias("year"), F.col(value).alias("va"))
    sb = b.select(*kb, F.col(year).alias("year"), F.col(value).alias("vb"))
    both = sa.join(sb, "year", "inner")
    part = [f"a_{k}" for k in keys_a] + [f"b_{k}" for k in keys_b]
    w = Window.partitionBy(*part).orderBy("year")
    prev_year, pa, pb = F.lag("year").over(w), F.lag("va").over(w), F.lag("vb").over(w)
    g = (
        both.withColumn("_py", prev_year)
        .withColumn("_pa", pa)
        .withColumn("_pb", pb)
        .filter(F.col("_py").isNotNull() & (F.col("year") - F.col("_py") == 1))
    )
    ga = F.when(F.col("_pa").isNull() | (F.col("_pa") == 0), F.lit(0.0)).otherwise((F.col("va") - F.col("_pa")) / F.col("_pa"))
    gb = F.when(F.col("_pb").isNull() | (F.col("_pb") == 0), F.lit(0.0)).otherwise((F.col("vb") - F.col("_pb")) / F.col("_pb"))
    return g.select(*part, "year", ga.alias("ga"), gb.alias("gb"))


def cagr_pct(first_year, last_year, first_value, last_value) -> Column:
    """Compound annual growth in percent over the calendar span."""
    span = F.col(last_year) - F.col(first_year) if isinstance(last_year, str) else last_year - first_year
    p = F.when(span > 0, span).otherwise(F.lit(1))
    v0 = F.col(first_value) if isinstance(first_value, str) else first_value
    vt = F.col(last_value) if isinstance(last_value, str) else last_value
    return F.when(v0 > 0, (F.pow(vt / v0, F.lit(1.0) / p) - 1) * 100).otherwise(F.lit(0.0))


def accum_pct(first_value, last_value) -> Column:
    """Accumulated change in percent."""
    v0 = F.col(first_value) if isinstance(first_value, str) else first_value
    vt = F.col(last_value) if isinstance(last_value, str) else last_value
    return F.when(v0 > 0, (vt - v0) / v0 * 100).otherwise(F.lit(0.0))


def series_endpoints(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """First/last year and value per series (inputs of J04/J05)."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by(value, year).alias("first_value"),
        F.max_by(value, year).alias("last_value"),
        F.count(F.lit(1)).alias("n_points"),
    )


def ols_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and fitted endpoints; NULL when n < 2 or no x variance."""
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys)
        .agg(
            F.regr_slope(F.col(y), F.col(x)).alias("slope"),
            F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            F.min(x).alias("x0"),
            F.max(x).alias("x1"),
        )
        .withColumn("y0", F.col("slope") * F.col("x0") + F.col("intercept"))
        .withColumn("y1", F.col("slope") * F.col("x1") + F.col("intercept"))
    )


def stacked_year_max(df: DataFrame, year: str, value: str) -> DataFrame:
    """The largest per-year total across layers (0 when empty)."""
    per_year = df.groupBy(year).agg(F.sum(value).alias("total"))
    return per_year.agg(F.greatest(F.coalesce(F.max("total"), F.lit(0.0)), F.lit(0.0)).alias("stack_max"))


def peak_trough(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Peak and trough periods, their values and the amplitude."""
    return df.groupBy(*keys).agg(
        F.max_by(period, F.struct(F.col(value), F.col(period))).alias("peak_period"),
        F.max(value).alias("peak_value"),
        F.min_by(period, F.struct(F.col(value), F.col(period))).alias("trough_period"),
        F.min(value).alias("trough_value"),
    ).withColumn("amplitude", F.col("peak_value") - F.col("trough_value"))


def ratio_series(a: DataFrame, b: DataFrame, year: str, va: str, vb: str) -> DataFrame:
    """A / b x 100 on common years, with the mean ratio per result."""
    j = a.select(year, F.col(va).alias("va")).join(b.select(year, F.col(vb).alias("vb")), year, "inner")
    return j.withColumn("ratio", F.lit(100.0) * F.try_divide(F.col("va"), F.col("vb")))


def index_paired_growth(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "growth") -> DataFrame:
    """J06 (legacy): growth between consecutive *positions* of a series
    (ignores calendar gaps, unlike ``growth_pairs``); 0 on a zero base."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumn(out, F.when(prev.isNull(), F.lit(None).cast("double"))
                         .when(prev == 0, F.lit(0.0)).otherwise((F.col(value) - prev) / prev))


def co_moments(df: DataFrame, period: str, series: str, value: str) -> DataFrame:
    """For every pair of series, n, sums, squares and cross products over the periods both have.

    The facts are summed once per (period, series); a period's k series stand in
    one row, whose pairs are formed there, so the plan has no join, and the k * k
    rows of a period do not depend on the facts.  Moments of several loads of
    different periods add up (``correlations`` sums them)."""
    per = df.groupBy(period, series).agg(F.sum(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    rows = per.groupBy(period).agg(F.array_sort(F.collect_list(F.struct(F.col(series).alias("s"), "v"))).alias("k"))
    pair = lambda a, b: F.struct(a["s"].alias("series_a"), b["s"].alias("series_b"), a["v"].alias("x"), b["v"].alias("y"))
    pairs = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda b: pair(a, b))))
    x, y = F.col("x"), F.col("y")
    return rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("series_a", "series_b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def correlations(moments: DataFrame) -> DataFrame:
    """Pearson r of every pair, 0 when n < 2 or a series does not vary; moments of a pair are added up."""
    m = moments.groupBy("series_a", "series_b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    va, vb = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))))
    return m.select("series_a", "series_b", F.when(n < 2, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("r"), n.alias("n_years"))


# A KLL sketch of 200 answers a rank within 1.65 % of the rows, of all at once, 99 times in 100.
SKETCH_RANK_ERROR = 0.0165


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One mergeable quantile sketch a group, of bounded size whatever the rows."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], p: float, out: str) -> DataFrame:
    """The quantile of each group over the sketches of all loads, and its rows."""
    m = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return m.select(*by, F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(out), F.kll_sketch_get_n_double("sketch").alias("n_rows"))
