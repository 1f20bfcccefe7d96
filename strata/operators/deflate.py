"""Currency and inflation deflation (survey D04-D08, C05, C06, V4, V5).

The index and FX inputs are small, bounded series (one row per series per
month, or per currency per day).  Their one-row "latest" summaries are
cross-joined as broadcasts: one row is a proven size bound.  The per-year
tables have one row per year, a bound too, and are broadcast: the fact is
never shuffled by its few years.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import safe_divide

# The deflator series (name -> default series code), the
# foreign currencies, the first year with foreign-currency year values,
# the euro's first year and the 1994 changeover date.
DEFLATORS: dict[str, str] = {"ipca": "433", "igpm": "189", "igpdi": "190"}
CURRENCIES: dict[str, str] = {"usd": "USD", "eur": "EUR"}
FIRST_FX_YEAR = 1994
EURO_FIRST_YEAR = 1999
CHANGEOVER_DATE = "1994-07-01"


def year_end_index(
    index: DataFrame,
    deflators: Mapping[str, str] = DEFLATORS,
    series_col: str = "series_code",
    year_col: str = "reference_year",
    month_col: str = "reference_month",
    value_col: str = "index_value",
) -> DataFrame:
    """The last available month's index per year, one column per deflator."""
    last = (
        index.filter(F.col(value_col).isNotNull())
        .groupBy(year_col, series_col)
        .agg(F.max_by(value_col, month_col).alias("_v"))
    )
    return last.groupBy(year_col).agg(
        *[F.max(F.when(F.col(series_col) == code, F.col("_v"))).alias(f"{name}_year_end") for name, code in deflators.items()]
    )


def latest_index(
    index: DataFrame,
    deflators: Mapping[str, str] = DEFLATORS,
    series_col: str = "series_code",
    date_col: str = "reference_date",
    value_col: str = "index_value",
) -> DataFrame:
    """One row with the newest index of every deflator."""
    last = (
        index.filter(F.col(value_col).isNotNull())
        .groupBy(series_col)
        .agg(F.max_by(value_col, date_col).alias("_v"))
    )
    return last.agg(
        *[F.max(F.when(F.col(series_col) == code, F.col("_v"))).alias(f"{name}_current") for name, code in deflators.items()]
    )


def fx_year_average(
    fx: DataFrame,
    currencies: Mapping[str, str] = CURRENCIES,
    currency_col: str = "currency",
    year_col: str = "reference_year",
    date_col: str = "reference_date",
    rate_col: str = "brl_per_foreign_unit",
) -> DataFrame:
    """Yearly average rate per currency.

    1994 averages only the new-currency half (dates >= 1994-07-01); the euro
    average is NULL before 1999.
    """
    guarded = fx.filter(F.col(rate_col).isNotNull()).filter(
        (F.col(year_col) != FIRST_FX_YEAR) | (F.col(date_col) >= F.lit(CHANGEOVER_DATE).cast("date"))
    )
    aggs = []
    for name, code in currencies.items():
        cond = F.col(currency_col) == code
        if code == "EUR":
            cond = cond & (F.col(year_col) >= EURO_FIRST_YEAR)
        aggs.append(F.avg(F.when(cond, F.col(rate_col))).alias(f"brl_per_{name}_avg"))
    return guarded.groupBy(year_col).agg(*aggs)


def fx_month_average(
    fx: DataFrame,
    currencies: Mapping[str, str] = CURRENCIES,
    currency_col: str = "currency",
    year_col: str = "reference_year",
    month_col: str = "reference_month",
    rate_col: str = "brl_per_foreign_unit",
) -> DataFrame:
    """Monthly average rate per currency (euro NULL before 1999)."""
    aggs = []
    for name, code in currencies.items():
        cond = F.col(currency_col) == code
        if code == "EUR":
            cond = cond & (F.col(year_col) >= EURO_FIRST_YEAR)
        aggs.append(F.avg(F.when(cond, F.col(rate_col))).alias(f"brl_per_{name}_avg"))
    return fx.filter(F.col(rate_col).isNotNull()).groupBy(year_col, month_col).agg(*aggs)


def fx_latest(
    fx: DataFrame,
    currencies: Mapping[str, str] = CURRENCIES,
    currency_col: str = "currency",
    date_col: str = "reference_date",
    rate_col: str = "brl_per_foreign_unit",
) -> DataFrame:
    """One row with the newest rate of every currency."""
    last = (
        fx.filter(F.col(rate_col).isNotNull())
        .groupBy(currency_col)
        .agg(F.max_by(rate_col, date_col).alias("_r"))
    )
    return last.agg(
        *[F.max(F.when(F.col(currency_col) == code, F.col("_r"))).alias(f"brl_per_{name}_current") for name, code in currencies.items()]
    )


def deflate(
    fact: DataFrame,
    value_col: str,
    year_end: DataFrame,
    latest: DataFrame,
    fx_year: DataFrame,
    fx_last: DataFrame,
    year_col: str = "reference_year",
    deflators: Sequence[str] = tuple(DEFLATORS),
    currencies: Sequence[str] = tuple(CURRENCIES),
    keep_inputs: bool = False,
) -> DataFrame:
    """C05 + V4/V5: the full value matrix of a BRL value column.

    * ``val_yearfx_brl`` = value; ``val_yearfx_<cur>`` = value / year-average
      rate, NULL before 1994.
    * ``val_real_<defl>_brl`` = value x latest index / year-end index;
      ``val_real_<defl>_<cur>`` = that / latest rate.
    """
    j = (
        fact.join(F.broadcast(fx_year), year_col, "left")
        .join(F.broadcast(year_end), year_col, "left")
        .crossJoin(F.broadcast(latest))
        .crossJoin(F.broadcast(fx_last))
    )
    v = F.col(value_col)
    out = j.withColumn("val_yearfx_brl", v)
    for cur in currencies:
        out = out.withColumn(
            f"val_yearfx_{cur}",
            F.when(F.col(year_col) >= FIRST_FX_YEAR, safe_divide(v, F.col(f"brl_per_{cur}_avg"))),
        )
    for d in deflators:
        real = v * safe_divide(F.col(f"{d}_current"), F.col(f"{d}_year_end"))
        out = out.withColumn(f"val_real_{d}_brl", real)
        for cur in currencies:
            out = out.withColumn(
                f"val_real_{d}_{cur}", safe_divide(F.col(f"val_real_{d}_brl"), F.col(f"brl_per_{cur}_current"))
            )
    if not keep_inputs:
        drop = [f"brl_per_{c}_avg" for c in currencies] + [f"brl_per_{c}_current" for c in currencies]
        drop += [f"{d}_year_end" for d in deflators] + [f"{d}_current" for d in deflators]
        out = out.drop(*drop)
    return out


VALUE_MATRIX = ["val_yearfx_brl", "val_yearfx_usd", "val_yearfx_eur"] + [
    f"val_real_{d}_{c}" for d in DEFLATORS for c in ("brl", "usd", "eur")
]
