"""Index and currency Silver from verbatim Bronze strings.

Bronze is append-only: a point may be delivered several times, its date or
value may not parse, and series dropped from the configuration stay in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators.dedup import latest_wins
from strata.operators.series import chain_index

# The reference's default series (index codes; code:currency pairs).
INDEX_SERIES = ("433", "189", "190")
CURRENCY_SERIES = "1:USD,21619:EUR"


def series_codes(pairs: str) -> list[str]:
    """The codes of a configured ``code:name,code:name`` list; blank entries are skipped."""
    return [p.split(":")[0].strip() for p in pairs.split(",") if p.strip()]


def _points(bronze: DataFrame, codes: Sequence[str], label: str, value: str) -> DataFrame:
    """Newest delivery of each configured (series, date string), typed; bad dates dropped."""
    d = latest_wins(bronze.filter(F.col("series_code").isin(list(codes))), ["series_code", "reference_date_str"], ["ingestion_timestamp"])
    d = d.select("series_code", label, C.safe_date("reference_date_str").alias("reference_date"),
                 C.safe_numeric("value_str").alias(value), "ingestion_timestamp")
    return d.filter(F.col("reference_date").isNotNull()).withColumns(
        {"reference_year": F.year("reference_date"), "reference_month": F.month("reference_date")})


def index_silver(bronze: DataFrame, codes: Sequence[str] = INDEX_SERIES) -> DataFrame:
    """Monthly changes of the configured index series and their chain index."""
    return chain_index(_points(bronze, codes, "series_name", "monthly_pct_change"), ["series_code"], "reference_date", "monthly_pct_change")


def fx_silver(bronze: DataFrame, pairs: str = CURRENCY_SERIES) -> DataFrame:
    """Fixings of the configured currency series; an unreadable value stays as a NULL point."""
    return _points(bronze, series_codes(pairs), "currency", "brl_per_foreign_unit")
