"""Visibility gate (survey C09, V8, I09).

Hidden codes are removed from every research-facing read with a left-anti
join (NOT EXISTS).  A code that is not in the registry stays visible, so an
empty registry is a no-op.  The registry has one row per hidden code; AQE
broadcasts it once its measured size allows and otherwise keeps a shuffle
join, so nothing is broadcast on an unchecked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visibility_gate(df: DataFrame, hidden: DataFrame, code_col: str, source: str | None = None,
                    hidden_code: str = "code", hidden_source: str = "source") -> DataFrame:
    h = hidden
    if source is not None:
        h = h.filter(F.col(hidden_source) == source)
    h = h.select(F.col(hidden_code).alias("_hidden_code")).distinct()
    return df.join(h, F.col(code_col) == F.col("_hidden_code"), "left_anti")


def scope_by_group(df: DataFrame, crosswalk: DataFrame, code_col: str, group_value: str,
                   cw_code: str = "code", cw_group: str = "group_id") -> DataFrame:
    """Restrict to a product group's codes through the crosswalk.

    An inner (semi) join: a group with no codes yields no rows, never the
    unscoped total.
    """
    codes = crosswalk.filter(F.col(cw_group) == group_value).select(F.col(cw_code).alias("_gc"))
    return df.join(codes, F.col(code_col) == F.col("_gc"), "left_semi")


def resolve_scope(catalog_current: DataFrame, configured: DataFrame, code_col: str,
                  ingestion_col: str = "ingestao") -> DataFrame:
    """The codes to ingest.

    All catalogue codes whose latest edit is active and not paused; where there
    is none, the configured list.  The choice is a one-row count joined to both
    candidates, so no count is pulled to the driver."""
    from strata.functions.columns import ingestion_effective

    cat = catalog_current.filter(ingestion_effective(ingestion_col) != "pausada").select(F.col(code_col).alias("code"))
    n = cat.agg(F.count(F.lit(1)).alias("_n"))
    b = configured.select(F.col(code_col).alias("code")).crossJoin(F.broadcast(n)).filter(F.col("_n") == 0)
    return cat.select("code", F.lit("catalog").alias("origin")).unionByName(b.select("code", F.lit("configured").alias("origin")))


def oversize_scope(scope: DataFrame, most: int) -> DataFrame:
    """A check row where a scope has more than ``most`` codes; the scope itself stays whole."""
    return scope.agg(F.count(F.lit(1)).alias("n_codes")).filter(F.col("n_codes") > most)
