"""Deduplication operators (survey E01, E02, E09, E13).

``latest_wins`` keeps one row per key: the one ordered first by the given
descending order.  Spark plans ``row_number() = 1`` with a partial
``WindowGroupLimit`` before the shuffle, so each map task forwards at most
one row per key: a key holding a third of all rows costs one row per map
partition in the exchange, not a third of the data in one task.

``latest_batch`` keeps the rows of the newest batch per scope.  It is an
aggregate plus a join instead of a ``max() over (scope)`` window: the
window would buffer a whole scope in one task, while the aggregate is
combined map-side and the one-row-per-scope result is joined back (AQE
broadcasts it once its measured size is under the threshold and splits a
skewed partition otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OrderSpec = Sequence["str | Column"]


def _desc(c) -> Column:
    if isinstance(c, str):
        return F.col(c).desc_nulls_last()
    return c


def latest_wins(df: DataFrame, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """One row per ``keys``, the first by ``order``.

    ``order`` lists columns meaning "newest first" (plain names sort
    descending, nulls last); pass explicit ``Column`` sort expressions for
    other directions, e.g. a boolean tie-break (E09).
    """
    w = Window.partitionBy(*keys).orderBy(*[_desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_batch(df: DataFrame, scope: Sequence[str], batch_col: str) -> DataFrame:
    """Keep only rows whose ``batch_col`` equals the scope's maximum.

    A restated batch replaces the earlier one for the whole scope.
    """
    newest = df.groupBy(*scope).agg(F.max(batch_col).alias("_newest"))
    return (
        df.join(newest, list(scope), "inner")
        .filter(F.col(batch_col) == F.col("_newest"))
        .drop("_newest")
    )


def batch_then_row_dedup(
    df: DataFrame,
    scope: Sequence[str],
    batch_col: str,
    keys: Sequence[str],
    order: OrderSpec,
) -> DataFrame:
    """E02 then E01 (the order matters: T11)."""
    return latest_wins(latest_batch(df, scope, batch_col), keys, order)


def prefer_not(col: str, bad_value) -> Column:
    """E09 tie-break: rows where ``col == bad_value`` sort after the others."""
    return (F.col(col) == F.lit(bad_value)).asc_nulls_last()


def first_seen(df: DataFrame, key: str, order: OrderSpec) -> DataFrame:
    """K02/M03 intake: the first row per id (idempotent append)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
