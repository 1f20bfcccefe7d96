"""Skew-safe ordered windows: row number, lead, lag, running sums and last values per key.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to
one task, so a key holding a third of the rows becomes a third of the job
in one task.  Here the rows are range-partitioned on ``(key, order)``
instead, so a hot key is cut into consecutive *blocks* that live in
different partitions.  Each block is processed locally (a window keyed by
``(block, key)``, bounded by the partition size), and the block seams are
stitched with a per-block summary table that has at most one row per
``(block, key)``.

The block id is the range partition id, so it is pinned with a reliable
checkpoint: a recomputation after a lost executor re-reads the same
assignment instead of re-sampling range bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut_lineage

_BLK = "_blk"
BLOCK = _BLK  # public name of the block-id column
_KEY = "_okey"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range-partition on ``keys + order`` and tag rows with their block id.

    Range partitioning evaluates its input twice (a sampling pass for the
    bounds, then the shuffle), so the input is persisted for the duration
    of the checkpoint job and released right after it.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranged = src.repartitionByRange(n, *_cols(keys), *_cols(order)).withColumn(
            _BLK, F.spark_partition_id()
        )
        return cut_lineage(ranged)
    finally:
        src.unpersist()


def _block_summary(b: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None,
                   with_sum: bool = False) -> DataFrame:
    """One row per (block, key): row count, first and last value, running offsets."""
    ordk = F.struct(*_cols(order))
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        aggs += [
            F.min_by(F.col(value), ordk).alias("_head"),
            F.max_by(F.col(value), ordk).alias("_tail"),
        ]
        if with_sum:
            aggs.append(F.sum(F.col(value)).alias("_bsum"))
    s = b.groupBy(_BLK, _KEY).agg(*aggs)
    wk = Window.partitionBy(_KEY).orderBy(_BLK)
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if value is not None:
        s = (
            s.withColumn("_next_head", F.lead("_head").over(wk))
            .withColumn("_prev_tail", F.lag("_tail").over(wk))
        )
        if with_sum:
            s = s.withColumn("_sum_before", F.sum("_bsum").over(before))
    return s


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str | None = None,
    row_number: str | None = None,
    lead: str | None = None,
    lag: str | None = None,
    running_sum: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add per-key ordered columns to ``df`` without a whole-key task.

    ``row_number``: 1-based position by ``order`` within ``keys``.
    ``lead`` / ``lag``: next / previous ``value`` within the key (NULL at ends).
    ``running_sum``: cumulative sum of ``value`` up to and including the row
    (NULL values are skipped, as SQL ``sum`` does).
    """
    # A key may be null and is then a group of its own, as in a window: structs
    # are equal where their nulls are, so the summary joins without a reshuffle.
    b = blocked(df, keys, order, parts).withColumn(_KEY, F.struct(*_cols(keys)))
    w = Window.partitionBy(_BLK, _KEY).orderBy(*_cols(order))
    local = b.withColumn("_lrn", F.row_number().over(w))
    if value is not None:
        local = local.withColumn("_lcnt", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        if lead:
            local = local.withColumn("_llead", F.lead(value).over(w))
        if lag:
            local = local.withColumn("_llag", F.lag(value).over(w))
        if running_sum:
            local = local.withColumn("_lsum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summary = _block_summary(b, keys, order, value, with_sum=bool(running_sum))
    out = local.join(summary, [_BLK, _KEY], "inner")
    if row_number:
        out = out.withColumn(row_number, (F.col("_off") + F.col("_lrn")).cast("int"))
    if value is not None:
        if lead:
            out = out.withColumn(
                lead, F.when(F.col("_lrn") == F.col("_lcnt"), F.col("_next_head")).otherwise(F.col("_llead"))
            )
        if lag:
            out = out.withColumn(lag, F.when(F.col("_lrn") == 1, F.col("_prev_tail")).otherwise(F.col("_llag")))
        if running_sum:
            before = F.col("_sum_before")
            out = out.withColumn(
                running_sum,
                F.when(before.isNull(), F.col("_lsum"))
                .when(F.col("_lsum").isNull(), before)
                .otherwise(before + F.col("_lsum")),
            )
    return out.drop(_BLK, _KEY, "_lrn", "_lcnt", "_llead", "_llag", "_lsum", "_n", "_head", "_tail", "_bsum",
                    "_off", "_next_head", "_prev_tail", "_sum_before")


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str],
                parts: int | None = None) -> DataFrame:
    """Adds, for each (new column: column), the key's last non-null value before the row.

    The state that earlier rows leave behind, without a whole-key task: within
    a block by a window, across blocks by the blocks' own last values.  A null
    key is a group of its own; of rows equal in ``order`` any may come first."""
    b = blocked(df, keys, order, parts).withColumn(_KEY, F.struct(*_cols(keys)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    w = earlier(Window.partitionBy(_BLK, _KEY).orderBy(*_cols(order)))
    at = F.struct(*_cols(order))
    own = {f"_own_{new}": F.last(c, ignorenulls=True).over(w) for new, c in values.items()}
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end_{new}") for new, c in values.items()]
    wk = earlier(Window.partitionBy(_KEY).orderBy(_BLK))
    carried = [F.last(f"_end_{new}", ignorenulls=True).over(wk).alias(f"_car_{new}") for new in values]
    summary = b.groupBy(_BLK, _KEY).agg(*ends).select(_BLK, _KEY, *carried)
    out = b.withColumns(own).join(summary, [_BLK, _KEY])
    out = out.withColumns({new: F.coalesce(f"_own_{new}", f"_car_{new}") for new in values})
    return out.drop(_BLK, _KEY, *[f"{p}{new}" for new in values for p in ("_own_", "_car_")])
