"""Physical layout of Gold and serving tables (survey 1.3, A27).

Gold facts are written partitioned by year and clustered on the read keys:
rows are range-partitioned on the cluster keys within the target file
layout and sorted inside each file, so Parquet min/max statistics let
filtered reads skip row groups.  Facts that are repeatedly joined on the
same key can instead be bucketed so later joins do not shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_clustered(df: DataFrame, path: str, partition_by: Sequence[str], cluster_by: Sequence[str],
                    files_per_partition: int | None = None, mode: str = "overwrite") -> None:
    """Write a fact partitioned by ``partition_by`` and clustered by ``cluster_by``.

    ``repartitionByRange`` on (partition, cluster) keys gives each task a
    contiguous key range (so each partition directory gets few, sorted
    files); ``sortWithinPartitions`` orders rows inside each file."""
    keys = list(partition_by) + list(cluster_by)
    n = files_per_partition or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def save_bucketed(df: DataFrame, table: str, bucket_by: Sequence[str], buckets: int,
                  sort_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Save a catalog table bucketed on its join key, so joins of two tables
    bucketed the same way read co-located buckets without an exchange."""
    w = df.write.mode(mode).bucketBy(buckets, *bucket_by)
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(table)
