"""Pages by an index of range blocks (survey A36, F04, H30).

A browsed table is written once in its total order, cut into range blocks, with
the rows of each block beside it.  A page then finds its blocks from the running
counts and reads those alone, however deep it lies; a filtered page counts the
matches of each block first (a scan with the filters pushed down, no sort).  The
driver sees one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strata.plans.reads import apply

BLOCK = "_block"


def write_pages(df: DataFrame, path: str, order: Sequence[str] | None = None, rows_per_block: int = 1_000_000) -> None:
    """Rows in blocks by range of ``order`` (all columns, if none given; nulls first)."""
    cols = [F.col(c).asc_nulls_first() for c in order or df.columns]
    blocks = max(1, -(-df.count() // rows_per_block))
    cut = df.repartitionByRange(blocks, *cols).withColumn(BLOCK, F.spark_partition_id())
    cut.sortWithinPartitions(BLOCK, *cols).write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/rows")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    _rows(df.sparkSession, path).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(StructType([*schema.fields, StructField(BLOCK, IntegerType())])).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, preds: Sequence[Column | None] = (), order: Sequence[str] | None = None,
              offset: int = 0, limit: int = 500) -> DataFrame:
    """Rows offset .. offset + limit - 1 of the filtered table in its total order."""
    rows = _rows(spark, path)
    wanted = [p for p in preds if p is not None]
    matches = apply(rows, *wanted)
    counts = matches.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")) if wanted else spark.read.parquet(f"{path}/index")
    at, picked, skipped = 0, [], 0
    for r in sorted(counts.collect()):
        if at + r["n"] <= offset:
            skipped = at + r["n"]
        elif at < offset + limit:
            picked.append(r[BLOCK])
        at += r["n"]
    cols = [c for c in rows.columns if c != BLOCK]
    page = matches.filter(F.col(BLOCK).isin(picked)).select(*cols).orderBy(*[F.col(c).asc_nulls_first() for c in order or cols])
    return page.offset(max(0, offset - skipped)).limit(limit)
