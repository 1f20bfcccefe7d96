"""How documents are dealt out: groups by id range, and global row numbers.

Both need only counts and id quantiles (bounded results), never a driver-side
list of documents, and both give the same answer when a lost task is run again.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir

BLANKS = "\t\n\u000b\u000c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bounded_batches(df: DataFrame, rows: int = 1_000) -> None:
    """Fewer rows in an Arrow batch than usual: a row is a whole text, and batches are held on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none), without Python."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_groups(docs: DataFrame, per_group_bytes: int, text: str = "text", least: int = 1) -> tuple[Column, int]:
    """A column that deals documents out by doc_id range, and its number of groups.

    Splitters are quantiles of doc_id, so that ids rise with the group number;
    their count follows the bytes of text.  Null ids go to the last group.
    """
    got = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("doc_id").alias("n")).first()
    n = max(least, -(-(got["b"] or 0) // per_group_bytes), 1)
    if n == 1 or not got["n"]:
        return F.lit(0), 1
    at = [i / n for i in range(1, n)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), max(10_000, 20 * n))).first()[0]))
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    below = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(below).cast("int"), len(cuts) + 1


def row_numbers(df: DataFrame, order: list[str], n: int, name: str = "row", per_block: int = 20_000) -> DataFrame:
    """Adds 0..n-1 in a fixed order, without one task over all rows.

    Rows go to blocks by a hash of the first order column; each block is
    numbered by itself and shifted by the rows of the blocks before it (a table
    of n / per_block rows, the only thing one task sees whole).
    """
    blocks = max(1, -(-n // per_block))
    d = df.withColumn("_block", F.pmod(F.xxhash64(order[0]), F.lit(blocks)).cast("int"))
    sizes = d.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_block").orderBy(*order)
    d = d.withColumn("_at", F.row_number().over(within)).join(shift, "_block")
    return d.withColumn(name, F.col("_shift") + F.col("_at") - 1).drop("_block", "_at", "_shift")
