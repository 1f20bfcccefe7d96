"""Connected components by alternating large-star and small-star steps.

Each step joins edges with every node's smallest neighbour (a map-side
combined minimum), so no node's neighbours are ever gathered; hubs only make
a skewed join, which adaptive execution splits.  Steps are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import stored


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour or itself."""
    both = e.union(e.select("v", "u").toDF("u", "v"))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of (u, v) other than the roots; root: its component's smallest node."""
    e = stored(edges.toDF("u", "v").where("u != v").distinct())
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    old = None
    for _ in range(most_rounds):
        e = stored(_small(_large(e)))
        new = mark(e)
        if new == old:
            return e.toDF("node", "root")
        old = new
    raise RuntimeError("components did not settle")
