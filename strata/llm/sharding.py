"""Sharding by a Feistel permutation with cycle walking over row numbers.

Rows are numbered 0..n-1 in a fixed order; a keyed permutation of those
numbers is a reproducible shuffle, from which shard and slot are computed:
shard = place mod shards, slot = place div shards.  Shards' row counts differ
by one at most, whatever the sizes, sources or copies.

The permutation is a Feistel network over a x b places, a = ceil(sqrt(n)),
b = ceil(n / a), whose halves are added modulo a and b.  A place past n is
walked on (permuted again) until it falls below n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import row_numbers

ROUNDS = 6


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    left = F.pmod(x, F.lit(a)).cast("long")
    right = ((x - left) / F.lit(a)).cast("long")
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), F.lit(b)), F.lit(b))
    return right * F.lit(a) + left


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of row 0..n-1 among n, as a bigint column.

    The a * b places hold fewer than a past n, so a walk ends after at most
    (a * b - n) + 1 steps; from 64 steps on a longer walk has a chance below
    n * a**-64 and would raise an error, never a wrong place.
    """
    n = max(n, 1)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    steps = min(a * b - n + 1, 64)
    first = _network(row, a, b, seed)
    if steps == 1:
        return first
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), first, lambda x, _: F.when(x < n, x).otherwise(_network(x, a, b, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """Adds row (0..n-1), place, shard and slot to every row.

    Rows are numbered by a hash of ``order[0]``, then by the order columns.
    Null ids are numbered like any other; rows equal in all order columns are
    interchangeable.  An empty table gives an empty result.  Columns named row,
    place, shard or slot are replaced; all others stay.
    """
    n = docs.count()
    d = row_numbers(docs, order or ["doc_id"], n)
    d = d.withColumn("place", permuted(F.col("row"), n, seed))
    return d.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": ((F.col("place") - F.col("place") % shards) / shards).cast("long")})
