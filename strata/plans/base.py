"""Registry and rounding helpers shared by the twin-query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _round(c, digits: int) -> Column:
    """Round half away from zero as ``round(x * 10^d) / 10^d`` on the binary
    value.  (Spark's ``round(x, d)`` rounds the shortest decimal rendering,
    which differs from the binary value at exact ties such as 644.925.)
    Rounding the scaled value to an integer agrees in every engine."""
    x = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(x * F.lit(m)) / F.lit(m)


def r2(c) -> Column:
    return _round(c, 2)


def r6(c) -> Column:
    return _round(c, 6)
