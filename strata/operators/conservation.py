"""Control totals (survey L03-L05): taken while a layer is written, held against the next one as stored.

A layer's totals are observed in the job that writes it and stand in its commit.
The check then reads the stored next layer alone: nothing is computed anew from
the layer before, so a row lost on the way between the two shows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.checks import ERROR
from strata.sources.published import Published


def totals_of(measures: Mapping[str, Column | str]) -> dict[str, Column]:
    """Sums of the measures, as doubles, under their names."""
    return {name: F.sum(c).cast("double") for name, c in measures.items()}


def unconserved(before: Published, after: DataFrame, measures: Mapping[str, Column | str], rel_tol: float = 1e-6,
                name: str = "conservation", severity: str = ERROR) -> DataFrame:
    """One row for each measure whose total over ``after`` is not the control total of ``before``'s commit."""
    control = before.commit().totals
    sums = after.agg(*[c.alias(m) for m, c in totals_of(measures).items()])
    pairs = [F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m), F.lit(0.0)).alias("stored"),
                      F.lit(float(control.get(m) or 0.0)).alias("control")) for m in measures]
    each = sums.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    off = F.abs(F.col("stored") - F.col("control")) > rel_tol * F.greatest(F.abs("stored"), F.abs("control"), F.lit(1.0))
    return each.filter(off).withColumns({"check": F.lit(name), "severity": F.lit(severity)})
