"""Percentiles never hold a group in one task."""

from pyspark.sql import functions as F

from strata.operators import quality


def test_default_takes_the_block_path(spark, monkeypatch):
    def refuse(*a):
        raise AssertionError("a group in one task")

    monkeypatch.setattr(quality, "_percentiles_aggregate", refuse)
    df = spark.range(1001).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    assert [(r.k, r.p) for r in quality.exact_percentiles(df, ["k"], "v", {"p": 0.75}).collect()] == [("hot", 750.0)]
