"""Skew-safe operators agree with the plain formulations; scalar edge cases."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.operators import dedup
from strata.operators.ordered import ordered_columns
from strata.operators.quality import exact_percentiles


def _hot_key_frame(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rnd.randint(1, 40)  # key 0 holds a third of all rows
        rows.append((key, i, float(rnd.randint(1, 50)) if i % 17 else None))
    return spark.createDataFrame(rows, "k int, t int, v double")


def test_ordered_columns_match_plain_windows(spark):
    df = _hot_key_frame(spark)
    got = ordered_columns(df, ["k"], ["t"], value="v", row_number="rn", lead="nx", lag="pv", running_sum="cs", parts=7)
    w = Window.partitionBy("k").orderBy("t")
    want = (df.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("v").over(w))
            .withColumn("pv", F.lag("v").over(w))
            .withColumn("cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["k", "t", "v", "rn", "nx", "pv", "cs"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b


def test_exact_percentiles_match_numpy(spark):
    df = _hot_key_frame(spark)
    pdf = df.toPandas().dropna()
    for method in ("blocks", "aggregate", "auto"):
        got = {r.k: (r.p50, r.p75) for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p75": 0.75}, method).collect()}
        for k, g in pdf.groupby("k"):
            assert abs(got[k][0] - np.percentile(g.v, 50)) < 1e-9
            assert abs(got[k][1] - np.percentile(g.v, 75)) < 1e-9


def test_latest_wins_is_permutation_invariant(spark):
    rows = [(i % 5, i // 5, f"p{i}") for i in range(50)]
    a = dedup.latest_wins(spark.createDataFrame(rows, "k int, ts int, p string"), ["k"], ["ts"])
    random.Random(3).shuffle(rows)
    b = dedup.latest_wins(spark.createDataFrame(rows, "k int, ts int, p string").repartition(5), ["k"], ["ts"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_latest_batch_replaces_whole_scope(spark):
    rows = [("2020", 1, "a"), ("2020", 1, "b"), ("2020", 2, "c"), ("2021", 1, "d")]
    df = spark.createDataFrame(rows, "scope string, batch int, v string")
    got = sorted(r.v for r in dedup.latest_batch(df, ["scope"], "batch").collect())
    assert got == ["c", "d"]


def test_safe_numeric_edge_cases(spark):
    vals = ["12,5", " 7 ", "\t3\t", "...", "..", "*", "X", "", "-", "1d", "NaN", "Infinity", "1e3", "abc", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [(r.a, r.b) for r in df.select(C.safe_numeric("s").alias("a"), C.safe_numeric("s", True).alias("b")).collect()]
    assert got == [(12.5, 12.5), (7.0, 7.0), (3.0, 3.0), (None, None), (None, None), (None, None), (None, None),
                   (None, None), (None, 0.0), (None, None), (None, None), (None, None), (1000.0, 1000.0),
                   (None, None), (None, None)]


def test_safe_date_and_parts(spark):
    df = spark.createDataFrame([("31/12/2020", 2020, 13), ("31/02/2020", 2020, 2), ("1/2/2020", 2020, 0)], "s string, y int, m int")
    got = [(r.d, r.p) for r in df.select(C.safe_date("s").alias("d"), C.safe_date_from_parts("y", "m").alias("p")).collect()]
    assert str(got[0][0]) == "2020-12-31" and got[0][1] is None
    assert got[1][0] is None and str(got[1][1]) == "2020-02-01"
    assert got[2] == (None, None)
