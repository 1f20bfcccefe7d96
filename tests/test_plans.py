"""Structural invariants of the physical plans (the shape we designed for
scale), checked with ``explain`` output rather than results."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.operators.ordered import BLOCK, blocked

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_latest_wins_limits_before_the_shuffle(spark):
    p = plan(E.queries()["latest_wins"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_seed_lookups_are_broadcast_without_aqe(no_aqe):
    p = plan(E.queries()["range_lookup"](no_aqe, SF))
    assert "BroadcastHashJoin" in p


def test_year_bounds_reach_the_scan(spark):
    p = plan(E.queries()["read_overview"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p
    assert "In(p_brand" in p


def test_flagship_scan_is_pruned_and_preaggregated(spark):
    p = plan(E.queries()["deflated_revenue_by_nation_year"](spark, SF))
    li_schema = [line for line in p.splitlines() if "ReadSchema" in line and "l_orderkey" in line][0]
    assert "l_comment" not in li_schema and "l_partkey" not in li_schema and "l_tax" not in li_schema
    assert p.count("HashAggregate") >= 4


def test_hot_key_is_spread_over_blocks(spark):
    rows = [(0 if i % 3 == 0 else i % 50 + 1, i) for i in range(6000)]  # key 0 holds a third of the rows
    df = spark.createDataFrame(rows, "k int, t int")
    b = blocked(df, ["k"], ["t"], parts=8)
    per_block = {r[BLOCK]: r["n"] for r in b.filter(F.col("k") == 0).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per_block) >= 3 and max(per_block.values()) <= 0.5 * 2000
