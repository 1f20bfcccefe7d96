"""Hard negatives against sorted lists of all scores in Python integers."""

import math
import random

import duckdb
import numpy as np
import pytest

from strata.llm import negatives as N
from strata.llm import queries

KINDS = "vec_id long, label int, embedding array<float>, id string, vector int, score int"


@pytest.mark.parametrize("n,m,p", [(1, 1, 1), (300, 70, 257), (513, 129, 600), (200, 200, 200), (3, 500, 2), (0, 4, 5)])
def test_strassen(n, m, p):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-500, 500, (n, m)), rng.integers(-500, 500, (m, p))
    assert (N.strassen(a, b) == a @ b).all() and (N.strassen(a, b, 16) == a @ b).all()


def test_strassen_wraps_as_int64():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2 ** 62, 2 ** 62, (150, 150)) for _ in "ab")
    assert (N.strassen(a, b, 32) == a @ b).all()


def want(rows):
    used, out, seen = [], [], set()
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        used.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    for i, label, v in used:
        if i is None or i % 100 or (i, label, v) in seen:
            continue
        seen.add((i, label, v))
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m) for j, m, w in used)
        for s, _, j, _ in [x for x in scores if x[3] == label and not x[1] and x[2] != i][:5]:
            near = [x for x in scores if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(out, key=str)


def edge_rows():
    rng = random.Random(2)
    rows = []
    for k in range(700):  # repeated and null ids, null labels and vectors, nulls and NaN inside, short and empty vectors, many ties
        i = rng.choice([k, k, k, 100 * rng.randrange(4), None, -100 * rng.randrange(2)])
        v = rng.choice([None, [], [math.nan, 1.0], [None, 1.0], [math.inf]]) if k % 50 == 0 else [rng.choice([0.0, 0.5, -0.25, 0.1, 1e3]) for _ in range(rng.choice([3, 3, 3, 2]))]
        rows.append((i, rng.choice([0, 1, 2, 1, 1, 9, -4, None] if k % 5 else [7]), v))
    return rows + rows[:50]


def mined(df):
    return sorted((tuple(r) for r in N.mine(N.usable(df)).collect()), key=str)


def test_edges(spark):
    rows = edge_rows()
    assert mined(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS).repartition(5)) == want(rows)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 40)
    monkeypatch.setattr(N, "ANCHORS", 2)
    rows = edge_rows()[:300]
    assert mined(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS).repartition(3)) == want(rows)


def test_empty_and_alone(spark):
    assert mined(spark.createDataFrame([], KINDS)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0], "", 0, 0)], KINDS)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_and_its_sql(spark, sf):
    got = queries.op13_negatives(spark, f"/root/testdata/{sf}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '/root/testdata/{sf}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL["op13_negatives"]).fetchall())
    assert got.columns == [d[0] for d in con.description]
