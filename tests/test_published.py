"""Published tables: whole commits only, replays after failures, pruned incremental scans, maintained intervals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strata.operators.incremental import affected_partitions, incremental_build
from strata.operators.scd import scd2_timeline
from strata.sources.bronze import append_bronze, read_bronze
from strata.sources.published import Published
from strata.streaming import jobs

KV = "p int, k string, v int"


def rows(spark, *data, schema=KV):
    return spark.createDataFrame(list(data), schema)


def content(table):
    return sorted((tuple(r) for r in table.read().select("p", "k", "v").collect()), key=str)


def test_commits_replace_partitions_and_keep_the_others(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"), ["p"])
    assert table.read() is None and table.commit() is None
    table.publish(lambda: rows(spark, (1, "a", 1), (2, "b", 2), (None, "n", 0)), "one")
    assert table.publish(lambda: rows(spark, (2, "c", 3)), "two") == ["p=2"]
    assert content(table) == [(1, "a", 1), (2, "c", 3), (None, "n", 0)]
    c = table.commit()
    assert c.number == 2 and c.folders["p=1"] == 1 and c.folders["p=2"] == 2
    assert table.publish(lambda: rows(spark, (1, "zz", 9)), "one") == []  # a known label changes nothing
    table.publish(lambda: rows(spark, (5, "e", 5)), "three", whole=True)
    assert content(table) == [(5, "e", 5)]
    table.expire(keep=1)
    assert content(table) == [(5, "e", 5)]


def test_types_of_partition_values_stay(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"), ["code", "year"])
    table.publish(lambda: rows(spark, ("076", 2001, 1), ("1.5", 2002, 2), schema="code string, year int, v int"), "x")
    assert {(r.code, r.year, r.v) for r in table.read().collect()} == {("076", 2001, 1), ("1.5", 2002, 2)}
    empty = Published(spark, str(tmp_path / "e"), ["p"])
    empty.publish(lambda: rows(spark), "x")
    assert empty.read().count() == 0 and empty.read().columns == ["p", "k", "v"]


class Flaky:
    """Every write fails once, after its work or half of it is done."""

    def __init__(self, monkeypatch):
        self.failed = set()
        for name, half in (("_write_data", True), ("_write_data", False), ("_write_pointer", False)):
            self.wrap(monkeypatch, name, half)

    def wrap(self, monkeypatch, name, half):
        write = getattr(Published, name)

        def fails(table, *args):
            key = (table.path, name, half, *(a for a in args if isinstance(a, str) and "/" in a))
            if key in self.failed:
                return write(table, *args)
            self.failed.add(key)
            if half:
                write(table, args[0].limit(1), *args[1:])
            raise OSError("lost")

        monkeypatch.setattr(Published, name, fails)


def applied(step, batch, number):
    failures = 0
    while True:
        try:
            step(batch, number)
            return failures
        except OSError:
            failures += 1


def test_every_write_fails_once_and_the_batch_is_replayed(spark, tmp_path, monkeypatch):
    Flaky(monkeypatch)
    state = str(tmp_path / "s")
    step = jobs.latest_state_merger(state, ["k"], ["ts"], buckets=3)
    first = rows(spark, *[(k, 1, "old") for k in range(8)], schema="k int, ts int, v string")
    late = rows(spark, (1, 2, "new"), (2, 0, "late"), (9, 1, "new"), schema="k int, ts int, v string")
    assert applied(step, first, 0) >= 2
    seen = []

    def watched(batch, number):
        try:
            step(batch, number)
        finally:
            seen.append({r.k: r.v for r in jobs.read_state(spark, state).collect()})

    assert applied(watched, late, 1) >= 2
    old = {k: "old" for k in range(8)}
    assert seen[:-1] == [old] * (len(seen) - 1) and seen[-1] == old | {1: "new", 9: "new"}
    step(late, 1)  # replayed once more after success
    assert {r.k: r.v for r in jobs.read_state(spark, state).collect()} == seen[-1]


def test_scope_replacement_survives_failures(spark, tmp_path, monkeypatch):
    Flaky(monkeypatch)
    path = str(tmp_path / "s")
    step = jobs.batch_replacement(path, ["p"], "v")
    applied(step, rows(spark, (1, "a", 1), (1, "b", 1), (2, "c", 1)), 0)
    applied(step, rows(spark, (1, "d", 2)), 1)  # the newer batch lacks a and b: they are retracted
    applied(step, rows(spark, (2, "z", 0)), 2)  # an older one is ignored
    assert content(Published(spark, path, ["p"])) == [(1, "d", 2), (2, "c", 1)]


def edits(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None, f"k{i % 9}"]), dt.datetime(2024, 1, 1 + rng.randrange(6), rng.randrange(24)), i, f"v{i}") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_equal_the_timeline_of_the_log(spark, tmp_path, seed):
    log = edits(seed)
    schema = "k string, ts timestamp, id int, v string"
    rng = random.Random(seed)
    rng.shuffle(log)  # late edits split intervals, some come before a key's first
    state = str(tmp_path / "s")
    step = jobs.scd2_maintainer(state, ["k"], "ts", "id", buckets=3)
    cuts = [0, 1, 30, 70, len(log)]
    for number, (i, j) in enumerate(zip(cuts, cuts[1:])):
        again = log[max(0, i - 5):i] + log[i:j] + log[i:i + 2]  # repeated within and across batches
        step(rows(spark, *again, schema=schema), number)
    step(rows(spark, *log[:3], schema=schema), len(cuts) - 2)  # a replay
    got = jobs.scd2_read(spark, state, ["k"], "ts", "id")
    want = scd2_timeline(rows(spark, *log, schema=schema), ["k"], "ts", "id", skew_safe=False)
    cols = ["k", "id", "v", "version", "valid_from", "valid_to", "is_current"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    state = str(tmp_path / "s")
    step = jobs.scd2_maintainer(state, ["k"], "ts", "id", buckets=16)
    schema = "k string, ts timestamp, id int, v string"
    step(rows(spark, *[(f"k{i}", dt.datetime(2024, 1, 1), i, "v") for i in range(200)], schema=schema), 0)
    step(rows(spark, ("k3", dt.datetime(2024, 1, 2), 999, "w"), schema=schema), 1)
    assert sorted(Published(spark, state, [jobs.BUCKET]).commit().folders.values()) == [1] * 15 + [2]


def test_rows_behind_the_watermark_are_kept_aside(spark, tmp_path):
    state, late = str(tmp_path / "s"), str(tmp_path / "l")
    step = jobs.freshness_monitor(state, late, "ts", "k", "1 day")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "k string, ts timestamp"
    step(rows(spark, ("a", day(5)), ("b", day(1)), (None, None), schema=schema), 0)  # nothing is late in the first batch
    step(rows(spark, ("a", day(4, 1)), ("a", day(3)), ("c", day(9)), schema=schema), 1)
    step(rows(spark, ("a", day(7)), ("b", day(9, 2)), schema=schema), 2)
    behind = sorted((r.k, r.ts) for r in Published(spark, late, ["batch"]).read().collect())
    assert behind == [("a", day(3)), ("a", day(7))]
    got = {(str(r.day), r.k): (r.newest, r.n_rows) for r in Published(spark, state, ["day"]).read().collect()}
    assert got == {("2024-01-05", "a"): (day(5), 1), ("2024-01-01", "b"): (day(1), 1), ("None", None): (None, 1),
                   ("2024-01-04", "a"): (day(4, 1), 1), ("2024-01-09", "c"): (day(9), 1), ("2024-01-09", "b"): (day(9, 2), 1)}


def test_incremental_build_prunes_its_scans(spark, tmp_path):
    path = str(tmp_path / "bronze")
    schema = "ano string, k string, v int, ingestion_timestamp timestamp_ntz"
    load = lambda d, *r: rows(spark, *[(y, k, v, dt.datetime(2024, 1, d)) for y, k, v in r], schema=schema)
    first = load(1, ("2001", "a", 1), ("2002", "b", 2), ("2003", "c", 3))
    append_bronze(first, path, "ano")
    bronze = read_bronze(spark, path, first.schema)
    target = Published(spark, str(tmp_path / "silver"), ["year"])
    scoped = []

    def build(b):
        scoped.append(b)
        from strata.operators.dedup import latest_wins
        return latest_wins(b, ["ano", "k"], ["ingestion_timestamp"]).select(F.col("ano").cast("int").alias("year"), "k", "v", "ingestion_timestamp")

    incremental_build(target, [bronze], "ano", "ingestion_timestamp", build, "l1")
    append_bronze(load(2, ("2002", "b", 20)), path, "ano")
    bronze = read_bronze(spark, path, first.schema)
    # years tied at the newest ingestion are rebuilt once more
    assert incremental_build(target, [bronze], "ano", "ingestion_timestamp", build, "l2") == ["year=2001", "year=2002", "year=2003"]
    append_bronze(load(3, ("2003", "c", 30), ("2004", "d", 4)), path, "ano")
    bronze = read_bronze(spark, path, first.schema)
    assert incremental_build(target, [bronze], "ano", "ingestion_timestamp", build, "l3") == ["year=2002", "year=2003", "year=2004"]
    assert sorted((r.year, r.k, r.v) for r in target.read().collect()) == [(2001, "a", 1), (2002, "b", 20), (2003, "c", 30), (2004, "d", 4)]
    plan = scoped[-1]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruningexpression(ano" in plan
    found = affected_partitions([bronze, bronze], dt.datetime(2024, 1, 3), "ano", "ingestion_timestamp", "ingestion_date")
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(ingestion_date" in plan and sorted(r.ano for r in found.collect()) == ["2003", "2004"]
