"""Ordered last values against windows; group requests replayed in order against a loop over them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators.curation import replay_group_requests
from strata.operators.ordered import last_before

REQUEST = "seq long, op string, group_id string, group_name string, change_id string"


def test_last_before_is_the_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice([None, None, rng.randrange(9)]), rng.choice([None, "x", "y"])) for i in range(800)]
    d = spark.createDataFrame(rows, "k string, t long, v int, s string").repartition(5)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = d.select("k", "t", F.last("v", True).over(w), F.last("s", True).over(w)).collect()
    got = last_before(d, ["k"], ["t"], {"v0": "v", "s0": "s"}, parts=6).select("k", "t", "v0", "s0").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert last_before(d.limit(0), ["k"], ["t"], {"v0": "v"}).count() == 0


def one_by_one(groups, members, requests, log):
    """The reasons of the requests, in order."""
    now = {g: n.strip().lower() for g, n, active in groups if active}
    seen = {c: (g, a) for c, g, a in log}
    out = []
    for _, op, gid, name, change in sorted(requests, key=lambda r: r[0]):
        naming = op in ("create", "rename")
        name = (name or "").strip(" ")
        gid = (gid or "").strip(" ") or None
        if naming and not gid:
            gid = "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split()) or None
        key, end = name.lower(), (gid, op != "delete")
        if op not in ("create", "rename", "delete"):
            why = "unknown_op"
        elif naming and not name:
            why = "name_missing"
        elif naming and len(name) > 2000:
            why = "name_too_long"
        elif not gid:
            why = "no_id"
        elif change in seen:
            why = "repeated" if seen[change] == end else "change_id_conflict"
        elif op == "create" and gid in now:
            why = "exists"
        elif op != "create" and gid not in now:
            why = "not_found"
        elif naming and any(n == key and g != gid for g, n in now.items()):
            why = "name_taken"
        elif op == "delete" and gid in members:
            why = "has_members"
        else:
            why = None
            if change is not None:
                seen[change] = end
            if naming:
                now[gid] = key
            else:
                del now[gid]
        out.append(why)
    return out


def replayed(spark, groups, members, requests, log):
    got = replay_group_requests(
        spark.createDataFrame(groups, "group_id string, group_name string, active boolean"),
        spark.createDataFrame([(m,) for m in members], "group_id string"),
        spark.createDataFrame(requests, REQUEST).repartition(3),
        spark.createDataFrame(log, "change_id string, group_id string, active boolean"))
    return [r.reason for r in sorted(got.collect(), key=lambda r: r.seq)]


def test_requests_of_one_batch(spark):
    groups = [("soy", "Soy", True), ("corn", "Corn", True), ("old", "Old", False), ("kept", "Kept", True)]
    requests = [
        (1, "create", None, "Açaí", "c1"),  # its slug
        (2, "create", None, "açaí ", None),  # the same id: the first stands
        (3, "rename", "soy", "Corn", None),  # held by another
        (4, "rename", "corn", "Maize", None),
        (5, "rename", "soy", " CORN", None),  # freed in this batch
        (6, "delete", "corn", None, "c2"),
        (7, "create", None, "Corn", None),  # the id is free, the name is not
        (8, "create", "corn", "New corn", None),  # a reused id
        (9, "delete", "kept", None, "c3"),  # has members
        (10, "delete", "old", None, "c3"),  # inactive; the refused one's change id is free
        (11, "create", None, "Açaí", "c1"),  # a repeated delivery
        (12, "delete", "acai", None, "c1"),  # the change id of another end state
        (13, "rename", "soy", "corn", None),  # its own name
        (14, "create", "x", " ", None), (15, "create", None, "!!", None), (16, "rename", None, "n" * 2001, None),
        (17, None, "soy", None, None), (18, "delete", " ", None, None), (19, "create", "y", "Y", "logged"), (20, "create", "z", "Z", "logged"),
    ]
    log = [("logged", "y", True)]
    got = replayed(spark, groups, ["kept"], requests, log)
    assert got == [None, "exists", "name_taken", None, None, None, "name_taken", None, "has_members", "not_found", "repeated", "change_id_conflict",
                   None, "name_missing", "no_id", "name_too_long", "unknown_op", "no_id", "repeated", "change_id_conflict"]
    assert got == one_by_one(groups, {"kept"}, [(s, op, g, "Acai" if n and n.strip().lower() == "açaí" else n, c) for s, op, g, n, c in requests], log)
    assert replayed(spark, groups, [], [], []) == []


def test_random_batch_with_a_hot_group_and_a_hot_name(spark):
    rng = random.Random(1)
    pick = lambda prefix: prefix + str(0 if rng.random() < 0.35 else rng.randrange(6))
    groups = [(f"g{i}", f"n{i}", i % 3 > 0) for i in range(6)]
    requests = []
    for i in range(40):
        op = rng.choice(["create", "rename", "rename", "delete"])
        gid = None if op == "create" and rng.random() < 0.2 else pick("g")
        requests.append((i, op, gid, None if op == "delete" else rng.choice([str.upper, str.lower])(pick("n")), rng.choice([None, None, f"c{rng.randrange(8)}"])))
    assert replayed(spark, groups, ["g5"], requests, [("c1", "g1", True)]) == one_by_one(groups, {"g5"}, requests, [("c1", "g1", True)])
