"""Conversation repair against a plain programme over single rows that carries whole audits."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from strata.llm import conversations as C
from strata.llm import queries

KINDS = "conv_id long, turn long, role string, text string, copies string, whole int, piece string"
TO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain(rows):
    """(cost, audit) least for rows of (initial, must go, truncated)."""
    best = {0: (0, "")}

    def inserts(best):
        changed = True
        while changed:
            changed = False
            for p in list(best):
                for x in "ua":
                    if p in TO[x]:
                        new = (best[p][0] + 2, best[p][1] + "I")
                        if TO[x][p] not in best or new < best[TO[x][p]]:
                            best[TO[x][p]], changed = new, True
        return best

    for initial, must, truncated in rows:
        new = {}
        for p, (cost, audit) in inserts(best).items():
            ways = [(cost + 3, audit + "D", p)]
            if not must:
                ways += [(cost + truncated, audit + "K", TO[initial][p])] if p in TO.get(initial, {}) else []
                ways += [(cost + 2 + truncated, audit + "R", TO[x][p]) for x in "ua" if p in TO[x]]
            for c, a, q in ways:
                new[q] = min(new.get(q, (c, a)), (c, a))
        best = new
    return min(v for p, v in inserts(best).items() if p in (0, 3))


def runs_of(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    return runs


def test_programme():
    rng = random.Random(3)
    for _ in range(1500):
        symbols = [s for _ in range(rng.randrange(0, 12)) for s in [rng.choice("suaoSUAOX")] * rng.choice([1, 1, 1, 2, 3, 7])]
        want = plain([(s.lower(), s == "X", int(s.isupper())) for s in symbols])
        assert C.solve(runs_of(symbols)) == want
        assert C._solve(runs_of(symbols), 3) == want  # costs worked out again block by block
    for s in "suaoSUAO":
        for n in (63, 64, 65, 130, 501):
            assert C.solve([(s, n)]) == plain([(s.lower(), False, int(s.isupper()))] * n)


def test_powers_of_a_long_run():
    cost, audit = C.solve([("u", 10 ** 6), ("X", 10 ** 9 // 200), ("a", 1)])
    assert len(audit.replace("I", "")) == 10 ** 6 + 10 ** 9 // 200 + 1
    assert cost == sum({"D": 3, "I": 2, "K": 0, "R": 2}[x] * audit.count(x) for x in "DIKR")


def want(rows):
    convs, shown = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, rows, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for _, role, text in kept:
            core, fault = text.strip(" \t\n\v\f\r"), None
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            rows.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        n["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain(rows)
        turns = [t for t, _, _ in kept if t is not None]
        fixed, left = [], iter(kept)
        for letter in audit:
            here = "assistant" if fixed and fixed[-1][0] == "user" or fixed and fixed[-1][0][:1] == "u" else "user"
            if letter == "I":
                fixed.append((here, ""))
                continue
            _, role, text = next(left)
            if letter != "D":
                fixed.append((role if letter == "K" else here, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), cost, audit, sha)
    return out


def check(df, rows):
    got = C.repair(C.damaged(df)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want(rows)


def edge_rows():
    rng = random.Random(3)
    rows = {}
    for conv in [*range(60), None, -3]:  # null ids, turns, roles, texts; gaps; unknown and empty roles; blanks
        for t in range(rng.randrange(1, 15)):
            turn = rng.choice([t, t, t, t + 1000 * t, None if t == 3 else t])
            rows[conv, turn] = (rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["a.", "b", "c! ", " ", "", None, "x\ny?\n", "é😀.", "w " * 50_000]))
    for t in range(2000):  # one conversation with a third of all rows, most of them repeated
        rows[999, t] = (rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!"]) + str(rng.randrange(700)) + rng.choice(".,"))
    rows = [(*k, *v) for k, v in rows.items()]
    return rows + [(1000, 5, "user", "twice the same.")] * 3  # repeated rows


def test_edges(spark):
    rows = edge_rows()
    check(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KINDS).repartition(5), rows)


def test_empty_table(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], KINDS))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_rows(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/conversations.parquet")
    got = queries.op12_conversations(spark, f"/root/testdata/{sf}").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want(list(zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")))))
