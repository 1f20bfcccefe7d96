"""Personal data against regular expressions run one text at a time."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.llm import pii, queries

DIR = "/root/testdata/sf0.001"


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


GIVEN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
}


def plain(text):
    out = []
    for rank, (kind, (pattern, fits)) in enumerate(GIVEN.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if fits(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def some_texts():
    rng = random.Random(5)
    bits = ["1", "2", "55", "0", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "😀", "_", "4111111111111111", "4026083977531332", "192.168.0.1", "x@y.z", "+1 (407) 555-7710"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    return [None, "", " ", "a@b.c_d@e.f", "x@y", "a@b@c.d.e.", "é€😀 a@b.cc 1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 000.0.0.00", "1.1.1.1 " * 3000] + made + made[:20]


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(some_texts()))
    df = spark.createDataFrame([(None if i % 50 == 3 else i, t, "kept", i, f"{i}") for i, t in rows], "doc_id long, text string, spans string, rank int, m0 string").repartition(3)
    got = pii.find(df).select("rank", "doc_id", "m0", "spans").collect()
    return dict(rows), got


def test_given_kinds_as_plain_search(found):
    texts, got = found
    assert sorted(r["rank"] for r in got) == sorted(texts) and all(r["m0"] == str(r["rank"]) for r in got)
    for r in got:
        spans = [(s["start"], s["rank"], s["stop"], s["kind"]) for s in r["spans"]]
        assert [s for s in spans if s[1] < 4] == plain(texts[r["rank"]])
        assert spans == sorted(spans)
        for s in r["spans"]:
            assert (texts[r["rank"]] or "")[s["start"]:s["stop"]] == s["value"] and 0 <= s["score"] <= 1


def spans_of(spark, *texts):
    rows = pii.find(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    return [[(s["kind"], s["value"], s["score"]) for s in r["spans"]] for r in rows]


def test_checksums_and_context(spark):
    got = spans_of(spark, "IBAN DE89 3704 0044 0532 0130 00 end", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "123-45-6789", "ssn 666-45-6789",
                   "nir 2 55 08 14 168 025 38", "my card 4111 1111 1111 1111", "order 4111 1111 1111 1111", "invoice 4111 1111 1111 1112")
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)] and got[1] == []
    assert [k for k, _, _ in got[2]] == ["social_us"] and got[3] == [] and got[4] == []
    assert ("social_fr", "2 55 08 14 168 025 38") in [(k, v) for k, v, _ in got[5]]
    assert got[6] == [("card", "4111 1111 1111 1111", 1.0)] and got[7] == [("card", "4111 1111 1111 1111", 0.4)] and got[8] == []


def test_mod97(spark):
    numbers = [str(random.Random(i).randrange(10 ** (i + 1))) for i in range(40)]
    got = spark.createDataFrame([(x,) for x in numbers], "x string").select("x", pii.mod97(F.col("x")).alias("r")).collect()
    assert all(int(r["x"]) % 97 == r["r"] for r in got)


def test_long_runs_take_one_pass(spark):
    texts = ["9" * 200_000, "a" * 200_000, "1 " * 100_000 + "@", "+(" * 50_000, "." * 100_000 + "@" + "a." * 50_000 + "b", "A1" * 100_000]
    got = spans_of(spark, *texts)
    assert [len(x) for x in got] == [0, 0, 0, 0, 1, 0]


def test_empty_table(spark):
    d = pii.find(spark.createDataFrame([], "text string, spans int"))
    assert d.count() == 0 and d.columns == ["text", "spans"]


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_pii(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d["text"]), got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert {k: r[f"n_{k}"] for k in GIVEN} == {k: sum(s[3] == k for s in want) for k in GIVEN}
        assert set(filter(None, listed(want).split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_email"] for r in got.values()) > 0
