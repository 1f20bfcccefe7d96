"""The ten operators against brute force: given rows, edge rows, empty tables, clashing columns."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from strata.llm import licenses, mixing, ngram_join, packing, quality, queries, sharding, suffix_dedup, toxicity, url_filter, winnowing  # noqa: E402

DIR = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, g int, size string, row int, task string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Null and empty texts, one very long text, ties, repeated rows and ids, null ids, copies, shared passages."""
    rng = random.Random(7)
    passage, base = words(rng, 60), words(rng, 120).split()
    texts = [None, "", " \n\t", "one", "one two three", "ONE two three", words(rng, 20_000), passage, f"{words(rng, 9)} {passage} {words(rng, 9)}", f"é{passage}é ü"]
    texts += ["same text of a few words that stands here again and again " * 3] * 6
    for i in range(12):  # near copies: some words changed
        w = list(base)
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ["a a a a a a a a a a a a", "x\r\ny  z\u00a0 q\u2003r <|endoftext|> don't", "\n".join(["dup line here"] * 4 + ["other line"]), "Released under the MIT License. released under the mit license", "Licensed under the Apache License, Version 2.0. GNU GENERAL PUBLIC\nLICENSE"]
    rows = [(100 + 3 * i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), 1, "big", 5, "t") for i, t in enumerate(texts)]
    return rows + [rows[8], (None, passage, None, None, None, None, None, None, None), (None, "null id", "en", "src1", 7, 1, "s", 1, "t")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), KINDS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_url_rules(spark):
    urls = ["http://a.ORG/x?q", "https://EXAMPLE.org/es/1", "x://example.org/en/12#f", "http://b.example.org/en/2", "http://com/fr/", "http://x.com/de/?a", "http://x.com", "http://nocom/fr/", "http://x.org.net/a", "http://cheap-pills.net/a", "no scheme", "", None, "http:///only/path", "a://b://org/x", "http://org/", "http://é.org/ü", "http://x.com/fr/" + "y" * 5000, "http://a.ORG/x?q"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, [url_filter.host_rule(*r) for r in queries.URL_RULES], queries.OWN_URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = brute.url_parts(u)
        rule, verdict = brute.url_rule(host, path, queries.URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if not host or "pills" in host + path else "allow"))
    assert url_filter.judge(pages.limit(0), [], []).count() == 0


def test_automaton_against_regex():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rules = [url_filter.Rule("x", str(i), (g,), 0) for i, g in enumerate(globs)]
    m = url_filter.Automaton(rules)
    assert m.words > 4
    forms = [re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*|.", g)), re.S) for g in globs]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    win = m.winners(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for t, i in zip(texts, win):
        assert i == next((k for k, f in enumerate(forms) if f.fullmatch(t)), -1), (t, i)


def test_url_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = sorted(con.sql(queries.OP1_SQL).fetchall(), key=str)
    assert sorted(map(tuple, queries.op1_url_filters(spark, DIR).collect()), key=str) == want


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // capacity * capacity, len(ids) + 1, capacity)]
        want.update((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), sum(r.length for r in rows)


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit of the longest pieces first takes."""
    gaps, n = Counter(), 0
    for x in sorted(counts.elements(), reverse=True):
        g = min((g for g in gaps if g >= x), default=None)
        if g is None:
            n, g = n + 1, capacity
        else:
            gaps[g] -= 1
            gaps += Counter()  # without those used up
        gaps[g - x] += 1
    return n


def test_packing(edge, corpus, nothing):
    for d, capacity in ((edge, 1024), (edge, 64), (corpus, 1024)):
        pieces = packing.tokenize(d, TOKENIZER, 2, capacity)
        packed = packing.pack(pieces, capacity)
        n, total = check_packing(packed.collect(), [(r.doc_id, r.text) for r in d.collect()], capacity)
        lengths = Counter(r.length for r in packed.select("length").collect())
        assert total / capacity <= n <= best_fit_decreasing(lengths, capacity)
        whole = {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()}
        assert sum(whole.values()) == total and len(whole) == n
    assert packing.pack(packing.tokenize(nothing, TOKENIZER, 2, 1024), 1024).count() == 0


def test_packing_clashing_names(spark):
    d = spark.createDataFrame([(1, 0, 5, "x"), (1, 0, 5, "y"), (2, 0, 9, "z")], "doc_id long, piece int, length long, row string")
    assert sorted((r.length, r.offset, r.row) for r in packing.pack(d, 10).collect())[-1] == (9, 0, "z")
    with pytest.raises(ValueError):
        packing.pack(d, 8)


def test_packing_plan_is_exact_and_uses_all():
    rng = random.Random(3)
    for capacity in (7, 40, 200):
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(3000))
        used, n = Counter(), 0
        for lengths, times in packing.plan(dict(counts), capacity):
            assert times > 0 and sum(lengths) <= capacity
            n += times
            used.update({x: m * times for x, m in Counter(lengths).items()})
        assert used == counts
        assert n <= best_fit_decreasing(counts, capacity) + 1
    assert packing.plan({}, 8) == []
    # 6 is filled exactly by a pair, 5 by a triple
    assert (6, 3, 1) in [p for p, _ in packing.plan({6: 1, 3: 1, 1: 1}, 10)]
    assert (5, 2, 2, 1) in [p for p, _ in packing.plan({5: 1, 2: 2, 1: 1}, 10)]


def test_quality_statistics(edge, corpus, nothing):
    for d in (edge, corpus):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(d).collect())
        assert got == Counter((r.doc_id, *brute.statistics(r.text)) for r in d.collect())
    assert quality.statistics(nothing).count() == 0


def test_quality_verdicts(spark, edge, nothing):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.judge(d, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality and not r.base_failed]
    bad = [r.kept for r in rows if not r.quality]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1
    none = labels.limit(0)
    rows = quality.judge(edge, none).collect()
    assert len(rows) == edge.count() and all(r.kept != r.base_failed for r in rows)
    assert quality.judge(nothing, none).count() == 0


def test_quality_threshold_counts_all_labelled_rows(spark):
    rng = np.random.default_rng(1)
    good, bad = np.round(rng.beta(8, 12, 4000), 4), np.round(rng.beta(12, 8, 300), 4)
    at = np.unique(np.concatenate([good, bad]))
    counts = [np.array([(x == a).sum() for a in at]) for x in (good, bad)]
    worth = {a: (bad > a).mean() - 10 * (good > a).mean() for a in at if (good > a).mean() <= 0.002}
    limit = quality.threshold(at, *counts)
    assert (good > limit).mean() <= 0.002 and abs(worth[limit] - max(worth.values())) < 1e-9
    assert quality.threshold(at, counts[0], 0 * counts[1]) == 1.0 and quality.threshold(at[:0], at[:0], at[:0]) == 1.0
    rows = spark.createDataFrame([(i, 10, 40 + i, 0, 10 * (i > 2), 5_000) for i in range(5)], "doc_id long, n_words long, word_chars long, n_symbols long, n_marks long, n_capitals long")
    assert quality.usual_rates(rows).tolist() == [4.2, 0, 0, 100]
    assert quality.usual_rates(rows.limit(0)).tolist() == [0, 0, 0, 0]


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    s = quality.grow(x).score(x)
    assert s.argmax() == 500 and s[:500].mean() < 0.55


def test_sharding(edge, nothing, spark):
    for n in (1, 2, 39, 40, 1000, 5000):
        ids = spark.range(n).withColumn("row", F.col("id"))
        places = [r[0] for r in ids.select(sharding.permuted(F.col("row"), n, 4)).collect()]
        assert sorted(places) == list(range(n))
    assert [r[0] for r in spark.range(50).select(sharding.permuted(F.col("id"), 50, 4)).collect()] != list(range(50))
    d = edge.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    rows = sharding.shard_rows(d, 5, order=["doc_id", "c"]).collect()
    again = sharding.shard_rows(d.repartition(7), 5, order=["doc_id", "c"]).collect()
    key = lambda rs: Counter((r.doc_id, r.c, r.shard, r.slot) for r in rs)
    assert key(rows) == key(again)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(nothing.select("doc_id"), 5).count() == 0


def test_sharding_query(spark, corpus):
    rows = queries.op4_sharding(spark, DIR).collect()
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_toxicity_held_out(spark, edge, nothing):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels, ~toxicity.held_out())
    rows = toxicity.score(d.join(labels.where(toxicity.held_out()), "doc_id"), model).join(labels, "doc_id").collect()
    hit = [r.score >= 0.5 for r in rows if r.toxic]
    false = [r.score >= 0.5 for r in rows if not r.toxic]
    assert np.mean(hit) >= 0.85 and np.mean(false) <= 0.01
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    # no labels of both kinds: nobody is toxic
    assert toxicity.fit(d, labels.where("toxic = 0"), F.lit(True)).score(["idiot", None]).max() < 0.5


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(int)
    a, b = (rng.random((2, 4000)) < np.where(y, 0.6, 0.1)).astype(int)
    single = toxicity.label_model(np.column_stack([a, b]), y, trust=0.6)
    copied = toxicity.label_model(np.column_stack([a, a, a, a, b]), y, trust=0.6)
    assert np.abs(single - copied).mean() < 0.05


def test_license_phrases(edge, corpus, nothing):
    wanted = [(t.label, t.text) for t in queries.LICENSES if t.phrase]
    for d in (edge, corpus):
        rows = licenses.scan(d, queries.LICENSES, block=64).collect()
        got = Counter()
        for r in rows:
            places = {(s.template, p) for s in r.spans if s.phrase for p in s.places}
            at = [p for _, p in places]
            got[r.doc_id, r.n_words, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({s.label for s in r.spans if s.phrase}))] += 1
        assert got == Counter((r.doc_id, *brute.phrases(r.text, wanted)) for r in d.collect())
    assert licenses.scan(nothing, queries.LICENSES, block=64).count() == 0


def test_license_blocks_meet_the_threshold_exactly(spark):
    rng = random.Random(5)
    t = [licenses.Template("t1", "alpha beta gamma delta epsilon", 0.6), licenses.Template("t2", "beta zeta eta", 1.0)]
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta x y z q r".split()) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.template, s.first) for r in licenses.scan(d, t, block=10).collect() for s in r.spans}
    want = set()
    for i, x in enumerate(texts):
        w = x.split()
        for s in range(0, max(len(w), 1), 5):
            for k, a in enumerate(t):
                have = len(set(w[s : s + 10]) & set(a.sequence))
                if have >= a.threshold * len(set(a.sequence)) - 1e-9:
                    want.add((i, k, s))
    assert got == want


def test_license_notices_need_the_license_named(spark):
    far = " ".join(["filler"] * 12)
    cases = [
        ("this project is released under the Apache License", {"apache"}), ("released under the BSD license", set()),
        ("released under the GNU General Public License", {"gpl"}), ("Licensed under the Mozilla License, Version 2.0.", set()),
        ("Licensed under the Apache License, Version 1.0.", {"apache"}), ("Licensed under CC BY 4.0.", set()),
        (f"released under {far} the license {far} MIT", set()),
        ("Released under the MIT License.", {"mit", "mit-notice"}), ("released under the terms of the MIT license", {"mit", "mit-notice"}),
        ("x " * 60 + "Released under the MIT License.", {"mit", "mit-notice"}),
        ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ]
    d = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan(d, queries.LICENSES, block=64).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_mixing(edge, corpus, nothing):
    for d in (edge, corpus):
        rows = mixing.mix(d).collect()
        sizes = Counter()
        for r in d.collect():
            sizes[r.source] += len(brute.WORD.findall(r.text or ""))
        want = brute.mix_targets(sizes, [5, 2, 1], 3.0)
        taken = Counter()
        assert len(rows) == d.count()
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
            taken[r.source] += r.taken
        largest = {s: max([r.size for r in rows if r.source == s]) for s in want}
        assert all(abs(taken[s] - t) <= max(largest[s], 1) for s, t in want.items())
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(d.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_suffix_dedup(edge, corpus, nothing):
    digest = lambda d: d.select("doc_id", F.octet_length("kept") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]), F.size("spans"), F.sha2("kept", 256))
    for d, group in ((edge, 8 << 20), (edge, 4000), (corpus, 60_000)):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        assert Counter(map(tuple, digest(suffix_dedup.dedup(d, 50, group_bytes=group, bucket_keys=300)).collect())) == Counter(brute.stripped(rows, 50))
    assert suffix_dedup.dedup(nothing).count() == 0
    kept = suffix_dedup.strip_texts(edge, 100)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_suffix_dedup_keeps_contexts_whose_hashes_share_32_bits(spark):
    gram = "jultnzaynzzeiwfejkikyrgvxelc"  # neighbours found by search: the upper 32 bits of the contexts' hashes are equal
    pairs = [("lcrbmtsmedcjkscgmykaqd", "jwakfxnjaobizmxpszsbay"), ("jtjyghvumsntpymczzjjvf", "ycvvcqzjvbkabelprakrqx"), ("mhpdaqjaaccposrbrbmqkb", "byukgxhqiotaumgarimlzk")]
    rows = [(i, x + gram) for i, x in enumerate(x for p in pairs for x in p)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (50, 1 << 20):  # each in a group of its own, all in one
        assert {r.doc_id: r.kept.decode() for r in suffix_dedup.dedup(d, 50, group_bytes=group).collect()} == dict(rows)


def test_suffix_dedup_keeps_whole_characters(spark):
    shared = "é" * 60
    d = spark.createDataFrame([(1, "a" + shared), (2, "b" + shared + "c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.strip_texts(d, 51).collect()} == {1: "a" + shared, 2: "bc"}


def test_winnowing(edge, nothing, spark):
    k, w = 5, 8
    d = winnowing.winnow(winnowing.add_grams(edge.select("doc_id", "text"), "text", "grams", k), "text", "kept", k, w)
    for r in d.select("doc_id", "text", "grams", winnowing.marks(F.col("kept")).alias("m")).collect():
        n = len(brute.WORD.findall(r.text or ""))
        hashes = [x >> 30 for x in r.grams]
        assert len(hashes) == (n - k + 1 if n >= k else int(n > 0))
        assert [m.position for m in r.m] == brute.winnowed(hashes, w)
        assert [m.hash for m in r.m] == [hashes[m.position] for m in r.m]
    assert winnowing.compare_with_next(nothing).count() == 0


def test_edited_texts(edge, corpus):
    import hashlib

    for d in (edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), corpus):
        rows = sorted(((r.doc_id, r.text or "") for r in d.collect()), reverse=True)
        got = {r.doc_id: r for r in winnowing.compare_with_next(d, per_group_bytes=30_000).withColumn("sha", F.sha2("edited", 256)).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
            half = len(t) // 2
            assert got[i].n_chars == len(t)
            assert got[i].sha == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
            if t == nxt:
                assert got[i].near_next == 1
    assert winnowing.compare_with_next(edge).count() == edge.count()


def test_ngram_join(edge, corpus, nothing):
    plain = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for d, k, percent, block in ((plain, 4, 85, 1024), (plain, 5, 80, 2), (plain, 2, 60, 3), (corpus, 4, 85, 1024)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(d, k, percent, block=block, group_bytes=40_000, bucket_keys=500).collect()}
        assert got == brute.similar({r.doc_id: r.text for r in d.collect()}, k, percent)
    assert ngram_join.join(edge).count() == edge.count()
    assert ngram_join.join(nothing).count() == 0


def test_strip_texts_keeps_columns_of_any_name(spark, edge):
    d = edge.withColumn("_", F.lit("mine")).withColumn("rest", F.lit(3))
    got = suffix_dedup.strip_texts(d, least=100)
    assert got.columns == d.columns and got.count() == d.count()
    assert got.where("_ = 'mine' AND rest = 3").count() == d.count()


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs, kept = corpus, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        kept.append((name, docs))
        if name != "packing":
            assert docs.columns == corpus.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for _, d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    near = brute.similar({r.doc_id: r.text for r in kept[0][1].collect()}, 5, 80)
    assert ids[1] == {i for i, (_, c, _) in near.items() if c == i}
    want = {r[0]: r[4] for r in brute.stripped([(r.doc_id, r.text) for r in kept[1][1].collect()], 100)}
    assert {r.doc_id: r.h for r in kept[2][1].select("doc_id", F.sha2("text", 256).alias("h")).collect()} == want
    texts = [(r.doc_id, r.text) for r in kept[3][1].collect()]
    check_packing(kept[4][1].collect(), texts, 1024)
