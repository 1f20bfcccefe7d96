"""The queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from strata.llm import conversations, licenses, mixing, negatives, ngram_join, packing, pii, quality, sharding, suffix_dedup, toxicity, url_filter, winnowing
from strata.llm.layout import table

# The given url rules.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# The method's own rules, for urls that no given rule fits.
OWN_URL_RULES = [url_filter.Rule("block", w, (f"**{w}**",), len(w)) for w in ("spam", "pills", "casino", "porn", "xxx")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages judged by the given rules, else by the method's own."""
    rules = [url_filter.host_rule(*r) for r in URL_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, OWN_URL_RULES)


OP1_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, host_end, path_start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT p.*, (SELECT max_by({'rule': host_end || path_start, 'verdict': r.verdict}, length(host_end || path_start))
               FROM r WHERE (host = host_end OR ends_with(host, '.' || host_end)) AND starts_with(path, path_start)) AS hit,
         CASE WHEN host = '' THEN 'malformed' ELSE coalesce(
           (SELECT max_by(w, length(w) * 10 - i) FROM (VALUES ('spam', 0), ('pills', 1), ('casino', 2), ('porn', 3), ('xxx', 4)) o(w, i) WHERE contains(host || path, w)), 'default') END AS own
  FROM p)
SELECT page_id, host, path, hit.rule AS rule,
       CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN own = 'default' THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN hit IS NULL THEN own END AS method_rule
FROM j
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 1024 tokens in as few sequences as the method finds."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), path, end_id=2, capacity=1024, keep_ids=False)
    return packing.pack(pieces, 1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every whole text, the base rule and the forest's verdict."""
    d = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shard_rows(docs, 40, seed=4, order=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    d = toxicity.score(docs, model)
    return d.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# The given phrases, then notices of public licenses.  Short notices need the words that name the license,
# in a run of at most twice their length (33, half a block, for the longest).
LICENSES = [
    licenses.Template("mit", "mit license", 1.0, True),
    licenses.Template("apache", "apache license", 1.0, True),
    licenses.Template("gpl", "general public license", 1.0, True),
    licenses.Template("mit-notice", "Released under the MIT License.", names="mit license", within=10),
    licenses.Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    licenses.Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", names="apache 2", within=16),
    licenses.Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", names="general public license 3", within=24),
    licenses.Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    licenses.Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", 0.85, names="cc by nc 4", within=14),
    licenses.Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    licenses.Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", names="mozilla 2", within=33),
]


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the given phrases and the method's labels in every whole text."""
    d = licenses.scan(table(spark, sf_dir, "documents"), LICENSES, block=64)
    base = F.filter("spans", lambda s: s["phrase"])
    # blocks overlap, so a place is found once or twice
    places = F.array_distinct(F.flatten(F.transform(base, lambda s: F.transform(s["places"], lambda p: F.struct(s["template"].alias("t"), p.alias("p"))))))
    d = d.withColumns({"places": places, "base": base})
    named = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))))
    starts = F.transform("places", lambda x: x["p"])
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(F.col("base")).alias("base_labels"), named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0)).alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring each source near its target."""
    return mixing.mix(table(spark, sf_dir, "documents"), [5, 2, 1], 3.0).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one, removed."""
    d = suffix_dedup.dedup(table(spark, sf_dir, "documents"), least=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return d.select(
        "doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    d = winnowing.compare_with_next(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("kept")).alias("fingerprint"), winnowing.digest(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a similarity of 0.85 of their 4-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: the given kinds, and the method's own after them."""
    d = pii.find(table(spark, sf_dir, "documents"))
    given = [k.name for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(given))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, given), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
                    F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged as given, then repaired at the least cost."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor against all rows."""
    return negatives.mine(negatives.usable(table(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH e AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filters, op2_packing, op3_quality_rules, op4_sharding, op5_toxicity, op6_license_scans, op7_mixing, op8_suffix_dedup, op9_fingerprints, op10_ngram_join, op11_pii, op12_conversations, op13_negatives)
} | {"pipeline": corpus_pipeline.run}
# The others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op13_negatives": OP13_SQL}
