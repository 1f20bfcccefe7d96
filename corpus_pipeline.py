"""Pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.  ``run`` applies
them in order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from strata.llm.layout import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; null ids and texts are judged like others."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep(docs, model, 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more: the smallest id.

    Documents without words and with null ids stay; of rows repeating an id, all stay with it.
    """
    found = ngram_join.join(docs, k=5, percent=80).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without bytes covered by strings of 100 that an earlier document has: any passage of over 50 words.

    A character that a cut would split goes whole.  Documents stay, also
    emptied ones; n_chars follows the text.
    """
    kept = suffix_dedup.strip_texts(docs, least=100)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, none included."""
    d = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("document"))
    plan = mixing.fit(stored(d.select("doc_id", "source", "size")), [5, 2, 1], 3.0)
    d = mixing.apply(d, plan, 3.0).where("copies > 0")
    return d.select("document", F.explode(F.sequence(F.lit(1), "copies"))).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every copy and their places in sequences of at most 1024 tokens."""
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)
    return packing.pack(pieces, 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained models, Newton steps and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
