"""Toxicity by weak supervision.

1. Voters: words, and word beginnings as patterns, that stand far more often in
   toxic training rows.  Each votes "toxic" or abstains.
2. A generative label model over the voters (and the given label as one more,
   fallible voter) estimates by EM how often each votes in either class; votes
   of voters that go together beyond their class are discounted by their
   correlations, so that a word and its beginnings count about once.
3. A linear classifier is trained on the model's posterior labels.

Only training rows (``train``) are learned from; score inputs are the text's
words alone.  The training rows are a bounded sample, voters a bounded list;
scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import bounded_batches

WORD = re.compile(r"[^\W_]+")
PATTERN_LENGTHS = (4, 5, 6, 7)


def votes_of(word: str) -> list[str]:
    """The voters a word can be an instance of: itself, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PATTERN_LENGTHS if len(word) > n)]


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # by voter, for log2(1 + hits)
    bias: float

    def hits(self, texts: list[str | None]) -> Iterator[dict[int, int]]:
        """Voters' hit counts of each text; a word seen before costs one look-up."""
        index = {v: i for i, v in enumerate(self.voters)}
        memo: dict[str, tuple[int, ...]] = {}
        for text in texts:
            found: Counter = Counter()
            for word in WORD.findall((text or "").lower()):
                got = memo.get(word)
                if got is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    got = memo[word] = tuple(index[v] for v in votes_of(word) if v in index)
                if got:
                    found.update(got)
            yield found

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, found in enumerate(self.hits(texts)):
            for v, n in found.items():
                z[i] += self.weights[v] * np.log2(1 + n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def find_voters(rows: DataFrame, most: int = 400, least_rows: int = 3) -> list[str]:
    """The ``most`` strongest voters of rows (text, toxic), by rows they stand in.

    Tasks send one row a candidate and 100,000 candidates, not one a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()

        def sent():
            keys = list(pos.keys() | neg.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["voter", "pos", "neg"])
            pos.clear()
            neg.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = {v for word in set(WORD.findall((text or "").lower())) for v in votes_of(word)}
                (pos if toxic else neg).update(got)
                if len(pos) + len(neg) > 100_000:
                    yield sent()
        yield sent()

    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return []
    c = rows.select("text", "toxic").mapInArrow(run, "voter string, pos long, neg long").groupBy("voter").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    c = c.where(F.col("pos") >= least_rows).withColumn("lift", lift).where(F.col("lift") > 1.5)
    return [r["voter"] for r in c.orderBy((F.col("pos") * F.col("lift")).desc(), "voter").limit(most).collect()]


def label_model(votes: np.ndarray, labels: np.ndarray, trust: float = 0.95, rounds: int = 30) -> np.ndarray:
    """Posterior chance of class 1 for each row of 0/1 votes.

    EM over class-conditional vote rates; the given label is a voter that is
    right with chance ``trust``.  After each round the correlation of every
    two voters within the classes is estimated, and a voter's evidence is
    divided by 1 + the sum of its positive correlations.
    """
    prior = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    gold = np.where(labels > 0, np.log(trust / (1 - trust)), np.log((1 - trust) / trust))
    post = np.where(labels > 0, trust, 1 - trust)
    v = votes.astype(np.float64)
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        a1 = (post @ v + 0.5) / (w1 + 1)
        a0 = ((1 - post) @ v + 0.5) / (w0 + 1)
        centred = v - np.outer(post, a1) - np.outer(1 - post, a0)
        cov = centred.T @ centred / len(v)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        share = 1 / (1 + corr.sum(1))
        # a voter that abstains says nothing: most words of a lexicon are absent from any text
        z = np.log(prior / (1 - prior)) + v @ (np.log(a1 / a0) * share) + gold
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return new


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the bias is not shrunk."""
    x1 = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x1.shape[1], l2)
    shrink[-1] = 1e-6
    b = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -50, 50)))
        grad = x1.T @ (p - y) + shrink * b
        hess = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        b -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = 12_000, voters: int = 300) -> Model:
    """A model from the labelled rows of ``docs`` for which ``train`` (of doc_id) holds.

    At most about ``rows`` of them, chosen by a hash of the id; of a document's
    several labels the highest counts; null labels and ids do not.  Without
    rows of both classes every score is 0.
    """
    bounded_batches(docs)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < min(1_000_000, 1_000_000 * rows // max(n, 1)))
    # at most about ``rows`` ids and flags: a size known before it is sent
    known = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic")
    names = find_voters(known, voters)
    if not names:
        return Model([], np.zeros(0), -1e9)
    model = Model(names, np.zeros(len(names)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(f.items()) for f in model.hits(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([[v for v, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[min(c, 1 << 30) for _, c in f] for f in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "voters", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = known.mapInArrow(run, f"doc_id {kind}, toxic int, voters array<int>, counts array<int>").orderBy("doc_id", "toxic", "voters", "counts").select("toxic", "voters", "counts").toArrow()
    x = np.zeros((len(got), len(names)), np.float32)
    for i, (v, c) in enumerate(zip(got.column("voters").to_pylist(), got.column("counts").to_pylist())):
        x[i, v] = np.log2(1 + np.array(c, np.float64)) if v else 0
    y = got.column("toxic").to_numpy()
    post = label_model(x > 0, y)
    model.weights, model.bias = fit_linear(x.astype(np.float64), post)
    return model


def held_out() -> Column:
    """Rows whose labels nothing learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep(docs: DataFrame, model: Model, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below ``limit``, all columns as they are."""
    bounded_batches(docs)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; null and empty texts get the score of no votes."""
    bounded_batches(docs)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double")
