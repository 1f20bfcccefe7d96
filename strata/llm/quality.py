"""Quality rules: an isolation forest over rule statistics.

``statistics`` measures every whole text once; everything after works on those
narrow rows.  Trees of random splits are grown on a bounded sample of all
documents; a document's mean path length over the trees gives its anomaly
score, and the score above which documents go is calibrated on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import bounded_batches, stored
from strata.llm.words import as_bytes, combine, prefix_sums, range_hash, slices, table_of, words

# The symbols that the rule counts.
SYMBOLS = table_of(*((ord(c), ord(c)) for c in "#*$%&|<>"))
MARKS = table_of((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
CAPITALS = table_of((0x41, 0x5A))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]
RATES = ["word_chars", "n_symbols", "n_marks", "n_capitals"]


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (doc, key) stands in its text more than once, and whether it did so before."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def measure(buf: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The statistics of each text of a buffer."""
    n = len(offs) - 1
    starts, ends, woffs = words(buf, offs)
    sums = prefix_sums(buf)
    h = range_hash(sums, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(woffs))
    codepoint = (buf & 0xC0) != 0x80


    edges = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    inside = np.cumsum(edges[:-1]) > 0
    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    # lines: from a text's start or a line feed to the next
    feeds = np.flatnonzero(buf == 10)
    at = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    line_doc = np.searchsorted(offs, at, "right") - 1
    # a text's last line may be empty at the next text's start: that one has no word
    line_doc = np.minimum(line_doc, n - 1)
    line_end = np.append(at[1:], len(buf))
    line_end = np.where(np.isin(line_end - 1, feeds), line_end - 1, line_end)
    line_end = np.maximum(line_end, at)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, at)
    a, b, ld = at[has_word], line_end[has_word], line_doc[has_word]
    _, seen = repeats(range_hash(sums, a, b), ld)
    grams = combine(h, window)
    ok = np.arange(len(grams)) + window <= woffs[1:][doc[: len(grams)]] if len(grams) else np.zeros(0, bool)
    twice = np.zeros(len(h), bool)
    twice[: len(grams)][ok], _ = repeats(grams[ok], doc[: len(grams)][ok])
    covered = twice.copy()
    for j in range(1, window):
        covered[j:] |= twice[:-j]
    return {
        "n_words": np.diff(woffs), "word_chars": per_text(inside & codepoint, offs), "n_symbols": per_text(SYMBOLS[buf], offs),
        "n_dup_lines": np.bincount(ld[seen], minlength=n), "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "n_marks": per_text(MARKS[buf], offs), "n_capitals": per_text(CAPITALS[buf] | latin, offs),
    }


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the counts) of every row; null and empty texts: all 0.  One pass, no shuffle."""
    bounded_batches(docs)
    names = [key, *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = as_bytes(batch.column(1))
            for i, j in slices(offs):
                part = offs[i : j + 1]
                got = measure(buf[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray], usual: np.ndarray, weight: int = 20) -> np.ndarray:
    """Characters, symbols, marks and capitals a word, as if ``weight`` words of the usual rates stood before the text.

    So a short text needs more than one odd word to look odd.  Repeated words
    and lines are left to the base rules: a quoted line that stands twice in
    an otherwise clean text would be the rarest trait of all.
    """
    c = {k: np.asarray(v, np.float64) for k, v in c.items()}
    x = np.column_stack([c[r] for r in RATES])
    return (x + weight * usual) / (c["n_words"] + weight)[:, None]


def usual_depth(n) -> np.ndarray:
    """Mean path length of a random search tree of n points."""
    n = np.asarray(n, np.float64)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # tree x inner node, nodes in heap order
    cut: np.ndarray
    path: np.ndarray  # tree x leaf: path length
    points: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual depth): near 1 anomalous, below 0.5 usual."""
        if not self.points:
            return np.zeros(len(x))
        depth = int(np.log2(self.path.shape[1]))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for f, c, p in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            total += p[node - (len(p) - 1)]
        return 2.0 ** (-total / len(self.path) / max(float(usual_depth(self.points)), 1e-9))


def grow(x: np.ndarray, good: np.ndarray | None = None, trees: int = 100, points: int = 256, seed: int = 3) -> Forest:
    """Random trees on subsamples of ``points`` rows; a split takes a random feature that varies, and a random cut.

    With ``good``, only those rows count as points: the others widen the ranges
    that cuts are drawn from, and a region without a good row ends its branch.
    """
    rng = np.random.default_rng(seed)
    good = np.ones(len(x), bool) if good is None or not good.any() else good
    points = min(points, int(good.sum()))
    depth = max(1, int(np.ceil(np.log2(max(points, 2)))))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, path = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if points == 0:
        return Forest(feature, cut, path, 0)
    inside, outside = np.flatnonzero(good), np.flatnonzero(~good)
    for t in range(trees):
        rows: list = [None] * (inner + leaves)
        ended = np.full(inner + leaves, np.nan)
        rows[0] = np.concatenate([rng.choice(inside, points, replace=False), rng.choice(outside, min(points, len(outside)), replace=False)])
        for node in range(inner):
            if not np.isnan(ended[node]):  # below a leaf: all ways lead to it
                ended[2 * node + 1] = ended[2 * node + 2] = ended[node]
                continue
            part = x[rows[node]]
            n = int(good[rows[node]].sum())
            varying = np.flatnonzero(part.max(0) > part.min(0)) if n > 1 else []
            if not len(varying):
                ended[2 * node + 1] = ended[2 * node + 2] = int(np.log2(node + 1)) + float(usual_depth(n))
                continue
            f = int(rng.choice(varying))
            c = rng.uniform(part[:, f].min(), part[:, f].max())
            feature[t, node], cut[t, node] = f, c
            right = part[:, f] >= c
            rows[2 * node + 1], rows[2 * node + 2] = rows[node][~right], rows[node][right]
        for leaf in range(leaves):
            node = inner + leaf
            path[t, leaf] = ended[node] if not np.isnan(ended[node]) else depth + float(usual_depth(good[rows[node]].sum()))
    return Forest(feature, cut, path, points)


def threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray, lose: float = 0.002) -> float:
    """The score above which documents go, from good and bad rows' counts by score: a lost good row weighs ten times a caught bad one, and at most ``lose`` of them go."""
    if not len(score) or not good.any() or not bad.any():
        return 1.0
    order = np.argsort(score)
    lost = (good.sum() - np.cumsum(good[order])) / good.sum()
    caught = (bad.sum() - np.cumsum(bad[order])) / bad.sum()
    ok = lost <= lose  # of the highest score at least
    return float(score[order][ok][np.argmax((caught - 10 * lost)[ok])])


def usual_rates(d: DataFrame) -> np.ndarray:
    """Medians a word over all rows of statistics, on a grid of 1/1000 up to 100 a word: its values are few, whatever the corpus."""
    rate = lambda c: F.least(F.round(F.col(c) / F.greatest("n_words", F.lit(1)), 3), F.lit(100.0))
    got = d.agg(*[F.median(rate(c)).alias(c) for c in RATES]).first()
    return np.array([got[c] or 0.0 for c in RATES])


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000, labelled: int = 20_000, trees: int = 200, points: int = 512) -> DataFrame:
    """Statistics, base_failed, score, kept of every document.

    Base: fewer than 10 words, or over 20 % of the words in repeated 5-word
    windows.  The forest grows on at most about ``sample`` documents that the
    base rules pass, chosen by a hash of the id, and on the good ones of at
    most about ``labelled`` rows of ``labels`` (doc_id, quality).  Usual rates
    come from all documents that the base rules pass, the threshold from all
    labelled ones, by counts on a grid of 10,000 scores.  Without
    labels of both kinds nothing goes beyond the base rules.  Null and empty
    texts fail the base.  Repeated rows are judged alike; an empty table gives
    an empty result.
    """
    d = statistics(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = stored(d)
    passed = d.where(~F.col("base_failed"))
    kept = lambda t, n, most: t.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * most // max(n, 1))))
    row = lambda t, more=(): {c: np.array([r[c] for r in t]) for c in [*COUNTS, *more]}
    sampled = row(kept(passed, passed.count(), sample).orderBy("doc_id", *COUNTS).collect())
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = row(passed.join(kept(marks, marks.count(), labelled), "doc_id").orderBy("doc_id", *COUNTS).collect(), ["quality"])
    good = known["quality"] > 0
    usual = usual_rates(passed)
    # the good rows are the points; documents at large widen the ranges
    known_x, sampled_x = features(known, usual), features(sampled, usual)
    forest = grow(np.concatenate([known_x[good], sampled_x]), np.arange(good.sum() + len(sampled_x)) < good.sum(), trees, points)

    def scored(rows: DataFrame) -> DataFrame:
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = features({c: b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}, usual)
                s = np.round(forest.score(x), 4) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*names, "score"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{schema}, score double")

    tally = scored(passed.join(marks, "doc_id")).groupBy("score").agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).collect()
    limit = threshold(*(np.array([r[c] for r in tally]) for c in ("score", "good", "bad")))
    return scored(d).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= limit))
