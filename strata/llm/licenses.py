"""License scans: an exact set-similarity join of text blocks with templates.

A block is a run of ``block`` words, starting every ``block / 2`` words; a
template is a set of words.  A pair meets the threshold when the block holds
at least o = ceil(threshold * size) of the template's words.  Template words
are ordered by their frequency in the whole corpus, rarest first:

* prefix filter: a block with o of the words holds one of the first size - o + 1,
* length filter: it has at least o distinct words,
* positional filter: if its first common word stands at place i of that order,
  at most size - i can be common, which must reach o.

What passes is counted exactly, so every such block is found.  A template of
few words is a loose set: with ``names`` and ``within`` the o words hold those
that name the license and stand in one run of words.  Templates are a parameter of a few hundred short texts; their index goes into each task.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import bounded_batches
from strata.llm.words import ALNUM, LOWER, as_bytes, prefix_sums, range_hash, slices, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False  # its words must also stand consecutively
    names: str = ""  # those of its words that must not be missing
    within: int = 0  # the words found must stand in a run of so many (0: anywhere in the block)

    @property
    def sequence(self) -> list[str]:
        return WORD.findall(self.text.lower())


def word_hashes(ws: list[str]) -> np.ndarray:
    raw = [w.encode() for w in ws]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    return range_hash(prefix_sums(buf), offs[:-1], offs[1:])


def _hashed_words(buf: np.ndarray, offs: np.ndarray):
    low = LOWER[buf]
    starts, ends, woffs = words(low, offs, ALNUM)
    return range_hash(prefix_sums(low), starts, ends), woffs


def word_counts(docs: DataFrame, wanted: list[str], text: str = "text") -> dict[str, int]:
    """How often each wanted word stands in the corpus: one row a word and task is shuffled."""
    hs = word_hashes(wanted) if wanted else np.zeros(0, np.uint64)
    order = np.argsort(hs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            buf, offs = as_bytes(batch.column(0))
            for i, j in slices(offs):
                part = offs[i : j + 1]
                h, _ = _hashed_words(buf[part[0] : part[-1]], part - part[0])
                at = np.minimum(np.searchsorted(hs[order], h), len(hs) - 1) if len(hs) else np.zeros(0, np.int64)
                total += np.bincount(order[at[hs[order][at] == h]], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(total)], names=["i", "n"])

    if not wanted:
        return {}
    got = docs.select(text).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in wanted} | {wanted[r["i"]]: r["n"] for r in got}


class Index:
    """Prefix postings of the templates under a global word order."""

    def __init__(self, templates: list[Template], counts: dict[str, int], block: int):
        self.templates, self.block = templates, block
        order = sorted({w for t in templates for w in t.sequence}, key=lambda w: (counts.get(w, 0), w))
        self.words = order  # rarest first; a word's id is its rank
        rank = {w: i for i, w in enumerate(order)}
        hs = word_hashes(order) if order else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hs)
        self.hashes = hs[self.by_hash]
        self.sets = [sorted({rank[w] for w in t.sequence}) for t in templates]
        self.sequences = [[rank[w] for w in t.sequence] for t in templates]
        self.least = [max(1, math.ceil(t.threshold * len(s) - 1e-9)) for t, s in zip(templates, self.sets)]
        self.names = [{rank[w] for w in WORD.findall(t.names.lower())} for t in templates]  # KeyError: not a word of any template
        self.postings = defaultdict(list)
        for i, (s, o) in enumerate(zip(self.sets, self.least)):
            for place in s[: len(s) - o + 1]:
                self.postings[place].append(i)
        self.prefix = np.zeros(len(order), bool)
        self.prefix[list(self.postings)] = True
        longest = max([len(s) for s in self.sequences], default=1)
        if longest - 1 > block // 2:
            raise ValueError(f"blocks of {block} words are too short for a template of {longest}")
        widest = max([t.within for t in templates], default=0)
        if widest - 1 > block // 2:
            raise ValueError(f"blocks of {block} words are too short for runs of {widest}")

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Each word's rank, -1 for words of no template."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)

    def common(self, i: int, ranks: list[int]) -> int:
        """Most of a template's words, its naming ones among them, that stand in one run of a block."""
        wanted, most = set(self.sets[i]), 0
        at = [p for p, r in enumerate(ranks) if r in wanted]
        for k, p in enumerate(at):
            run = {ranks[q] for q in at[k:] if not self.templates[i].within or q < p + self.templates[i].within}
            if self.names[i] <= run:
                most = max(most, len(run))
        return most

    def matches(self, ranks: np.ndarray) -> list[tuple[int, int, int, float, list[int]]]:
        """(template, block's first word, past its last, containment, places of a phrase) of one text."""
        n, step, out = len(ranks), self.block // 2, []
        known = np.flatnonzero(ranks >= 0)
        rare = known[self.prefix[ranks[known]]]
        # only blocks with a prefix word: those that start at or up to a block before it
        starts = sorted({s for p in rare.tolist() for s in (p // step * step, p // step * step - step) if s >= 0})
        for s in starts:
            e = min(n, s + self.block)
            here = set(ranks[known[np.searchsorted(known, s) : np.searchsorted(known, e)]].tolist())
            for i in sorted({i for r in here for i in self.postings.get(r, ())}):
                words_, o = self.sets[i], self.least[i]
                if len(here) < o:
                    continue
                first = next(k for k, r in enumerate(words_) if r in here)
                if len(words_) - first < o:
                    continue
                common = sum(r in here for r in words_)
                if common < o:
                    continue
                t, places = self.templates[i], []
                if t.names or t.within:
                    common = self.common(i, ranks[s:e].tolist())
                    if common < o:
                        continue
                if t.phrase:
                    seq = self.sequences[i]
                    places = [p for p in range(s, e - len(seq) + 1) if ranks[p] == seq[0] and ranks[p : p + len(seq)].tolist() == seq]
                    if not places:
                        continue
                out.append((i, s, e, common / len(words_), places))
        return out


def scan(docs: DataFrame, templates: list[Template], block: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, spans) of every document; spans: template, label, phrase, first and past word, containment, places.

    A-Z is lower-cased; words are runs of digits, letters and all characters
    past ASCII.  Null and empty texts have no words and no spans; repeated
    rows are scanned alike; an empty table gives an empty result.  Two passes
    over the texts (word frequencies, then blocks), no shuffle of text.
    """
    bounded_batches(docs)
    counts = word_counts(docs, sorted({w for t in templates for w in t.sequence}), text)
    index = Index(templates, counts, block)
    span = pa.struct([("template", pa.int32()), ("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("past", pa.int64()), ("containment", pa.float64()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = as_bytes(batch.column(1))
            for i, j in slices(offs):
                part = offs[i : j + 1]
                h, woffs = _hashed_words(buf[part[0] : part[-1]], part - part[0])
                ranks = index.ranks(h)
                hit = np.concatenate([[0], np.cumsum((ranks >= 0) & index.prefix[np.maximum(ranks, 0)])]) if len(index.words) else np.zeros(len(ranks) + 1)
                spans = []
                for a, b in zip(woffs[:-1].tolist(), woffs[1:].tolist()):
                    found = index.matches(ranks[a:b]) if hit[b] > hit[a] else []
                    spans.append([{"template": t, "label": templates[t].label, "phrase": templates[t].phrase, "first": s, "past": e, "containment": c, "places": p} for t, s, e, c, p in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(woffs)), pa.array(spans, pa.list_(span))], names=[key, "n_words", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, spans array<struct<template int, label string, phrase boolean, first long, past long, containment double, places array<long>>>")
