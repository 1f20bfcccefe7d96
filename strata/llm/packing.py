"""Best-fit packing by exact-complement hashing.

Which documents are packed together depends on their token counts alone, and
there are at most ``capacity`` different counts.  So the plan is made from a
table of counts (bounded by the capacity, whatever the corpus): patterns of
lengths, each with the number of sequences that follow it.  The gap that a
longest piece leaves is filled exactly by one, two or three lengths, found
in an index of available lengths and pair sums; where none do, by the best
fit.  Each pattern uses up a length, so there are few of them.  Pieces then
find their places by their rank within their length, in parallel.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.layout import bounded_batches, stored
from strata.llm.words import release

def as_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings' ids of a byte-level BPE file whose merges make ids in order, else None.

    Then the vocabulary says all that the merges say, and a rank-based encoder
    of the same vocabulary gives the same ids.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    # the printable stand-ins of bytes: visible Latin-1 characters are themselves, others follow from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(vocab) != 256 + len(merges) or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Texts to little-endian 32-bit token ids, by a tokenizers file.

    Byte-level BPE runs in a rank-based encoder of the file's own vocabulary,
    which gives the same ids three times as fast; other kinds in their
    library.  Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path) as f:
            ranks = as_ranks(json.load(f))
        if ranks:
            import tiktoken

            # Fixed value: the word pattern of byte-level BPE
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.ids = tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self.ids = lambda t: tok.encode(t, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()


def tokenize(docs: DataFrame, path: str, end_id: int, capacity: int, keep_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids) of every document's pieces.

    A document is its ids, then ``end_id``; null and empty texts have that one.
    Longer ones are cut into pieces of ``capacity``; the first may be shorter.
    ``ids``: array of int, left out without ``keep_ids``.
    """
    bounded_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        release()  # of the file's parsed form
        for batch in batches:
            # some texts at a time: their ids are four times as long
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw = encode(t or "") + end
                    n = len(raw) // 4
                    lo, p = 0, 0
                    while lo < n:
                        hi = n - (n - 1 - lo) // capacity * capacity
                        part = raw[4 * lo : 4 * hi] if lo or hi < n else raw
                        row.append(i)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                        lo, p = hi, p + 1
                out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    offs = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class Available:
    """Counts of pieces by length, and exact complements among them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, c in counts.items():
            self.n[length] += c
        self.capacity = capacity

    def times(self, pattern: Counter) -> int:
        return min(int(self.n[x]) // m for x, m in pattern.items())

    def pairs(self, gap: int, least: int = 1) -> np.ndarray:
        """Every a >= gap - a >= least whose pair with gap - a is available, ascending."""
        a = np.arange((gap + 1) // 2, gap - least + 1)
        b = gap - a
        return a[(self.n[a] > (a == b)) & (self.n[b] > 0)]

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three lengths that fill the gap, with the largest smallest one."""
        for c in np.flatnonzero(self.n[1 : gap // 3 + 1])[::-1] + 1:
            self.n[c] -= 1
            two = self.pairs(gap - int(c), int(c))
            self.n[c] += 1
            if len(two):
                return int(two[0]), gap - int(c) - int(two[0]), int(c)
        return None

    def complement(self, gap: int, least: float) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly, the longest of them at least ``least``.

        Of pairs and triples the evenest, so that short pieces are left for
        gaps that nothing else fills.
        """
        if self.n[gap] > 0:
            return (gap,)
        two = self.pairs(gap)
        two = two[two >= least]
        if len(two):
            return int(two[0]), gap - int(two[0])
        three = self.triple(gap)
        return three if three and three[0] >= least else None


# An exact complement may pass over a longer piece that would fit, but by no more than this share of it.
SHARE = 0.75


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) of each pattern; together they use up all counts.

    A sequence starts with the longest piece left.  Its gap is filled by an
    exact complement; without one, by the best fit, and the gap that this
    leaves by an exact complement again, and so on.
    """
    have, out = Available(counts, capacity), []
    while have.n.any():
        pattern, gap = [int(np.flatnonzero(have.n)[-1])], capacity
        have.n[pattern[0]] -= 1
        gap -= pattern[0]
        while len(fits := np.flatnonzero(have.n[: gap + 1])):
            best = int(fits[-1])
            parts = have.complement(gap, SHARE * best) or (best,)
            for x in parts:
                have.n[x] -= 1
            pattern += parts
            gap -= sum(parts)
        c = Counter(pattern)
        for x, m in c.items():
            have.n[x] += m
        t = have.times(c)
        for x, m in c.items():
            have.n[x] -= m * t
        out.append((tuple(sorted(pattern, reverse=True)), t))
    return out


def pack(pieces: DataFrame, capacity: int, per_block: int = 5_000) -> DataFrame:
    """Adds sequence_id and offset to every piece (doc_id, piece, length and any other columns).

    Lengths must lie between 1 and the capacity.  Rows equal in doc_id and
    piece (copies of a document) are pieces of their own.  An empty table gives
    an empty result.  The columns sequence_id, offset, _block and _rank must be free.
    Pieces are ranked within their length in blocks by a hash of their ids, so
    that one length may hold any share of all rows.
    """
    pieces = stored(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError("a piece's length must lie between 1 and the capacity")
    patterns = plan(counts, capacity)
    # by length: where its ranks' runs begin, and what each run's pattern says
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, times in patterns:
        at = 0
        for x, m in sorted(Counter(lengths).items(), reverse=True):
            runs.setdefault(x, []).append((used[x], base, m, at))
            used[x] += m * times
            at += m * x
        base += times
    tables = {x: np.array(r, np.int64).T for x, r in runs.items()}
    blocks = max(1, -(-sum(counts.values()) // per_block))
    d = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = d.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")).select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    d = d.withColumn("_at", F.row_number().over(within)).join(shift, ["length", "_block"])
    d = d.select(*pieces.columns, (F.col("_shift") + F.col("_at") - 1).alias("_rank"))
    names, fields = pieces.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                lo, first, m, at = tables[int(x)]
                i = np.searchsorted(lo, rank[here], "right") - 1
                q = rank[here] - lo[i]
                seq[here], off[here] = first[i] + q // m[i], at[i] + q % m[i] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return d.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids; a group is at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
