"""Suffix-array dedup of byte passages across documents, exact.

A document loses each byte covered by a string of ``least`` bytes that also
starts in a document with a smaller id.

A suffix array of every byte would be sixteen times the corpus.  Sorted here
are the suffixes at *anchors*: in each window of ``least`` bytes, the place of
the ``gram`` bytes with the smallest hash (ties: leftmost).  Equal windows
have their anchor at the same place within them, so whatever repeats, repeats
around anchors.  Neighbouring windows share an anchor; those of one anchor
form its context.

1. Each group of documents (a range of ids) sends its distinct suffixes:
   leading eight bytes, hash of the gram, 64-bit hash of the context.  Sampled
   splitters on the leading bytes (then the gram) range-partition them.
2. A bucket sorts its suffixes by those keys, leading bytes first.  Equal
   contexts stand together: all but those of the first group are repeats.
   Grams whose contexts differ are contested.
3. Of contested first contexts, all windows are sent in the same way (leading
   bytes, hash of the window), sorted and answered.
4. Each group takes its answers and removes what is covered.

Groups send a suffix once, so a passage that a third of all documents share
is one row a group.  A bucket's neighbours need no look across its boundary:
splitters never part equal keys.  Answers go to groups, never to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import bounded_batches, id_groups
from strata.llm.words import M1, as_bytes, mix, powers, prefix_sums, range_hash, release, slices

U = np.uint64
Keys = tuple[np.ndarray, ...]
#: Sorted and sent: of a context, leading bytes, gram's hash (32 bits: two grams under one only make it contested) and the whole
#: hash of the context; of a window, leading bytes and its whole hash.
CONTEXT, WINDOW = (np.uint64, np.uint32, np.uint64), (np.uint64, np.uint64)
ANSWERS = "g int, bucket int, data binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a big-endian number: it sorts like the bytes."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << U(8)) | buf[at + j].astype(np.uint64)
    return out


class Part:
    """Anchors of some whole texts of a group."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, least: int, gram: int):
        self.buf, self.offs, self.least = buf, offs, least
        n = len(buf)
        sums = prefix_sums(buf)
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.doc = empty
        self.lead = self.tail = np.zeros(0, np.uint64)
        self.gram = np.zeros(0, np.uint32)
        long = np.flatnonzero(np.diff(offs) >= least)
        if not len(long):
            return
        h = mix((sums[gram:] - sums[:-gram]) * powers(n + 1, inverse=True)[: n - gram + 1])
        bits = U(max(21, n.bit_length()))
        low = (U(1) << bits) - U(1)
        anchor = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), least - gram + 1)
        anchor = (anchor & low).astype(np.int64)  # by window
        ok = np.zeros(n - least + 2, np.int8)
        np.add.at(ok, offs[long], 1)
        np.add.at(ok, offs[long + 1] - least + 1, -1)
        at = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
        a = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.hi = at[first], at[np.append(first[1:], len(at)) - 1]
        a = a[first]
        self.doc = np.searchsorted(offs, self.lo, "right") - 1
        self.tail = mix(range_hash(sums, self.lo, self.hi + least) + (a - self.lo).astype(np.uint64) * M1)
        self.lead, self.gram = leading(buf, a), (h[a] >> U(32)).astype(np.uint32)

    def windows(self, runs: np.ndarray):
        """(start, run's document, leading bytes, hash) of each window of some contexts."""
        n = self.hi[runs] - self.lo[runs] + 1
        starts = np.repeat(self.lo[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(runs) else np.zeros(0, np.int64)
        hashes = range_hash(prefix_sums(self.buf), starts, starts + self.least) if len(starts) else np.zeros(0, np.uint64)
        return starts, np.repeat(self.doc[runs], n), leading(self.buf, starts), hashes


def changes(keys: Keys) -> np.ndarray:
    """Which sorted keys differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def grouped(keys: Keys, rank: np.ndarray):
    """Distinct keys in order; each row's place among them, and each key's first rank."""
    order = np.lexsort((rank, *keys[::-1]))
    ordered = tuple(k[order] for k in keys)
    new = changes(ordered)
    first = np.flatnonzero(new)
    place = np.empty(len(new), np.int64)
    place[order] = np.cumsum(new) - 1
    return tuple(k[first] for k in ordered), place, rank[order][first]


def pack_keys(keys: Keys) -> bytes:
    """Sorted keys, byte plane by byte plane, so that equal high bytes compress."""
    return b"".join(np.ascontiguousarray(k).view(np.uint8).reshape(len(k), -1).T.tobytes() for k in keys)


def unpack_keys(data: bytes, kinds: tuple[type, ...]) -> Keys:
    widths = [np.dtype(k).itemsize for k in kinds]
    planes, at = np.frombuffer(data, np.uint8).reshape(sum(widths), -1), np.cumsum([0, *widths])
    return tuple(np.ascontiguousarray(planes[i:j].T).view(k)[:, 0] for k, i, j in zip(kinds, at, at[1:]))


def cut(keys: Keys, splitters: np.ndarray) -> np.ndarray:
    """Where sorted keys fall apart at the splitters (lead, second key); equal seconds stay together."""
    lead, second = keys[:2]
    shift = U(64 - 8 * second.dtype.itemsize)  # splitters have 64 bits
    at = []
    for a, b in splitters:
        i, j = np.searchsorted(lead, a, "left"), np.searchsorted(lead, a, "right")
        at.append(i + np.searchsorted(second[i:j], (b >> shift).astype(second.dtype), "left"))
    return np.array([0, *at, len(lead)], np.int64)


def rows_of(g: int, keys: Keys, splitters: np.ndarray):
    at = cut(keys, splitters)
    full = np.flatnonzero(at[1:] > at[:-1])
    return [(int(b), g, pack_keys(tuple(k[at[b] : at[b + 1]] for k in keys))) for b in full]


def table_of(rows: list[tuple[int, int, bytes]], names: list[str]) -> pa.Table:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.large_binary()).cast(pa.binary())], names=names)


def loose(column: pa.ChunkedArray) -> pa.Array:
    """A struct column whose fields may be null, as the result's schema says."""
    x = column.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x
    return pa.StructArray.from_arrays([x.field(i) for i in range(x.type.num_fields)], names=[f.name for f in x.type]) if isinstance(x, pa.StructArray) else x


class Group:
    """The documents of one id range, in order of their ids."""

    def __init__(self, t: pa.Table, least: int, gram: int):
        self.g = t.column("g")[0].as_py()
        t = t.sort_by([("doc_id", "ascending")])  # nulls last
        self.ids, self.rest = t.column("doc_id").combine_chunks(), loose(t.column("rest"))
        buf, offs = as_bytes(t.column("text"))
        # equal ids have one rank: they are not smaller than each other
        rank = pa.compute.rank(self.ids, "ascending", null_placement="at_end", tiebreaker="min").to_numpy() if len(self.ids) else np.zeros(0)
        self.rank = rank.astype(np.int64)
        self.parts = [(i, Part(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least, gram)) for i, j in slices(offs, 1 << 18)]
        cat = lambda f: np.concatenate([f(i, p) for i, p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.run_rank = self.rank[cat(lambda i, p: p.doc + i)] if self.parts else np.zeros(0, np.int64)
        keys = tuple(cat(f).astype(k) for f, k in zip((lambda i, p: p.lead, lambda i, p: p.gram, lambda i, p: p.tail), CONTEXT))
        self.keys, self.place, self.first = grouped(keys, self.run_rank)

    def settle(self, flags: np.ndarray):
        """Covered contexts, and the windows of those to be looked at one by one."""
        self.covered = (flags[self.place] & 1).astype(bool) | (self.run_rank > self.first[self.place])
        open_ = (flags[self.place] & 2).astype(bool) & ~self.covered
        self.starts, lead, tail, rank, at = [], [], [], [], 0
        for i, p in self.parts:
            runs = np.flatnonzero(open_[at : at + len(p.lo)])
            at += len(p.lo)
            s, d, a, b = p.windows(runs)
            self.starts.append(s)
            lead.append(a)
            tail.append(b)
            rank.append(self.rank[d + i])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.w_rank = cat(rank, np.int64)
        self.w_keys, self.w_place, self.w_first = grouped((cat(lead, np.uint64), cat(tail, np.uint64)), self.w_rank)

    def removed(self, flags: np.ndarray) -> Iterator[tuple[int, Part, np.ndarray]]:
        """Each part with a mark on every byte that goes."""
        gone = (flags[self.w_place] & 1).astype(bool) | (self.w_rank > self.w_first[self.w_place])
        at = wat = 0
        for (i, p), s in zip(self.parts, self.starts):
            c = self.covered[at : at + len(p.lo)]
            w = s[gone[wat : wat + len(s)]]
            at, wat = at + len(p.lo), wat + len(s)
            edge = np.zeros(len(p.buf) + 1, np.int32)
            np.add.at(edge, np.concatenate([p.lo[c], w]), 1)
            np.add.at(edge, np.concatenate([p.hi[c], w]) + p.least, -1)
            yield i, p, np.cumsum(edge[:-1]) > 0


def answers(t: pa.Table | None, kind: int, total: int) -> np.ndarray:
    """A group's answers of one round, in the order of its sorted keys."""
    rows = [] if t is None else sorted((b, d) for b, d in zip(t.column("bucket").to_pylist(), t.column("data").to_pylist()) if (b >= 0) == (kind == 0))
    data = b"".join(d for _, d in rows) if kind == 0 else rows[0][1] if rows else b""
    out = np.frombuffer(data, np.uint8)
    if len(out) != total:
        raise ValueError(f"{len(out)} answers to {total} keys")
    return out


def resolve(t: pa.Table, kinds: tuple[type, ...]) -> pa.Table:
    """Flags of a bucket's keys: 1, an earlier group has it; 2, its gram has other contexts too."""
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:  # a group's own answers of the first round, handed on
        return pa.table([t.column("g"), t.column("bucket"), t.column("data")], names=["g", "bucket", "data"])
    gs, datas = t.column("g").to_numpy(), t.column("data").to_pylist()
    parts = [unpack_keys(d, kinds) for d in datas]
    n = [len(k[0]) for k in parts]
    keys, g = tuple(np.concatenate(k) for k in zip(*parts)), np.repeat(gs, n)
    order = np.lexsort((g, *keys[::-1]))
    keys, gg = tuple(k[order] for k in keys), g[order]
    new = changes(keys)
    first = gg[np.flatnonzero(new)][np.cumsum(new) - 1]
    of = np.cumsum(changes(keys[:2])) - 1
    contexts = np.bincount(of, weights=new)
    flags = np.empty(len(gg), np.uint8)
    flags[order] = (gg > first).astype(np.uint8) | (2 * (contexts[of] > 1)).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(n)])
    return table_of([(int(x), bucket, flags[at[i] : at[i + 1]].tobytes()) for i, x in enumerate(gs)], ["g", "bucket", "data"])


def sample_splitters(docs: DataFrame, n_bytes: int, buckets: int, least: int, gram: int, rows: int = 40_000) -> np.ndarray:
    """buckets - 1 quantiles of about ``rows`` suffixes, from whole documents chosen by a hash of their text."""
    if buckets <= 1:
        return np.zeros((0, 2), np.uint64)
    expected = max(1, 2 * n_bytes // (least - gram + 2))
    thin = max(1, 16 * rows // 1_000_000)
    share = min(1.0, rows * 16 / expected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = as_bytes(b.column(0))
            for i, j in slices(offs, 1 << 18):
                p = Part(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], least, gram)
                keep = mix(p.tail) % U(16 * thin) == 0  # one in sixteen of theirs
                yield pa.RecordBatch.from_arrays([pa.array(p.lead[keep].view(np.int64)), pa.array(p.gram[keep].astype(np.int64))], names=["a", "b"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = chosen.select("text").mapInArrow(run, "a long, b long").toArrow()
    a, b = (got.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    order = np.lexsort((b, a))
    at = np.arange(1, buckets) * len(a) // buckets
    if not len(a):
        return np.zeros((0, 2), np.uint64)
    s = np.column_stack([a[order][at], b[order][at] << U(32)])
    return np.unique(s, axis=0)


def whole_characters(spans: list[list[int]], raw: np.ndarray) -> list[list[int]]:
    """Spans widened to the edges of UTF-8 characters, joined where they meet."""
    out: list[list[int]] = []
    for s, e in spans:
        while s > 0 and s < len(raw) and raw[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def dedup(docs: DataFrame, least: int = 50, gram: int | None = None, characters: bool = False, carry: bool = False, group_bytes: int = 4 << 20, bucket_keys: int = 400_000) -> DataFrame:
    """(doc_id, kept, spans) of every row of (doc_id, text).

    ``kept``: the remaining bytes; ``spans``: start and length of each maximal
    removed run.  Matches lie within one document's bytes and are judged on
    the input.  With ``characters`` a character that a span's edge would split
    goes whole, so that what remains is text.  With ``carry`` a struct ``rest``
    of the row's other columns comes along.  Null and empty texts keep nothing
    and lose nothing.  Rows of one doc_id never cover each other; null ids come
    after all others and count as one.  An empty table gives an empty result.
    """
    bounded_batches(docs)
    gram = gram or max(8, min(28, least // 2 - 1))
    if least < gram + 1:
        raise ValueError("least must be over 8 bytes")
    rest = [F.col(c) for c in docs.columns if carry and c not in ("doc_id", "text")]
    spare = "_" * (1 + max(map(len, docs.columns)))  # a struct needs a field, of a name that no column has
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest, F.lit(0).alias(spare)).alias("rest"))
    rest_kind = docs.schema["rest"].dataType.simpleString()
    group, _ = id_groups(docs, group_bytes)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-2 * n_bytes // (least - gram + 2) // bucket_keys))
    splitters = sample_splitters(docs, n_bytes, buckets, least, gram)
    texts = docs.withColumn("g", group)
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def suffixes(t: pa.Table) -> pa.Table:
        release()
        x = Group(t, least, gram)
        return table_of(rows_of(x.g, x.keys, splitters), ["bucket", "g", "data"])

    def windows(t: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(t):
            return table_of([], ["bucket", "g", "data"])
        release()
        x = Group(t, least, gram)
        own = answers(flags, 0, len(x.keys[0]))
        x.settle(own)
        return table_of([(-1 - x.g, x.g, own.tobytes()), *rows_of(x.g, x.w_keys, splitters)], ["bucket", "g", "data"])

    def strip(t: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], span_kind), loose(t.column("rest"))], names=["doc_id", "kept", "spans", "rest"])
        release()
        x = Group(t, least, gram)
        x.settle(answers(flags, 1, len(x.keys[0])))
        kept, spans = [], []
        for _, p, gone in x.removed(answers(flags, 0, len(x.w_keys[0]))):
            total = np.concatenate([[0], np.cumsum(gone)])
            for a, b in zip(p.offs[:-1].tolist(), p.offs[1:].tolist()):
                raw, found = p.buf[a:b], []
                if total[b] > total[a]:
                    found = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    if characters:
                        found = whole_characters(found, raw)
                at = [0, *(q for s in found for q in s), b - a]
                kept.append(b"".join(raw[at[i] : at[i + 1]].tobytes() for i in range(0, len(at), 2)))
                spans.append([{"start": s, "length": e - s} for s, e in found])
        return pa.table([x.ids.cast(pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span_kind), x.rest], names=["doc_id", "kept", "spans", "rest"])

    sent = "bucket int, g int, data binary"
    first = texts.groupBy("g").applyInArrow(suffixes, sent).groupBy("bucket").applyInArrow(lambda t: resolve(t, CONTEXT), ANSWERS)
    second = texts.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(windows, sent).groupBy("bucket").applyInArrow(lambda t: resolve(t, WINDOW), ANSWERS)
    out = texts.groupBy("g").cogroup(second.groupBy("g")).applyInArrow(strip, f"doc_id long, kept binary, spans array<struct<start:long,length:long>>, rest {rest_kind}")
    return out if carry else out.drop("rest")


def strip_texts(docs: DataFrame, least: int) -> DataFrame:
    """The documents with what repeats cut out of their texts; columns, whatever their names, and rows stay (null texts become empty)."""
    d = dedup(docs, least, characters=True, carry=True)
    return d.select(*[F.col("kept").cast("string").alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("rest").getField(c).alias(c) for c in docs.columns])
