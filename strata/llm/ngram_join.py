"""N-gram Jaccard join by vertical partitioning, exact.

Documents are sets of word n-grams; two link when their Jaccard similarity
reaches the threshold.  The global n-gram order is by document frequency,
rarest first.

1. Equal sets form a class; its smallest id stands for it.
2. Document frequencies: groups of documents send each distinct n-gram once,
   with its count, so a passage that a third of all rows share is one row a
   group; answers go back to the groups.
3. Prefix filter: of s n-grams, the first s - ceil(threshold * s) + 1 in the
   global order must hold a common one.  An n-gram of frequency 1 is common to
   none, so most documents end here.
4. The rest fall into clusters that prefix n-grams connect.  Clusters are
   dealt to blocks of about ``block`` documents; a larger cluster is split, and
   each two of its blocks meet in one task.
5. Vertical partitioning: the global order is cut into fragments; for each
   block pair and fragment a task counts the overlaps within the fragment, as
   sparse counts of a pair (packed arrays, not rows).  A pair that the length
   filter excludes, or that could not reach the needed overlap with all that
   lies in other fragments, is dropped there.
6. Counts are summed for each block pair, exact similarities decide, and a
   task sends its links' spanning forest and each document's number of links.
   Components come from the forests.

No pair of documents is ever a row, and no cluster is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import components
from strata.llm.layout import bounded_batches, id_groups, stored
from strata.llm.words import LOWER, as_bytes, prefix_sums, range_hash, release, shingles, slices, words

U = np.uint64


def text_sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, distinct hashes, their texts counted from first) of runs of texts."""
    buf, offs = as_bytes(column)
    for i, j in slices(offs):
        low, o = LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, woffs = words(low, o)
        h, doc = shingles(range_hash(prefix_sums(low), starts, ends), woffs, k)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, h[new], doc[new]


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, a, b): a set's size and two sums over its hashes; equal sets agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, doc in text_sets(batch.column(1), k):
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                total = lambda x: np.diff(np.concatenate([[U(0)], np.cumsum(x, dtype=np.uint64)])[ends])  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(total(h).view(np.int64)), pa.array(total((h >> U(7)) * h).view(np.int64))], names=["doc_id", "n", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def planes(x: np.ndarray) -> bytes:
    """Byte plane by byte plane: equal high bytes stand together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def group_sets(t: pa.Table, reps: np.ndarray, k: int):
    """(ids, hashes, index into ids) of a group's representatives, in order of their ids."""
    t = t.filter(pc.is_in(t.column("doc_id"), pa.array(reps, pa.int64()))).sort_by("doc_id")
    ids = t.column("doc_id").to_numpy()
    hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(ids):
        for i, _, h, d in text_sets(t.column("text"), k):
            hs.append(h)
            ds.append(d + i)
    return ids, np.concatenate(hs), np.concatenate(ds)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes fall apart into equal ranges of the hash."""
    return np.searchsorted(keys >> U(32), (np.arange(buckets + 1, dtype=np.uint64) << U(32)) // U(buckets)) if len(keys) else np.zeros(buckets + 1, np.int64)


def needed(na, nb, percent: int):
    """The least overlap of linked sets of these sizes: 100 I >= percent (na + nb - I)."""
    return -(-percent * (na + nb) // (100 + percent))


def candidates(docs: DataFrame, reps: DataFrame, k: int, percent: int, group, buckets: int) -> DataFrame:
    """(doc_id, n, tokens, freqs, prefix) of representatives that the prefix filter leaves.

    tokens: their n-grams of frequency 2 or more in the global order, freqs:
    these frequencies, prefix: how many of them stand in the prefix.
    """
    texts = docs.withColumn("g", group)
    notes = reps.withColumn("g", group).select("g", F.lit(-1).alias("bucket"), "doc_id", F.lit(None).cast("binary").alias("data"))
    sent = "bucket int, g int, data binary"

    def send(t: pa.Table, n: pa.Table) -> pa.Table:
        release()
        rows = []
        if len(t) and len(n):
            _, h, _ = group_sets(t, n.column("doc_id").to_numpy(), k)
            keys, counts = np.unique(h, return_counts=True)
            at = bucket_cuts(keys, buckets)
            g = t.column("g")[0].as_py()
            rows = [(b, g, planes(keys[at[b] : at[b + 1]]) + planes(counts[at[b] : at[b + 1]].astype(np.uint32))) for b in range(buckets) if at[b + 1] > at[b]]
        b, g, d = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(b, pa.int32()), pa.array(g, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "g", "data"])

    def frequency(t: pa.Table) -> pa.Table:
        """Each n-gram's frequency over all groups, in each group's order."""
        parts = [(len(d) // 12, d) for d in t.column("data").to_pylist()]
        keys = np.concatenate([from_planes(d[: 8 * n], np.uint64) for n, d in parts])
        counts = np.concatenate([from_planes(d[8 * n :], np.uint32) for n, d in parts])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        out = np.empty(len(s), np.uint32)
        out[order] = np.minimum(total, (1 << 32) - 1)[np.cumsum(new) - 1]
        at = np.concatenate([[0], np.cumsum([n for n, _ in parts])])
        return pa.table([t.column("g"), t.column("bucket"), pa.nulls(len(parts), pa.int64()), pa.array([planes(out[at[i] : at[i + 1]]) for i in range(len(parts))], pa.binary())], names=["g", "bucket", "doc_id", "data"])

    freqs = texts.groupBy("g").cogroup(notes.groupBy("g")).applyInArrow(send, sent).groupBy("bucket").applyInArrow(frequency, "g int, bucket int, doc_id long, data binary")

    def filtered(t: pa.Table, n: pa.Table) -> pa.Table:
        release()
        got = ([], [], [], [], [])
        if len(t) and len(n):
            is_rep = pc.less(n.column("bucket"), 0)
            ids, h, doc = group_sets(t, n.filter(is_rep).column("doc_id").to_numpy(), k)
            keys, place = np.unique(h, return_inverse=True)
            back = n.filter(pc.invert(is_rep)).sort_by("bucket").column("data").to_pylist()
            f = np.concatenate([np.zeros(0, np.uint32), *(from_planes(d, np.uint32) for d in back)])
            if len(f) != len(keys):
                raise ValueError(f"{len(f)} frequencies of {len(keys)} n-grams")
            f = f[place]
            order = np.lexsort((h, f, doc))
            h, f, ends = h[order], f[order], np.searchsorted(doc, np.arange(len(ids) + 1))
            ones = np.concatenate([[0], np.cumsum(f == 1)])
            size = np.diff(ends)
            alone = ones[ends[1:]] - ones[ends[:-1]]
            prefix = size + percent * size // -100 + 1 - alone  # size - ceil(percent * size / 100) + 1
            for i in np.flatnonzero((prefix > 0) & (size > alone)):
                a, b = ends[i] + alone[i], ends[i + 1]
                for x, v in zip(got, (ids[i], size[i], h[a:b].tobytes(), f[a:b].tobytes(), h[a : min(a + prefix[i], b)].view(np.int64))):
                    x.append(v)
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.binary()), pa.array(got[3], pa.binary()), pa.array(got[4], pa.list_(pa.int64()))], names=["doc_id", "n", "tokens", "freqs", "prefix"])

    return texts.groupBy("g").cogroup(notes.unionByName(freqs).groupBy("g")).applyInArrow(filtered, "doc_id long, n long, tokens binary, freqs binary, prefix array<long>")


def overlaps(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common) of pairs of rows of one cluster, within one fragment.

    Rows: doc_id, root, side (0: left, 1: right block, 2: a block that
    meets itself), n, tokens.  Counted cluster by cluster as products
    of 0/1 matrices over a few thousand n-grams at a time.
    """
    root, side, n = (t.column(c).to_numpy() for c in ("root", "side", "n"))
    tokens = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
    out = []
    order = np.argsort(root, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        within = side[rows[0]] == 2
        left, right = (rows, rows) if within else (rows[side[rows] == 0], rows[side[rows] == 1])
        if not len(left) or not len(right) or within and len(left) < 2:
            continue
        all_ = np.concatenate([tokens[r] for r in rows])
        who = np.repeat(np.arange(len(rows)), [len(tokens[r]) for r in rows])
        keys, col, df = np.unique(all_, return_inverse=True, return_counts=True)
        keep = df[col] > 1
        who, col = who[keep], (np.cumsum(df > 1) - 1)[col[keep]]
        at = {r: i for i, r in enumerate(rows.tolist())}
        li, ri = np.array([at[r] for r in left.tolist()]), np.array([at[r] for r in right.tolist()])
        count = np.zeros((len(left), len(right)), np.float32)
        by = np.argsort(col, kind="stable")
        who, col = who[by], col[by]
        step = 2048
        for lo in range(0, int((df > 1).sum()), step):
            a, b = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((len(rows), step), np.float32)
            m[who[a:b], col[a:b] - lo] = 1
            count += m[li] @ m[ri].T
        na, nb, seg = n[left][:, None], n[right][None, :], np.array([len(tokens[r]) for r in rows])
        elsewhere = np.minimum(na - seg[li][:, None], nb - seg[ri][None, :])
        ok = (count > 0) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (count + elsewhere >= needed(na, nb, percent))
        if within:
            ok &= np.tri(len(left), k=-1, dtype=bool).T
        i, j = np.nonzero(ok)
        out.append((left[i], right[j], count[i, j].astype(np.int64)))
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate([z, *(o[c] for o in out)]) for c in range(3))


def links(c: DataFrame, percent: int, fragments: int, block: int) -> DataFrame:
    """(u, v, links): a spanning forest of each task's links (u > v), and links of u there (v null)."""
    edges = c.select("doc_id", "n", F.explode("prefix").alias("token"))
    low = edges.groupBy("token").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    star = edges.join(low.where("rows > 1"), "token").where("doc_id != low").select("doc_id", "low").distinct()
    roots = components(star)
    # alone in their prefix n-grams: no partner
    both = roots.union(roots.select("root", "root").distinct()).toDF("doc_id", "root")
    sizes = both.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    d = c.drop("prefix").join(both.join(sizes, "root"), "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    # small clusters share tasks; a large one has a task for each two of its blocks
    bins = F.lit(max(1, c.sparkSession.sparkContext.defaultParallelism * 16))
    d = d.withColumn("task", F.when(F.col("blocks") == 1, F.concat_ws(":", F.lit("bin"), F.pmod(F.xxhash64("root"), bins))).otherwise(F.concat_ws(":", "root", a, b)))
    d = d.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0)).select("task", "doc_id", "root", "side", "n", "copies", "tokens", "freqs")
    # the global order is cut at quantiles of the frequency, then of the hash within one frequency
    names = ["task", "fragment", "doc_id", "root", "side", "n", "copies", "tokens"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, freqs = batch.column("tokens").to_pylist(), batch.column("freqs").to_pylist()
            row, frag, part = [], [], []
            for i, (x, f) in enumerate(zip(tokens, freqs)):
                t, f = np.frombuffer(x, np.uint64), np.frombuffer(f, np.uint32)
                # a rule of (frequency, hash) alone, monotone in the global order within a frequency band
                band = np.minimum(np.log2(f).astype(np.int64) - 1, 1) * (fragments // 2)
                place = band + ((t >> U(32)) * U(max(1, fragments // 2)) >> U(32)).astype(np.int64)
                for q in range(fragments):
                    row.append(i)
                    frag.append(q)
                    part.append(t[place == q].tobytes())
            take = pa.array(row, pa.int64())
            cols = [batch.column(c).take(take) for c in ("doc_id", "root", "side", "n", "copies")]
            yield pa.RecordBatch.from_arrays([batch.column("task").take(take), pa.array(frag, pa.int32()), *cols, pa.array(part, pa.binary())], names=names)

    kinds = "task string, fragment int, doc_id long, root long, side int, n long, copies long, tokens binary"
    segments = d.mapInArrow(split, kinds)

    def count(t: pa.Table) -> pa.Table:
        # the same order of documents in every fragment of a task
        t = t.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        i, j, common = overlaps(t, percent)
        ids, n, copies = (t.column(c).to_numpy() for c in ("doc_id", "n", "copies"))
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        data = [x.astype(np.int64).tobytes() for x in (ids[used], n[used], copies[used], at[: len(i)], at[len(i) :], common)]
        return pa.table([t.column("task").slice(0, 1), *(pa.array([x], pa.binary()) for x in data)], names=["task", "ids", "n", "copies", "i", "j", "common"])

    counted = segments.groupBy("task", "fragment").applyInArrow(count, "task string, ids binary, n binary, copies binary, i binary, j binary, common binary")

    def decide(t: pa.Table) -> pa.Table:
        col = lambda c: [np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]
        parts = list(zip(*(col(c) for c in ("ids", "n", "copies", "i", "j", "common"))))
        ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        n, copies = (np.concatenate([p[c] for p in parts])[first] for c in (1, 2))
        a, b = (np.concatenate([np.searchsorted(ids, p[0])[p[c]] for p in parts]) for c in (3, 4))
        a, b = np.minimum(a, b), np.maximum(a, b)
        pair, place = np.unique(a * len(ids) + b, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([p[5] for p in parts]), minlength=len(pair)).astype(np.int64)
        a, b = (pair // max(len(ids), 1)), (pair % max(len(ids), 1))
        ok = 100 * total >= percent * (n[a] + n[b] - total)
        a, b = a[ok], b[ok]
        degree = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
        # smallest label along links until nothing changes; ids are in order, so labels are least ids
        label = np.arange(len(ids))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        tree = np.flatnonzero(label != np.arange(len(ids)))
        linked = np.flatnonzero(degree > 0)
        u, v = np.concatenate([ids[tree], ids[linked]]), pa.array(np.concatenate([ids[label[tree]], ids[linked]]), mask=np.arange(len(tree) + len(linked)) >= len(tree))
        return pa.table([pa.array(u, pa.int64()), v.cast(pa.int64()), pa.array(np.concatenate([np.zeros(len(tree)), degree[linked]]).astype(np.int64))], names=["u", "v", "links"])

    return counted.groupBy("task").applyInArrow(decide, "u long, v long, links long")


def join(docs: DataFrame, k: int = 5, percent: int = 80, fragments: int = 4, block: int = 1024, group_bytes: int = 4 << 20, bucket_keys: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of (doc_id, text).

    A-Z is lower-cased; a set is the distinct runs of k words, with fewer words
    the whole sequence as one.  Null texts and texts without words have no set
    and no links.  Rows of one doc_id are one document of several texts: its
    component is that of all of them.  component_id: the smallest doc_id that
    links reach, itself included; null ids keep a null component.  n_links:
    documents linked directly, those of an equal set included.  An empty table
    gives an empty result.
    """
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = stored(set_keys(docs, k))
    full = keyed.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"))
    members = full.join(classes, ["n", "a", "b"]).select("doc_id", "rep", "copies")
    reps = stored(classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("copies").alias("copies")))
    group, groups = id_groups(docs, group_bytes)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_keys))
    c = stored(candidates(docs, reps.select("doc_id"), k, percent, group, buckets).join(reps, "doc_id"))
    found = stored(links(c, percent, fragments, block))
    # classes whose ids are not their component's smallest, and rows of one id in several classes
    edges = members.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).unionByName(found.where("v IS NOT NULL").select("u", "v"))
    roots = components(edges)
    degree = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    near = members.groupBy("doc_id", "rep").agg(F.first("copies").alias("copies")).join(degree, "rep", "left").groupBy("doc_id").agg((F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)).alias("n_links"))
    d = keyed.select("doc_id", F.col("n").alias("n_shingles"))
    d = d.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(near, "doc_id", "left")
    return d.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
