"""Hard-negative mining: exact integer scores by Strassen's products of tiles, then heaps that merge.

Rows are packed into tiles where they are read, up to ``TILE`` of them in a row
of bytes.  Anchors are packed likewise.  A tile pair is one product: operands
padded with zeros, Strassen's seven products down to a leaf, integer additions
only.  Sums wrap alike on every way through int64, so a score is exact whenever
it fits int64 itself.

* Positives: anchor tiles meet candidate tiles of their label; of each pair the
  first few rows of each anchor go on, and a group-limited window merges them.
* Windows: anchors carry their positives' scores; anchor tiles and candidate
  tiles are dealt to the cells of a grid, each tile to every cell of its line,
  so that each pair meets once.  Of each pair the first few rows in each window
  go on and are merged likewise.

No tile, no cell and no merge holds more than a bounded number of rows, however
many share a label, a vector or an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 4_096  # candidates in a tile
ANCHORS = 1_024  # anchors in a tile
LEAF = 128  # products this small, or of so thin operands, are done plainly
EXACT = 1 << 52


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product: through doubles where every sum is below 2**52, else in wrapping int64."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product a @ b; odd edges are padded with zeros."""
    n, m = a.shape
    p = b.shape[1]
    if min(n, m, p) <= leaf // 2 or max(n, m, p) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, n % 2), (0, m % 2)))
    b = np.pad(b, ((0, m % 2), (0, p % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:n, :p]


TILES = "tile string, label long, rows long, width long, ids binary, null_ids binary, labels binary, vectors binary, extra binary"
NO_ID = np.iinfo(np.int64).max  # a null id sorts last


def _tiles(per_tile: int, by_label: bool, extra: int):
    """mapInArrow: rows (id, label, vector[, extra]) to tiles; those of one label apart if ``by_label``."""

    def packed(key: str, label, rows: list) -> dict:
        width = max(len(r[2]) for r in rows)
        vectors = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            vectors[i, :len(r[2])] = r[2]
        more = np.zeros((len(rows), extra, 2), np.int64)
        for i, r in enumerate(rows):
            for k, pair in enumerate(r[3] if extra else ()):
                more[i, k] = pair
        return dict(tile=key, label=label, rows=len(rows), width=width, ids=np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64).tobytes(),
                    null_ids=np.array([r[0] is None for r in rows]).tobytes(), labels=np.array([r[1] for r in rows], np.int64).tobytes(), vectors=vectors.tobytes(), extra=more.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in TILES.split(", "))])
        held: dict = {}
        waiting = 0

        def tile(label):
            nonlocal number, waiting
            rows = held.pop(label)
            waiting -= len(rows)
            number += 1
            return pa.RecordBatch.from_pylist([packed(f"{part}:{number}", label, rows)], schema)

        for batch in batches:
            vectors = batch.column("vector")
            values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + vectors.value_lengths().to_pylist())
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            more = batch.column("extra").to_pylist() if extra else [None] * len(ids)
            for i, label in enumerate(labels):
                k = label if by_label else None
                held.setdefault(k, []).append((ids[i], label, values[ends[i]:ends[i + 1]].copy(), more[i] and [(p["rank"], p["score"]) for p in more[i]]))
                waiting += 1
                if len(held[k]) >= per_tile:
                    yield tile(k)
                if waiting >= 16 * per_tile:  # many labels: what waits stays bounded
                    yield tile(max(held, key=lambda x: len(held[x])))
        for k in list(held):
            yield tile(k)

    return run


def _matrix(x, side: str) -> np.ndarray:
    return np.frombuffer(x[f"{side}_vectors"], np.int64).reshape(x[f"{side}_rows"], x[f"{side}_width"])


def _product(x) -> np.ndarray:
    a, b = _matrix(x, "a"), _matrix(x, "c")
    width = max(a.shape[1], b.shape[1])
    return strassen(np.pad(a, ((0, 0), (0, width - a.shape[1]))), np.pad(b, ((0, 0), (0, width - b.shape[1]))).T)


def _first(scores: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Places of the first ``many`` by score, then id."""
    if len(scores) > 4 * many:
        least = np.partition(scores, len(scores) - many)[len(scores) - many]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))][:many]
    return np.lexsort((ids, -scores))[:many]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _ids(x, side: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x[f"{side}_ids"], np.int64), np.frombuffer(x[f"{side}_null_ids"], bool)


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


POSITIVES = "anchor_key long, anchor_id long, positive_id long, positive_score long"


def _positives(many: int):
    """mapInArrow: pairs of tiles of one label to the first few rows of each anchor."""

    def run(batches):
        schema = pa.schema([(n, pa.int64()) for n in ("anchor_key", "anchor_id", "positive_id", "positive_score")])
        for x in _pairs(batches):
            scores, (ids, none), (anchors, _) = _product(x), _ids(x, "c"), _ids(x, "a")
            keys = np.frombuffer(x["a_extra"], np.int64).reshape(-1, 1, 2)[:, 0, 0]
            rows = []
            for i, anchor in enumerate(anchors):
                others = np.flatnonzero((ids != anchor) & ~none)
                for j in others[_first(scores[i, others], ids[others], many)]:
                    rows.append((int(keys[i]), int(anchor), int(ids[j]), int(scores[i, j])))
            if rows:
                yield _columns(schema, rows)

    return run


NEGATIVES = "anchor_key long, place long, negative_id long, negative_score long"


def _negatives(many: int, low: int, high: int):
    """mapInArrow: pairs of tiles to the first few rows of other labels in each window of each anchor."""

    def run(batches):
        schema = pa.schema([(n, pa.int64()) for n in ("anchor_key", "place", "negative_id", "negative_score")])
        for x in _pairs(batches):
            scores, (ids, none) = _product(x), _ids(x, "c")
            labels, own = np.frombuffer(x["c_labels"], np.int64), np.frombuffer(x["a_labels"], np.int64)
            extra = np.frombuffer(x["a_extra"], np.int64).reshape(x["a_rows"], -1, 2)
            rows = []
            for i in range(x["a_rows"]):
                key, windows = int(extra[i, 0, 0]), [(int(r), int(s)) for r, s in extra[i, 1:] if r]
                # low * positive <= high * negative <= high * positive, in whole numbers
                windows = [(r, -(-low * s // high), s) for r, s in windows if -(-low * s // high) <= s]
                if not windows:
                    continue
                row = scores[i]
                some = np.flatnonzero((row >= min(w[1] for w in windows)) & (row <= max(w[2] for w in windows)) & (labels != own[i]))
                if not len(some):
                    continue
                for r, least, most in windows:
                    here = some[(row[some] >= least) & (row[some] <= most)]
                    for j in here[_first(row[here], ids[here], many)]:
                        rows.append((key, r, None if none[j] else int(ids[j]), int(row[j])))
            if rows:
                yield _columns(schema, rows)

    return run


def usable(rows: DataFrame) -> DataFrame:
    """id, label and the whole-number vector of the rows that take part, labels shifted as given."""
    x = F.col("embedding")
    fine = F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return rows.filter(fine).select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("vector"))


def _tiled(d: DataFrame, per_tile: int, by_label: bool, side: str, extra: int = 0) -> DataFrame:
    t = d.mapInArrow(_tiles(per_tile, by_label, extra), TILES)
    return t.select(*[F.col(c).alias(f"{side}_{c}") for c in t.columns])


def _cell(tile: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(tile), F.lit(of)).cast("int")


def _merged(found: DataFrame, by: list[str], score: str, id_: str, many: int, place: str) -> DataFrame:
    """The first few of each heap: limited in every task, again after the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_).asc_nulls_last())
    return found.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= many)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, many: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Negatives of each (anchor, positive): anchor_id, positive_id, rank, negative_id and both scores.

    ``rows`` has id, label and vector (whole numbers) as ``usable`` gives them.
    Anchors are the ids divisible by ``every``; an anchor's positives are the
    first ``positives`` rows of its label with another id; negatives are the
    first ``many`` rows of other labels whose score s satisfies
    low * p <= high * s <= high * p for the positive's score p.

    Shorter vectors count as padded with zeros, empty ones score 0.  Anchor rows
    repeated whole are one anchor; an id with several vectors or labels is an
    anchor for each.  Other repeated rows each count.  A row with a null id is
    nobody's positive, but may be a negative, after all ids of its score.
    Further columns are left alone; an empty table gives an empty result.
    """
    rows = rows.select("id", "label", "vector")
    chosen = rows.filter(F.col("id") % every == 0).dropDuplicates().withColumn("anchor_key", F.xxhash64("id", "label", "vector"))
    own = F.array(F.struct(F.col("anchor_key").alias("rank"), F.lit(0).cast("long").alias("score")))

    of_label = _tiled(rows, TILE, True, "c")
    anchors = _tiled(chosen.select("id", "label", "vector", own.alias("extra")), ANCHORS, True, "a", 1)
    met = anchors.join(of_label, F.col("a_label") == F.col("c_label"))
    found = met.select("a_ids", "a_null_ids", "a_extra", "a_rows", "a_width", "a_vectors", "c_ids", "c_null_ids", "c_rows", "c_width", "c_vectors").mapInArrow(_positives(positives), POSITIVES)
    best = _merged(found, ["anchor_key"], "positive_score", "positive_id", positives, "place")

    # each anchor with its key and its positives' scores: the windows
    lists = best.groupBy("anchor_key").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("rank"), F.col("positive_score").alias("score"))).alias("windows"))
    ready = chosen.join(lists, "anchor_key").select("id", "label", "vector", F.concat(own, "windows").alias("extra"))
    n = rows.count()
    lines, cells = max(1, -(-n // (every * ANCHORS * 4))), max(1, -(-n // (TILE * 4)))
    a = _tiled(ready, ANCHORS, False, "a", positives + 1).withColumn("line", _cell(F.col("a_tile"), lines)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = _tiled(rows, TILE, False, "c").withColumn("cell", _cell(F.col("c_tile"), cells)).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    grid = a.join(c, ["line", "cell"]).select("a_extra", "a_labels", "a_rows", "a_width", "a_vectors", "c_ids", "c_null_ids", "c_labels", "c_rows", "c_width", "c_vectors")
    near = _merged(grid.mapInArrow(_negatives(many, low, high), NEGATIVES), ["anchor_key", "place"], "negative_score", "negative_id", many, "rank")
    return near.join(best.withColumn("place", F.col("place").cast("long")), ["anchor_key", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
