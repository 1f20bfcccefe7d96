"""Structured Streaming jobs (survey M01-M07).

The reference is batch-only; these are re-aimed forms of its incremental
and append-log behaviour.  Every job reads files with an explicit schema,
keeps its progress in a checkpoint location under the shared checkpoint
folder, and writes with ``foreachBatch`` steps into published tables: a batch
is one commit, switched to last, and a batch replayed after any failure (a lost
executor, a restarted query) is the same commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.operators.dedup import latest_batch, latest_wins
from strata.operators.ordered import ordered_columns
from strata.session import ensure_checkpoint_dir
from strata.sources.bronze import append_bronze
from strata.sources.published import Published

BUCKET = "_bucket"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/strata/{name}-{uuid.uuid4().hex[:12]}"


def landing_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A landing folder of Parquet batches as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def batch_label(batch: DataFrame, batch_id: int) -> str:
    """Names a micro-batch by its query and number: a query restarted with another checkpoint is another run."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{run}-{batch_id}"


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def touched(table: DataFrame, batch: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The rows of the partitions that a batch touches: their values prune the scan.

    A value a partition, so as many rows at most as the table has folders."""
    return table.join(F.broadcast(batch.select(*parts).distinct()), list(parts), "left_semi")


def alike(a: str, b: str, columns: Sequence[str]) -> Column:
    """Null-safe equality of two aliased frames' columns."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def latest_state_merger(state_path: str, keys: Sequence[str], order: Sequence[str], id_col: str | None = None,
                        buckets: int = 64):
    """M03 + M04: ``foreachBatch`` step keeping the newest row per key.

    The state is a published table partitioned by a hash bucket of the key; a
    batch writes anew only the buckets it touches, once, and its readers see
    whole batches.  Duplicate deliveries are dropped by ``id_col``; the newest
    ``order`` wins, so a late edit never replaces a newer one and a replayed
    batch leaves the state unchanged.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        state = Published(batch.sparkSession, state_path, [BUCKET])

        def merged() -> DataFrame:
            b = bucketed(batch.dropDuplicates([id_col]) if id_col else batch, keys, buckets)
            now = state.read()
            rows = b if now is None else touched(now, b, [BUCKET]).unionByName(b)
            return latest_wins(rows, list(keys), list(order))

        state.publish(merged, batch_label(batch, batch_id))

    return merge


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole commit of a bucketed state, without its bucket."""
    return Published(spark, path, [BUCKET]).read().drop(BUCKET)


def landed_once(batch: DataFrame, path: str, period: str, batch_id: int) -> None:
    """Append a micro-batch to Bronze, unless its mark says it is there.

    A batch replayed after a failure between append and mark lands twice;
    Bronze is append-only and Silver's latest-wins takes one of equal rows."""
    spark = batch.sparkSession
    mark = f"{path}__landed/{batch_label(batch, batch_id)}"
    if not path_exists(spark, f"{mark}/_SUCCESS"):
        append_bronze(batch, path, period)
        spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("overwrite").parquet(mark)


def run_available(stream: DataFrame, step, checkpoint: str) -> None:
    """Process everything currently in the source, then stop."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def affected_partition_refresher(target_path: str, part: str, build, target_part: str | None = None):
    """Per micro-batch, recompute the partitions the batch touches from
    the full Bronze history and publish just those.

    ``build(spark, values)`` gets the touched values of ``part``, the Bronze
    column; the target is partitioned by ``target_part``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = Published(spark, target_path, [target_part or part])
        target.publish(lambda: build(spark, batch.select(part).distinct()), batch_label(batch, batch_id))

    return step


# --- M07: freshness, with late rows kept aside ------------------------------


def freshness_monitor(state_path: str, late_path: str, ts: str, key: str, delay: str = "1 day"):
    """Newest event time and rows per key and day, behind a watermark.

    The watermark of a batch is the newest event time of the batches before it
    less ``delay``; it stands in the state's commit, so a replayed batch meets
    the same one.  Rows behind it do not enter the state: they are kept whole
    in ``late_path``, one folder a batch, to be counted or settled later."""
    parts = ["day"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, label = batch.sparkSession, batch_label(batch, batch_id)
        state, late = Published(spark, state_path, parts), Published(spark, late_path, ["batch"])
        before = state.commit()
        newest = F.lit((before.totals if before else {}).get("newest")).cast("long")
        behind = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < newest - F.lit(_micros(spark, delay)), F.lit(False))
        late.publish(lambda: batch.filter(behind).withColumn("batch", F.lit(label)), label)

        def counted() -> DataFrame:
            rows = batch.filter(~behind).groupBy(F.to_date(ts).alias("day"), key).agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n_rows"))
            now = state.read()
            if now is not None:
                rows = touched(now, rows, parts).unionByName(rows).groupBy("day", key).agg(F.max("newest").alias("newest"), F.sum("n_rows").alias("n_rows"))
            return rows

        own = F.unix_micros(F.max("newest").cast("timestamp"))
        state.publish(counted, label, {"newest": F.greatest(own, newest)})

    return step


def _micros(spark: SparkSession, delay: str) -> int:
    value, unit = delay.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(value) * seconds * 1_000_000


# --- M05: intervals, maintained ---------------------------------------------


def scd2_maintainer(state_path: str, keys: Sequence[str], ts: str, tiebreak: str, buckets: int = 64):
    """Per micro-batch, close or split only the versions that its edits fall into.

    The state holds one row a version, with the (time, id) of the version after
    it.  An edit falls into the one version whose interval contains it, or
    before its key's first; that version then ends at the first of its edits,
    and the last of them ends where it ended.  Late edits thus split an
    interval; repeated ones (the same time and id) change nothing.  The log is
    not read, a key's other versions are passed on as they are, and edits meet
    only those of the same interval."""
    import pyspark.sql.types as T

    here = F.struct(F.col(ts).alias("ts"), F.col(tiebreak).alias("id"))

    def step(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        state = Published(spark, state_path, [BUCKET])

        def maintained() -> DataFrame:
            edits = bucketed(batch.dropDuplicates([*keys, ts, tiebreak]), keys, buckets).withColumn("_at", here)
            at = edits.schema["_at"].dataType
            nothing = F.lit(None).cast(at)
            now = state.read()
            if now is None:
                now = spark.createDataFrame([], T.StructType([*edits.schema.fields, T.StructField("_next", at), T.StructField("_first", T.BooleanType())]))
            old = touched(now, edits, [BUCKET])
            own = [BUCKET, *keys]
            fresh = edits.alias("e").join(old.alias("o"), alike("e", "o", [*own, "_at"]), "left_anti")
            spans = old.select(*own, F.col("_at").alias("_start"), F.col("_next").alias("_stop"), F.lit(False).alias("_head")).unionByName(
                old.filter("_first").select(*own, nothing.alias("_start"), F.col("_at").alias("_stop"), F.lit(True).alias("_head")))
            s, e = spans.alias("s"), fresh.alias("e")
            inside = (F.col("s._start").isNull() | (F.col("s._start") < F.col("e._at"))) & (F.col("s._stop").isNull() | (F.col("e._at") < F.col("s._stop")))
            placed = e.join(s, alike("s", "e", own) & inside, "left").select("e.*", "s._start", "s._stop")
            w = Window.partitionBy(*own, "_start").orderBy("_at")
            new = placed.withColumn("_next", F.coalesce(F.lead("_at").over(w), "_stop")).withColumn(
                "_first", F.col("_start").isNull() & (F.row_number().over(w) == 1))
            ends = placed.groupBy(*own, "_start").agg(F.min("_at").alias("_end"))
            o, c = old.alias("o"), ends.filter(F.col("_start").isNotNull()).alias("c")
            kept = o.join(c, alike("o", "c", own) & (F.col("o._at") == F.col("c._start")), "left").select("o.*", "c._end")
            led = ends.filter(F.col("_start").isNull()).select(*own, F.lit(True).alias("_led"))
            kept = kept.alias("o").join(led.alias("c"), alike("o", "c", own), "left").select("o.*", "c._led")
            kept = kept.withColumn("_next", F.coalesce("_end", "_next")).withColumn("_first", F.col("_first") & F.col("_led").isNull())
            return kept.select(*now.columns).unionByName(new.select(*now.columns))

        state.publish(maintained, batch_label(batch, batch_id))

    return step


def scd2_read(spark: SparkSession, state_path: str, keys: Sequence[str], ts: str, tiebreak: str) -> DataFrame:
    """The maintained timeline with version numbers, as ``scd2_timeline`` gives it."""
    now = Published(spark, state_path, [BUCKET]).read()
    out = ordered_columns(now, keys, [ts, tiebreak], row_number="version")
    return out.withColumn("valid_to", F.col("_next.ts")).withColumn("valid_from", F.col(ts)).withColumn(
        "is_current", F.col("_next").isNull()).drop(BUCKET, "_at", "_next", "_first")


def batch_replacement(target_path: str, scope: Sequence[str], batch_col: str):
    """A micro-batch carrying a newer batch for a scope replaces that
    scope's rows; an older (late) batch for a scope is ignored."""

    def step(batch: DataFrame, batch_id: int) -> None:
        target = Published(batch.sparkSession, target_path, scope)

        def replaced() -> DataFrame:
            now = target.read()
            rows = batch if now is None else touched(now, batch, scope).unionByName(batch)
            return latest_batch(rows, list(scope), batch_col)

        target.publish(replaced, batch_label(batch, batch_id))

    return step


def latest_state_aggregate(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """M04 as a stateful streaming aggregation: the state store keeps, per
    key, the row with the largest ``order`` tuple seen so far.

    ``max_by`` is combined map-side inside each micro-batch and merged with
    the stored state, so a late edit never replaces a newer one and a hot
    key costs one state entry.  Use ``update`` output mode to emit only the
    keys a micro-batch changed (e.g. into ``latest_state_merger``), or
    ``complete`` for small states."""
    payload = [c for c in stream.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order])
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), ordk).alias("_row")).select(
        *keys, "_row.*")
