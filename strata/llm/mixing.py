"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words.  Among all document rates between
0 and ``most`` whose words meet the targets, the one closest in entropy to
rate 1 is an exponential tilt of the size, min(most, exp(lambda * size)); its
lambda is the optimum of the convex dual, found for all sources at once by
Newton steps.  A step is one Spark aggregation over the (source, size, count)
table; only its largest error comes to the driver.  Rates are then rounded
into whole copies so that a source's words land within a document of its
target.  DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.layout import stored, words_of

EXACT = "decimal(38,9)"  # sums that do not depend on the order of rows


def targets(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Adds weight and target to (source, source_size, source_rows).

    Sources in code point order, null last, take the weights in turn and share
    100 % of all words by them; a target stops at ``most`` times its source and
    the excess is shared again by weight.  Sorted by their ratio to the weight,
    the stopped sources come first, so one running sum settles the sharing.
    The windows are over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    d = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    d = d.withColumn("_ratio", most * F.col("source_size") / F.col("weight"))
    by = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    all_rows, before = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_level", (F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    d = d.withColumn("stopped", F.col("_ratio") <= F.col("_level"))
    level = F.min(F.when(~F.col("stopped"), F.struct("_ratio", "_level"))).over(all_rows)["_level"]
    return d.withColumn("target", F.when(F.col("stopped"), most * F.col("source_size")).otherwise(F.col("weight") * level).cast("double")).drop("_ratio", "_level")


def rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / mean, F.lit(math.log(most) + 1))))


def balance(sizes: DataFrame, state: DataFrame, most: float, tolerance: float = 1e-9, steps: int = 80) -> DataFrame:
    """Lambda of each source of ``state`` (source, source_size, source_rows, least, target, stopped).

    The tilt's words rise with lambda; since x * exp(lambda x) lies between
    the values for the least and the largest x, log(target / words) / least x
    bounds lambda on one side and 0 on the other.  A Newton step that leaves
    the bracket is replaced by its middle, so every step narrows it.
    """
    d = state.withColumn("mean", F.col("source_size") / F.col("source_rows")).withColumn("bound", F.log(F.col("target") / F.col("source_size")) / (F.col("least") / F.col("mean")))
    d = d.withColumns({"lam": F.lit(0.0), "lo": F.least("bound", F.lit(0.0)), "hi": F.greatest("bound", F.lit(0.0)), "done": F.coalesce(F.col("stopped") | (F.col("source_size") == 0), F.lit(True))})
    d = stored(d)
    key = F.struct("source")  # a null source meets itself
    hist = sizes.where(F.col("size") > 0)
    for _ in range(steps):
        open_ = d.where(~F.col("done")).select(key.alias("k"), "lam", "mean")
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        moved = F.when(r < most, r * F.col("size") / F.col("mean")).otherwise(0.0)
        words = F.col("size") * F.col("rows")
        sums = hist.join(open_, F.struct(hist["source"]).eqNullSafe(F.col("k"))).groupBy("k").agg(F.sum((words * r).cast(EXACT)).alias("f"), F.sum((words * moved).cast(EXACT)).alias("slope"))
        d = d.join(sums, F.struct(d["source"]).eqNullSafe(F.col("k")), "left").drop("k")
        gap = F.col("f").cast("double") - F.col("target")
        near = F.abs(gap) <= tolerance * F.col("target")
        d = d.withColumns({"lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - gap / F.col("slope").cast("double")
        tight = F.col("hi") - F.col("lo") <= 1e-14 * F.greatest(F.abs("hi"), F.abs("lo"), F.lit(1e-6))
        new = F.when((F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        d = stored(d.withColumns({"lam": F.when(F.col("done") | near | tight, F.col("lam")).otherwise(new), "done": F.col("done") | F.coalesce(near | tight, F.lit(False))}).drop("f", "slope"))
        if d.where(~F.col("done")).isEmpty():
            break
    return d


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row: size in words, null texts 0."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def _rated(d: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Adds a source's plan, and each row's rate, whole copies and turn for one more."""
    keyed = plan.withColumnRenamed("source", "k")
    d = d.join(keyed, d["source"].eqNullSafe(keyed["k"])).drop("k")
    r = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("stopped"), F.lit(float(most))).otherwise(rate(F.col("lam"), F.col("size"), F.col("mean"), most))
    d = d.withColumn("rate", r).withColumn("whole", F.floor("rate")).withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("copy"), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return d.withColumn("turn", F.when(F.col("part") > 0, u / F.col("part")))


def fit(sizes: DataFrame, weights: list[float] = (5, 2, 1), most: float = 3.0, per_block: int = 1_000) -> DataFrame:
    """One row a source: all that ``apply`` needs to give every document its copies.

    ``sizes``: (doc_id, source, size), read several times.  Rounding: a
    document takes floor(rate) copies, and one more if its turn, a hash over
    the fraction f (so that the chance is f), comes up to the source's limit.
    The limit is where the source's words meet its target: turns are cut into
    buckets of about ``per_block`` rows, whose words are added up first, and
    only the bucket where the target falls is sorted.  One document (``best``)
    then takes a copy more or less if that brings the source nearer.
    """
    hist = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    plan = balance(hist, targets(sources, list(weights), most), most).select("source", "source_size", "source_rows", "target", "stopped", "lam", "mean")
    blocks = F.greatest(F.lit(16), F.ceil(F.col("source_rows") / per_block))
    d = _rated(sizes, plan, most).withColumn("bucket", F.floor(F.least(F.col("turn"), F.lit(4.0)) * blocks)).withColumn("blocks", blocks)
    sums = d.groupBy("source", "bucket").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("size") * F.col("whole")).alias("fixed"), F.first("target").alias("target"), F.first("blocks").alias("blocks"))
    whole = Window.partitionBy("source")
    w = whole.orderBy(F.col("bucket").asc_nulls_first())
    sums = sums.withColumn("need", F.first("target").over(whole) - F.sum("fixed").over(whole)).withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the first bucket that does not fit whole; where all fit, no limit
    cut = stored(sums.where(F.col("bucket").isNotNull() & (F.col("before") + F.col("words") > F.col("need"))).groupBy("source").agg(F.min(F.struct("bucket", "before", "need", "blocks")).alias("c")).select(F.col("source").alias("k"), F.col("c.bucket").alias("at"), "c.before", "c.need", F.col("c.blocks").alias("per")))
    inner = Window.partitionBy("source").orderBy("turn")  # equal turns together
    edge = d.join(cut, d["source"].eqNullSafe(cut["k"]) & (d["bucket"] == cut["at"])).withColumn("run", F.sum("size").over(inner) + F.col("before"))
    # one more copy while it brings the source nearer to its target
    edge = edge.where(F.col("run") - F.col("size") / 2 <= F.col("need")).groupBy("source").agg(F.max("turn").alias("last")).withColumnRenamed("source", "k2")
    limits = cut.join(edge, cut["k"].eqNullSafe(edge["k2"]), "left").select("k", F.coalesce("last", F.col("at") / F.col("per") - 1e-15).alias("limit"))
    plan = plan.join(limits, plan["source"].eqNullSafe(limits["k"]), "left").drop("k").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    plan = stored(plan.withColumns({"best_id": F.lit(None).cast(sizes.schema["doc_id"].dataType), "best_size": F.lit(None).cast("long"), "step": F.lit(0).cast("long")}))
    # what is still missing, and the document of the nearest size that can take or give a copy
    d = apply(sizes, plan, most)
    gaps = d.groupBy("source").agg((F.first("target") - F.sum("taken")).alias("gap")).withColumnRenamed("source", "k")
    d = d.join(gaps, d["source"].eqNullSafe(gaps["k"]))
    can = F.when(F.col("gap") > 0, F.col("copies") + 1 <= most).otherwise(F.col("copies") >= 1) & (F.col("size") > 0)
    off = F.abs(F.abs("gap") - F.col("size"))
    best = d.where(can & (off < F.abs("gap")) & F.col("doc_id").isNotNull()).groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id", "size", F.signum("gap").cast("long").alias("step"))).alias("b")).select(F.col("source").alias("k"), F.col("b.doc_id").alias("best_id"), F.col("b.size").alias("best_size"), "b.step")
    plan = plan.drop("best_id", "best_size", "step")
    plan = plan.join(best, plan["source"].eqNullSafe(best["k"]), "left").drop("k")
    return stored(plan.withColumn("step", F.coalesce("step", F.lit(0).cast("long"))))


def apply(sizes: DataFrame, plan: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds source_size, target, rate, copies and taken to rows with doc_id, source and size.

    A row's copies depend on these three and the plan alone, so rows that
    agree in them are treated alike, and any columns may come along.
    """
    d = _rated(sizes, plan, most)
    copies = F.col("whole") + F.coalesce(F.col("turn") <= F.col("limit"), F.lit(False)).cast("long")
    chosen = F.coalesce((F.col("doc_id") == F.col("best_id")) & (F.col("size") == F.col("best_size")), F.lit(False))
    d = d.withColumn("copies", F.least(F.lit(int(most)), F.greatest(F.lit(0), copies + F.when(chosen, F.col("step")).otherwise(0))))
    d = d.withColumn("taken", F.col("copies") * F.col("size"))
    return d.select(*sizes.columns, "source_size", "target", "rate", "copies", "taken")


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of each document.

    Null texts have size 0; size-0 documents get one copy unless rates say
    otherwise, and count nothing.  A null source is a source of its own.  Rows
    repeated in doc_id, source and size get equal copies.  An empty table gives
    an empty result.  Reruns agree: sums are exact decimals, and turns are
    hashes of the ids.
    """
    d = stored(sized(docs))
    return apply(d, fit(d, weights, most), most)
