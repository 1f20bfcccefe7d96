"""Document fingerprints by winnowing.

Hashes of all runs of ``k`` words are taken; of each window of ``w``
neighbouring hashes the smallest is kept (ties: the rightmost), with its
position.  Two texts that share w + k - 1 consecutive words therefore share a
kept hash.  Built-in array functions only: each step is one pass over the
array, doubling the width that a minimum or a hash covers.

A kept gram is one bigint: 33 bits of hash above 30 bits of (2**30 - 1 -
position), so that the smallest value is the smallest hash, rightmost first.
A Spark string has at most 2**31 bytes, hence fewer than 2**30 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.layout import id_groups, words_of

LAST = (1 << 30) - 1


def _with_later(x: Column, by: int, join) -> Column:
    """join(x[i], x[i + by]) for each i that has both."""
    n = F.size(x) - by
    return F.when(n <= 0, F.slice(x, 1, 0)).otherwise(F.zip_with(F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(x, by + 1, F.greatest(n, F.lit(0))), join))


def widths(total: int) -> list[int]:
    """Offsets that widen a span of 1 to ``total``, doubling while it fits."""
    out, span = [], 1
    while span < total:
        step = min(span, total - span)
        out.append(step)
        span += step
    return out


def add_grams(d: DataFrame, text: str, out: str, k: int) -> DataFrame:
    """Adds the packed (hash, position) of each run of k words; fewer words: the whole as one run."""
    d = d.withColumn(out, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    wide, span, parts = F.col(out), 1, None
    short = F.when(F.size(out) == 0, F.slice(F.col(out), 1, 0)).otherwise(F.array(F.xxhash64(F.lit("short"), F.col(out))))
    d = d.withColumn("_short", F.when(F.size(out) < k, short))
    for step in widths(k):
        # the hash of a longer run comes from the two runs that cover it
        d = d.withColumn(out, _with_later(F.col(out), step, lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn(out, F.coalesce(F.col("_short"), F.col(out))).drop("_short")
    return d.withColumn(out, F.transform(out, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), 30) + (F.lit(LAST) - i)))


def winnow(d: DataFrame, text: str, out: str, k: int = 5, w: int = 8) -> DataFrame:
    """Adds the kept grams of a text, in reading order.

    Fewer than w grams: one window over all.  No words or null: none.
    """
    d = add_grams(d, text, out, k)
    d = d.withColumn("_short", F.when(F.size(out) < w, F.filter(F.array(F.array_min(out)), lambda x: x.isNotNull())))
    for step in widths(w):
        d = d.withColumn(out, _with_later(F.col(out), step, lambda a, b: F.least(a, b)))
    return d.withColumn(out, F.array_distinct(F.coalesce(F.col("_short"), F.col(out)))).drop("_short")


def hashes(kept: Column) -> Column:
    """The distinct hashes of kept grams."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 30)))


def marks(kept: Column) -> Column:
    """(hash, position) of each kept gram, positions in words from 0."""
    return F.transform(kept, lambda x: F.struct(F.shiftright(x, 30).alias("hash"), (F.lit(LAST) - F.pmod(x, F.lit(1 << 30))).cast("int").alias("position")))


def digest(kept: Column) -> Column:
    """One string of a whole fingerprint, hashes and positions."""
    return F.md5(F.concat_ws(",", F.transform(kept, lambda x: x.cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty sets, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def compare_with_next(docs: DataFrame, k: int = 5, w: int = 8, per_group_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likenesses.

    The edited text has the last floor(n/2) of its n code points replaced by
    the first as many (or all) of the next document in descending doc_id, the
    first document after the last.  Documents are dealt out by ranges of
    doc_id and sorted within; the one document a range needs of the range
    below comes from a table of one row a range.  Equal ids: by text, largest
    first; null ids: before all others.  Null texts are empty.  A single
    document is its own next.
    """
    group, _ = id_groups(docs, per_group_bytes)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("g", group)
    order = [F.col("doc_id").desc_nulls_first(), F.col("text").desc()]
    first = F.max(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text"))
    heads = d.groupBy("g").agg(first.alias("head"))
    low = F.max("g").over(Window.orderBy(F.col("g")).rowsBetween(Window.unboundedPreceding, -1))
    top = F.max("g").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = heads.select("g").withColumn("below", F.coalesce(low, top))
    heads = winnow(heads.select(F.col("g").alias("below"), F.col("head.text").alias("head_text")), "head_text", "head_kept", k, w)
    heads = links.join(heads, "below").select("g", "head_text", hashes(F.col("head_kept")).alias("head_hashes"))
    w_ = Window.partitionBy("g").orderBy(*order)
    d = d.withColumn("next_text", F.lead("text").over(w_))
    d = winnow(d, "text", "kept", k, w).withColumn("hashes", hashes(F.col("kept")))
    d = d.withColumn("next_hashes", F.lead("hashes").over(w_)).join(heads, "g")
    d = d.withColumns({"next_text": F.coalesce("next_text", "head_text"), "next_hashes": F.coalesce("next_hashes", "head_hashes"), "n_chars": F.length("text").cast("long")}).drop("head_text", "head_hashes", "g")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))).drop("text", "next_text")
    d = winnow(d, "edited", "edited_kept", k, w)
    return d.withColumns({"near_edited": likeness(F.col("hashes"), hashes(F.col("edited_kept"))), "near_next": likeness(F.col("hashes"), F.col("next_hashes"))}).drop("hashes", "next_hashes")
