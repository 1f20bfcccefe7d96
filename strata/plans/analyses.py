"""Cross-source analyses (survey I01-I34).

Every analysis is a composition of aggregates and joins over marts; no
series is collected to the driver.  Year series have one row per year, so
the joins between them are small; the aggregates that build them are
combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a year is settled when its reporter count reaches 90 % of the maximum.
SETTLED_SHARE = 0.9


def settled_year(df: DataFrame, year: str, reporter: str, share: float = SETTLED_SHARE) -> DataFrame:
    """The last year whose distinct-reporter count is >= share x max."""
    counts = df.groupBy(year).agg(F.count_distinct(reporter).alias("n_reporters"))
    mx = counts.agg(F.max("n_reporters").alias("max_reporters"))
    return counts.crossJoin(F.broadcast(mx)).filter(
        F.col("n_reporters") >= F.lit(share) * F.col("max_reporters")
    ).agg(F.max(year).alias("settled_year"), F.max("max_reporters").alias("max_reporters"))


def market_share(country: DataFrame, world: DataFrame, settled: DataFrame, year: str, value: str) -> DataFrame:
    """Country / world in percent on common years (inner join) up to the settled
    year; 0 when world is 0."""
    j = country.select(year, F.col(value).alias("country_value")).join(
        world.select(year, F.col(value).alias("world_value")), year, "inner"
    ).crossJoin(F.broadcast(settled.select("settled_year")))
    j = j.filter(F.col(year) <= F.col("settled_year")).drop("settled_year")
    return j.withColumn(
        "share", F.when(F.col("world_value") == 0, F.lit(0.0)).otherwise(F.col("country_value") / F.col("world_value") * 100)
    )


def family_set(df: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """The set of unit families per key and whether it is a single family."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(family)).alias("families")).withColumn(
        "single_family", F.size("families") == 1
    )


def full_outer_zero(a: DataFrame, b: DataFrame, keys: Sequence[str], a_val: str, b_val: str) -> DataFrame:
    """Union of keys from both sides, missing side filled with 0."""
    return a.join(b, list(keys), "full_outer").select(
        *keys, F.coalesce(F.col(a_val), F.lit(0.0)).alias(a_val), F.coalesce(F.col(b_val), F.lit(0.0)).alias(b_val)
    )


def discrepancy_pct(a: Column, b: Column) -> Column:
    """|a - b| / mean(a, b) x 100; a zero mean counts as 1."""
    mean = (a + b) / F.lit(2.0)
    return F.abs(a - b) / F.when(mean == 0, F.lit(1.0)).otherwise(mean) * F.lit(100.0)


def export_coefficient(produced: DataFrame, exported: DataFrame, key: str, year: str) -> DataFrame:
    """Exported / produced x 100 in one frame of (scope, key, year, produced, exported, coefficient).

    ``produced`` and ``exported`` hold one row per (key, year).  Scope ``year``: each
    year both sides have.  Scope ``state``: per key (either side's), both sides summed
    from the first to the last common year.  Scope ``national``: the sum of the keys.
    A coefficient over nothing produced is 0; without common years there are no rows.
    """
    yearly = produced.groupBy(year).agg(F.sum("produced").alias("produced")).join(
        exported.groupBy(year).agg(F.sum("exported").alias("exported")), year)
    window = yearly.agg(F.min(year).alias("_y0"), F.max(year).alias("_y1"))

    def within(df: DataFrame, value: str) -> DataFrame:
        d = df.crossJoin(F.broadcast(window)).filter(F.col(year).between(F.col("_y0"), F.col("_y1")))
        return d.groupBy(key).agg(F.sum(value).alias(value))

    by_key = full_outer_zero(within(produced, "produced"), within(exported, "exported"), [key], "produced", "exported")
    national = by_key.agg(F.sum("produced").alias("produced"), F.sum("exported").alias("exported")).filter("produced IS NOT NULL")
    no_key, no_year = (F.lit(None).cast(produced.schema[c].dataType).alias(c) for c in (key, year))
    out = yearly.select(F.lit("year").alias("scope"), no_key, year, "produced", "exported").unionByName(
        by_key.select(F.lit("state").alias("scope"), key, no_year, "produced", "exported")).unionByName(
        national.select(F.lit("national").alias("scope"), no_key, no_year, "produced", "exported"))
    return out.withColumn("coefficient", F.when(F.col("produced") == 0, F.lit(0.0)).otherwise(F.col("exported") / F.col("produced") * 100))


def level_series(df: DataFrame, year: str, level: str, value: str, weight: str) -> DataFrame:
    """Value, weight and unit price per (year, level)."""
    return df.groupBy(year, level).agg(
        F.sum(value).alias("value"), F.sum(weight).alias("weight"),
    ).withColumn("unit_price", F.try_divide(F.col("value"), F.col("weight")))


def processing_premium(levels: DataFrame, year: str, level: str, rank: Mapping[str, int]) -> DataFrame:
    """I16: at the last year, price of the most processed level over that of the
    least processed, among levels priced above 0; 0 with fewer than two of them."""
    rk = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    ranked = levels.withColumn("_rank", rk[F.col(level)]).filter(F.col("_rank").isNotNull())
    last = ranked.agg(F.max(year).alias("_y"))
    p = ranked.join(F.broadcast(last), F.col(year) == F.col("_y")).drop("_y")
    at = F.when(F.col("unit_price") > 0, F.col("_rank"))
    return p.groupBy(year).agg(
        F.max_by(level, at).alias("top_level"),
        F.min_by(level, at).alias("base_level"),
        F.when(F.count(at) >= 2, F.try_divide(F.max_by("unit_price", at), F.min_by("unit_price", at))).otherwise(F.lit(0.0)).alias("premium"),
    )


def predominant(levels: DataFrame, year: str, level: str, value: str = "value") -> DataFrame:
    """The level with the largest value and its share in percent per year (ties to
    the larger name; a zero total counts as 1)."""
    return levels.groupBy(year).agg(
        F.max_by(level, F.struct(F.col(value), F.col(level))).alias("level"),
        F.max(value).alias("_top"),
        F.sum(value).alias("_tot"),
    ).select(year, "level", (F.col("_top") / F.when(F.col("_tot") == 0, F.lit(1)).otherwise(F.col("_tot")) * 100).alias("share"))


def pivot_zero(df: DataFrame, row: str, col: str, value: str, values: Sequence[str]) -> DataFrame:
    """Rows x fixed column values, summed, zero-filled."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.sum(value)).na.fill(0, subset=list(values))


def month_matrix(df: DataFrame, year: str, month: str, value: str) -> DataFrame:
    """Year x 12 months, summed; months without rows are 0."""
    cols = [f"m{m:02d}" for m in range(1, 13)]
    return df.groupBy(year).pivot(month, list(range(1, 13))).agg(F.sum(value)).toDF(year, *cols).na.fill(0, subset=cols)


def month_profile(df: DataFrame, year: str, month: str, value: str) -> DataFrame:
    """Each calendar month's mean over the years that have it (a month none has: 0),
    with the profile's first highest and lowest month and the ratio of the two (a lowest
    mean of 0 counts as 1).  Always 12 rows."""
    monthly = df.groupBy(year, month).agg(F.sum(value).alias("_v")).groupBy(month).agg(F.avg("_v").alias("_mean"))
    spine = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias(month))
    p = spine.join(monthly, month, "left").select(month, F.coalesce("_mean", F.lit(0.0)).alias("mean_value"))
    low = F.min("mean_value")
    stats = p.agg(
        F.max_by(month, F.struct(F.col("mean_value"), -F.col(month))).alias("peak_month"),
        F.min_by(month, F.struct(F.col("mean_value"), F.col(month))).alias("trough_month"),
        (F.max("mean_value") / F.when(low == 0, F.lit(1.0)).otherwise(low)).alias("amplitude"),
    )
    return p.crossJoin(F.broadcast(stats))


def region_rollup(values: DataFrame, hierarchy: DataFrame, key: str, region: str, value: str) -> DataFrame:
    """State values summed to regions; empty regions dropped."""
    return values.join(hierarchy, key).groupBy(region).agg(F.sum(value).alias(value)).filter(F.col(value).isNotNull())


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value over the group total (aggregate joined back, so a big
    group is summed map-side rather than buffered by a window)."""
    if keys:
        tot = df.groupBy(*keys).agg(F.sum(value).alias("_tot"))
        j = df.join(tot, list(keys))
    else:
        j = df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("_tot"))))
    return j.withColumn(out, F.try_divide(F.col(value), F.col("_tot"))).drop("_tot")


def snapshot_bundle(mart: DataFrame, year: str, product: str, state: str, value: str, family: str, qty: str,
                    flag: str | None = None) -> dict[str, DataFrame]:
    """The read bundle of one filter set over one (already filtered) mart:
    products, product series, yearly overview, by state, state x year and the
    quality forms.  The mart is persisted for the bundle so the reads share
    one scan; the caller unpersists it when the bundle is consumed."""
    from strata.operators.rollup import family_sums

    m = mart.persist()
    out = {
        "products": m.groupBy(product).agg(F.sum(value).alias("value")),
        "product_series": m.groupBy(product, year).agg(F.sum(value).alias("value"), F.sum(qty).alias("qty")),
        "overview": m.groupBy(year).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n_rows")),
        "by_state": m.groupBy(state).agg(F.sum(value).alias("value"), *family_sums(family, qty)),
        "state_year": m.groupBy(state, year).agg(F.sum(value).alias("value")),
    }
    if flag:
        out["quality_by_year"] = m.groupBy(year, flag).agg(F.count(F.lit(1)).alias("n_rows"))
        out["quality_by_product"] = m.groupBy(product, flag).agg(F.count(F.lit(1)).alias("n_rows"))
        out["quality_total"] = m.groupBy(flag).agg(F.count(F.lit(1)).alias("n_rows"))
    return out


def metadata_with_overrides(meta: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Source metadata where a non-null operator override wins per field."""
    o = overrides.select(key, *[F.col(f).alias(f"_ov_{f}") for f in fields])
    j = meta.join(o, key, "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(F.col(f"_ov_{f}"), F.col(f)))
    return j.drop(*[f"_ov_{f}" for f in fields])


def build_crosswalk(codes: Mapping[str, DataFrame], catalog: DataFrame, code_col: str = "code",
                    group_col: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """The (source, code) -> group bridge.

    Distinct codes per source are tagged and unioned, inner-joined to the
    catalogue (source, code, group), and checked: a code may belong to at
    most one group (returns (crosswalk, violations))."""
    tagged = None
    for src, df in codes.items():
        t = df.select(F.col(code_col).alias("code")).distinct().withColumn("source", F.lit(src))
        tagged = t if tagged is None else tagged.unionByName(t)
    cw = tagged.join(catalog.select("source", F.col(code_col).alias("code"), group_col), ["source", "code"]).distinct()
    dup = cw.groupBy("source", "code").agg(F.count(F.lit(1)).alias("n_groups")).filter(F.col("n_groups") > 1)
    return cw, dup


def inventory(codes: Mapping[str, DataFrame], crosswalk: DataFrame, group_names: DataFrame,
              code_col: str = "code", desc_col: str = "description") -> tuple[DataFrame, DataFrame]:
    """(1) distinct (source, code, description) inventory; (2) counts
    of codes per group and source, pivoted by source, with unlinked codes in
    their own bucket."""
    inv = None
    for src, df in codes.items():
        t = df.select(F.lit(src).alias("source"), F.col(code_col).alias("code"), F.col(desc_col).alias("description")).distinct()
        inv = t if inv is None else inv.unionByName(t)
    linked = inv.join(crosswalk.select("source", "code", "group_id"), ["source", "code"], "left").join(
        group_names.select("group_id", "group_name"), "group_id", "left").withColumn(
        "group_name", F.coalesce("group_name", F.lit("(sem agrupamento)")))
    consolidated = linked.groupBy("group_name").pivot("source", sorted(codes)).agg(F.count(F.lit(1))).na.fill(0)
    return inv, consolidated


def rebuild_reference(published: DataFrame, curated: DataFrame, key: str, name_col: str) -> DataFrame:
    """The published list with curated display names winning where present."""
    c = curated.select(key, F.col(name_col).alias("_curated"))
    return published.join(c, key, "left").withColumn(name_col, F.coalesce("_curated", name_col)).drop("_curated")


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in both (e.g. the common years of two series)."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "inner")


def key_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UNION DISTINCT of keys."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` not in ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")
