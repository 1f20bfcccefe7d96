"""Parameterised mart reads (survey H01-H30, B33-B38, C26, F01-F07, A36).

Each read is ``filters -> predicate -> group-by -> order`` over a mart
DataFrame.  Filters are composable ``Column`` predicates (an empty list
means "no predicate"); identifiers are validated against an allow-list and
the DataFrame's columns, and values are always bound as literals, never
interpolated into SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.rollup import family_sums


class InvalidIdentifier(ValueError):
    pass


def check_identifier(df: DataFrame, name: str, allowed: Iterable[str] | None = None) -> str:
    """Reject a column name outside the allow-list or the schema."""
    if allowed is not None and name not in set(allowed):
        raise InvalidIdentifier(f"not allowed: {name!r}")
    if name not in df.columns:
        raise InvalidIdentifier(f"unknown column: {name!r}")
    return name


def resolve_value_column(df: DataFrame, currency: str, correction: str, fallback: str = "val_yearfx_brl") -> str:
    """(currency, correction) -> value column, falling back when absent."""
    name = f"val_{correction}_{currency}".lower()
    return name if name in df.columns else fallback


def year_between(col: str, y0: int | None = None, y1: int | None = None, date_col: str | None = None) -> Column | None:
    """Optional year bounds.

    When the year is derived from a date or timestamp column, pass it as
    ``date_col``: the bounds are then also stated on the raw column, a
    predicate the Parquet scan can push down and use for row-group skipping
    (a predicate on ``year(date)`` cannot be pushed)."""
    c = None
    if y0 is not None:
        c = F.col(col) >= F.lit(y0)
        if date_col:
            c = c & (F.col(date_col) >= F.lit(f"{y0}-01-01 00:00:00").cast("timestamp_ntz"))
    if y1 is not None:
        c2 = F.col(col) <= F.lit(y1)
        if date_col:
            c2 = c2 & (F.col(date_col) < F.lit(f"{y1 + 1}-01-01 00:00:00").cast("timestamp_ntz"))
        c = c2 if c is None else c & c2
    return c


def in_list(col: str, values: Sequence | None) -> Column | None:
    """Optional IN-list; an empty or missing list is no predicate."""
    if not values:
        return None
    return F.col(col).isin(list(values))


def default_flows(col: str, flows: Sequence[str] | None, totals: Sequence[str]) -> Column:
    """When no flow is chosen, only the total flows are read."""
    return F.col(col).isin(list(flows) if flows else list(totals))


def reporter_pin(col: str, mode: str | Sequence, default) -> Column | None:
    """Tri-state reporter filter: 'default' country, 'all', or a list."""
    if mode == "all":
        return None
    if mode == "default":
        return F.col(col) == F.lit(default)
    return in_list(col, mode)


def typed_filter(col: str, op: str, value=None) -> Column:
    """Eq, ne, gt, ge, lt, le, is_null, not_null, contains (case-insensitive)."""
    c = F.col(col)
    ops = {
        "eq": lambda: c == F.lit(value),
        "ne": lambda: c != F.lit(value),
        "gt": lambda: c > F.lit(value),
        "ge": lambda: c >= F.lit(value),
        "lt": lambda: c < F.lit(value),
        "le": lambda: c <= F.lit(value),
        "is_null": lambda: c.isNull(),
        "not_null": lambda: c.isNotNull(),
        "contains": lambda: F.lower(c.cast("string")).contains(F.lower(F.lit(str(value)))),
    }
    if op not in ops:
        raise InvalidIdentifier(f"unknown operator: {op!r}")
    return ops[op]()


def apply(df: DataFrame, *preds: Column | None) -> DataFrame:
    for p in preds:
        if p is not None:
            df = df.filter(p)
    return df


def latest_year_only(df: DataFrame, year_col: str, fact: DataFrame | None = None) -> DataFrame:
    """Keep the latest year present under the same filters.

    The max is a one-row aggregate joined back (broadcast of one row).  ``fact``
    is the filtered fact before its lookup joins, where these keep every row:
    the year is then found in one column of it, and the joins run once."""
    mx = (df if fact is None else fact).agg(F.max(year_col).alias("_latest"))
    return df.join(F.broadcast(mx), F.col(year_col) == F.col("_latest"), "inner").drop("_latest")


def overview(df: DataFrame, year: str, value: str, preds: Sequence[Column | None] = ()) -> DataFrame:
    """Totals per year."""
    return apply(df, *preds).groupBy(year).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n_rows"))


def by_state(df: DataFrame, state: str, year: str, value: str, family: str, qty: str,
             preds: Sequence[Column | None] = (), latest: bool = True, fact: DataFrame | None = None) -> DataFrame:
    """Per state, optionally only the latest year (of ``fact`` under the
    same filters, see ``latest_year_only``), with family sums."""
    d = apply(df, *preds)
    if latest:
        d = latest_year_only(d, year, None if fact is None else apply(fact, *preds))
    return d.groupBy(state).agg(F.sum(value).alias("value"), *family_sums(family, qty))


def by_state_yearly(df: DataFrame, state: str, year: str, value: str, preds: Sequence[Column | None] = ()) -> DataFrame:
    """H03/H15."""
    return apply(df, *preds).groupBy(state, year).agg(F.sum(value).alias("value"))


def ranking(df: DataFrame, key: str, value: str, preds: Sequence[Column | None] = (), k: int = 100) -> DataFrame:
    """Top-k by a measure, descending, key as tie-break.

    The cut is a ``TakeOrderedAndProject`` (per-partition top-k, then a
    merge), and the rank window runs over the k kept rows only."""
    g = apply(df, *preds).groupBy(key).agg(F.sum(value).alias("value"))
    order = [F.col("value").desc_nulls_last(), F.col(key).asc()]
    top = g.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per_key(df: DataFrame, key: str, member: str, value: str, k: int) -> DataFrame:
    """The first ``k`` members of each key by a measure, with rank and
    share of the key's total.  The rank window is limited to k rows a key in
    every task before it is shuffled; totals are an aggregate of their own."""
    g = df.groupBy(key, member).agg(F.sum(value).alias("value"))
    w = Window.partitionBy(key).orderBy(F.col("value").desc_nulls_last(), F.col(member).asc())
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    totals = g.groupBy(key).agg(F.sum("value").alias("_total"), F.count(F.lit(1)).alias("n_members"))
    return top.join(totals, key).withColumn("share", F.try_divide(F.col("value"), F.col("_total"))).drop("_total")


def distinct_per_year(df: DataFrame, year: str, col: str, out: str, preds: Sequence[Column | None] = ()) -> DataFrame:
    """D23/H09/H10."""
    return apply(df, *preds).groupBy(year).agg(F.count_distinct(col).alias(out))


def partner_table(df: DataFrame, partner: str, flow: str, value: str, weight: str, export_flow: str,
                  import_flow: str, rank_by: str = "total", k: int = 30) -> DataFrame:
    """export/import split, total, weight, unit price; ranked by
    the selected key and capped at k partners (the cap is the feature)."""
    g = df.groupBy(partner).agg(
        F.sum(F.when(F.col(flow) == export_flow, F.col(value))).alias("exports"),
        F.sum(F.when(F.col(flow) == import_flow, F.col(value))).alias("imports"),
        F.sum(value).alias("total"),
        F.sum(weight).alias("weight"),
        F.try_divide(F.sum(value), F.sum(weight)).alias("unit_price"),
    )
    keys = {"total": "total", "weight": "weight", "price": "unit_price"}
    if rank_by not in keys:
        raise InvalidIdentifier(f"unknown rank key: {rank_by!r}")
    return g.orderBy(F.col(keys[rank_by]).desc_nulls_last(), F.col(partner).asc()).limit(k)


def flow_links(df: DataFrame, origin: str, dest: str, value: str, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """Top-k origin->destination links and node totals over the kept links."""
    links = df.groupBy(origin, dest).agg(F.sum(value).alias("value")).orderBy(
        F.col("value").desc_nulls_last(), F.col(origin), F.col(dest)
    ).limit(k)
    o = links.groupBy(F.col(origin).alias("node")).agg(F.sum("value").alias("value")).withColumn("side", F.lit("origin"))
    d = links.groupBy(F.col(dest).alias("node")).agg(F.sum("value").alias("value")).withColumn("side", F.lit("destination"))
    return links, o.unionByName(d)


def universes(parts: Mapping[str, DataFrame], code: str) -> DataFrame:
    """Code universes tagged by role."""
    out = None
    for role, df in parts.items():
        u = df.groupBy(code).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("role", F.lit(role))
        out = u if out is None else out.unionByName(u)
    return out


def browse(df: DataFrame, preds: Sequence[Column | None] = (), order: Sequence[str] | None = None,
           offset: int = 0, limit: int = 500) -> DataFrame:
    """A page of rows in a total order; ``limit`` is the page's size."""
    d = apply(df, *preds)
    cols = list(order) if order else d.columns
    return d.orderBy(*[F.col(c).asc_nulls_first() for c in cols]).offset(int(offset)).limit(int(limit))


def browse_count(df: DataFrame, preds: Sequence[Column | None] = ()) -> DataFrame:
    return apply(df, *preds).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------------------
# Registries that map a source or cross-metric to its mart and
# columns.  They are configuration (a handful of rows), resolved on the
# driver into column names; the data work stays in the reads above.
# ---------------------------------------------------------------------------
# Mart, code column, name column and default value column of each source.
SOURCE_REGISTRY: dict[str, tuple[str, str, str, str]] = {
    "ibge_pevs": ("serving_pevs_annual", "product_code", "product_description", "val_real_ipca_brl"),
    "ibge_pam": ("serving_pam_annual", "product_code", "product_description", "val_real_ipca_brl"),
    "ibge_ppm": ("serving_ppm_annual", "product_code", "product_description", "val_real_ipca_brl"),
    "mdic_comex": ("serving_comex_annual", "ncm_code", "ncm_description", "val_yearfx_usd"),
    "un_comtrade": ("serving_comtrade_annual", "cmd_code", "cmd_description", "val_yearfx_usd"),
}

# Mart, measure, flow, code column and the side pinned to the home country of each metric.
CROSS_METRICS: dict[str, tuple[str, str, str, str, str | None]] = {
    "mdic_comex:exp_value": ("serving_comex_annual", "val_yearfx_usd", "export", "ncm_code", None),
    "mdic_comex:imp_value": ("serving_comex_annual", "val_yearfx_usd", "import", "ncm_code", None),
    "mdic_comex:exp_weight": ("serving_comex_annual", "net_weight_kg", "export", "ncm_code", None),
    "un_comtrade:exp_value": ("serving_comtrade_annual", "val_yearfx_usd", "export", "cmd_code", "reporter_iso_a3"),
    "un_comtrade:imp_value": ("serving_comtrade_annual", "val_yearfx_usd", "import", "cmd_code", "reporter_iso_a3"),
    "un_comtrade:partner_exp": ("serving_comtrade_annual", "val_yearfx_usd", "import", "cmd_code", "partner_iso_a3"),
    "un_comtrade:world_exp": ("serving_comtrade_annual", "val_yearfx_usd", "export", "cmd_code", None),
}


def product_source(source: str) -> tuple[str, str, str, str]:
    """Mart, code, name and default value column of a source."""
    if source not in SOURCE_REGISTRY:
        raise InvalidIdentifier(f"unknown source: {source!r}")
    return SOURCE_REGISTRY[source]


def product_totals(marts: Mapping[str, DataFrame], source: str, value: str | None = None) -> DataFrame:
    """H24/H25 through H28: each product of a source with its name, years and value."""
    mart, code, name, default = product_source(source)
    return marts[mart].groupBy(F.col(code).alias("code")).agg(
        F.max(name).alias("name") if name in marts[mart].columns else F.lit(None).cast("string").alias("name"),
        F.count_distinct("reference_year").alias("n_years"), F.sum(value or default).alias("value"))


def cross_series(marts: Mapping[str, DataFrame], metric: str, home: str = "BRA", year_from: int | None = None,
                 year_to: int | None = None, codes: Sequence[str] = (), states: Sequence[str] = ()) -> DataFrame:
    """H27 through H29: one metric by year.  The home country is pinned on the
    metric's side; states narrow only marts that have them."""
    if metric not in CROSS_METRICS:
        raise InvalidIdentifier(f"unknown cross metric: {metric!r}")
    mart, measure, flow, code, pinned = CROSS_METRICS[metric]
    preds = [F.col("flow") == flow, year_between("reference_year", year_from, year_to), in_list(code, list(codes)) if codes else None]
    preds += [F.col(pinned) == home] if pinned else []
    preds += [in_list("state_acronym", list(states))] if states and "state_acronym" in marts[mart].columns else []
    return apply(marts[mart], *preds).groupBy("reference_year").agg(F.sum(measure).alias("value"))


def cross_annual(df: DataFrame, year: str, measure: str, flow_col: str | None = None, flow: str | None = None,
                 preds: Sequence[Column | None] = ()) -> DataFrame:
    """One measure per year under the metric's flow and filters."""
    p = list(preds) + ([F.col(flow_col) == flow] if flow_col and flow else [])
    return apply(df, *p).groupBy(year).agg(F.sum(measure).alias("value"))


def domain_order(col: str, order: Sequence[str]) -> Column:
    """a sort key placing known values in a fixed domain order (unknown last)."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[F.col(col)], F.lit(len(order)))


def code_order(col: str) -> list[Column]:
    """numeric codes in numeric order first, then text codes."""
    return [F.col(col).try_cast("bigint").asc_nulls_last(), F.col(col).asc()]
