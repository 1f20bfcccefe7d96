"""The scalar rules as Spark SQL functions (survey N01, N02).

For SQL users the same rules are registered as SQL functions whose bodies
are SQL expressions (no Python at run time): the analyzer inlines them, so
they compile into the same whole-stage code as the ``Column`` functions.
The bodies are generated from the fixed value lists in ``columns`` so the
Python and SQL forms cannot drift apart (a test pins them together).

N03: like the reference, no user-defined Python functions, aggregates or
table functions run in any plan; everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strata.functions.columns import (
    CRUZADO_FACTOR,
    CRUZADO_UNIT,
    CRUZADO_YEAR,
    DEFAULT_INGESTION,
    DEFAULT_VISIBILITY,
    HIDDEN_VISIBILITY,
    LEGACY_HIDDEN_PROSE,
    LEGACY_VISIBLE_PROSE,
    MISSING_SENTINELS,
    STATES,
    _NUMBER_RE,
)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\\\s+', ''), '\\\\s+$', '')"


def _safe_numeric_body(dash_is_zero: bool) -> str:
    t = _trim("s")
    sentinels = ", ".join(_q(v) for v in MISSING_SENTINELS)
    missing = f"{t} = '' OR {t} IN ({sentinels})" + ("" if dash_is_zero else f" OR {t} = '-'")
    num = f"replace({t}, ',', '.')"
    dash = f"WHEN {t} = '-' THEN 0.0D " if dash_is_zero else ""
    return (f"CASE WHEN {missing} THEN CAST(NULL AS DOUBLE) {dash}"
            f"WHEN {num} RLIKE {_q(_NUMBER_RE)} THEN try_cast({num} AS DOUBLE) END")


def function_ddl() -> list[str]:
    states = " ".join(f"WHEN {_q(a)} THEN {_q(n)}" for a, n, _ in STATES)
    regions = " ".join(f"WHEN {_q(a)} THEN {_q(r)}" for a, _, r in STATES)
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION safe_numeric(s STRING) RETURNS DOUBLE RETURN {_safe_numeric_body(False)}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION safe_numeric_dash_zero(s STRING) RETURNS DOUBLE RETURN {_safe_numeric_body(True)}",
        "CREATE OR REPLACE TEMPORARY FUNCTION safe_divide(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, b)",
        "CREATE OR REPLACE TEMPORARY FUNCTION safe_ln(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x > 0 THEN ln(x) END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION state_name(uf STRING) RETURNS STRING RETURN CASE uf {states} END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION state_region(uf STRING) RETURNS STRING RETURN CASE uf {regions} END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION cruzado_factor(y INT, unit STRING) RETURNS DOUBLE RETURN "
        f"CASE WHEN y = {CRUZADO_YEAR} AND lower({_trim('unit')}) = {_q(CRUZADO_UNIT)} THEN {CRUZADO_FACTOR}D ELSE 1.0D END",
        "CREATE OR REPLACE TEMPORARY FUNCTION data_quality_flag(qty DOUBLE, val DOUBLE, qty_level STRING, val_level STRING) "
        "RETURNS STRING RETURN CASE WHEN qty IS NULL AND val IS NULL THEN 'INCOMPLETE' WHEN val IS NULL THEN 'MISSING_VALUE' "
        "WHEN qty IS NULL THEN 'MISSING_QUANTITY' WHEN val_level = 'problematic' THEN 'PROBLEMATIC_VALUE' "
        "WHEN qty_level = 'problematic' THEN 'PROBLEMATIC_QUANTITY' WHEN val_level = 'outlier' THEN 'OUTLIER_VALUE' "
        "WHEN qty_level = 'outlier' THEN 'OUTLIER_QUANTITY' ELSE 'OK' END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION catalog_visibilidade(vis STRING, ciclo STRING) RETURNS STRING RETURN "
        f"coalesce(vis, CASE ciclo WHEN {_q(LEGACY_HIDDEN_PROSE)} THEN {_q(HIDDEN_VISIBILITY)} "
        f"WHEN {_q(LEGACY_VISIBLE_PROSE)} THEN {_q(DEFAULT_VISIBILITY)} END, {_q(DEFAULT_VISIBILITY)})",
        f"CREATE OR REPLACE TEMPORARY FUNCTION catalog_ingestao(i STRING) RETURNS STRING RETURN coalesce(i, {_q(DEFAULT_INGESTION)})",
    ]


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the scalar rules as temporary SQL functions."""
    names = []
    for ddl in function_ddl():
        spark.sql(ddl)
        names.append(ddl.split("FUNCTION ", 1)[1].split("(", 1)[0])
    return names


def register_read_functions(spark: SparkSession, mart_view: str) -> None:
    """Parameterised reads as SQL table functions over a mart view with
    columns (year, state, product, value, qty)."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION read_overview(y0 INT, y1 INT) "
        f"RETURNS TABLE (year INT, value DOUBLE, n_rows BIGINT) RETURN "
        f"SELECT year, sum(value), count(1) FROM {mart_view} WHERE year BETWEEN y0 AND y1 GROUP BY year")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION read_by_state_latest() "
        f"RETURNS TABLE (state STRING, value DOUBLE) RETURN "
        f"SELECT state, sum(value) FROM {mart_view} WHERE year = (SELECT max(year) FROM {mart_view}) GROUP BY state")
