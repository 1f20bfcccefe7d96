"""DuckDB SQL twins of ``strata.plans.twins`` (the correctness oracle).

Tables are the driver's views (lineitem, orders, ...).  Every computed
column is aliased and cast to the Spark result type, and doubles are
rounded exactly as the Spark query rounds them.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Shared CTE blocks ---------------------------------------------------------

INDEX_CTES = """
monthly AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN '433' WHEN 'O' THEN '189' WHEN 'P' THEN '190' END AS series_code,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_date,
         avg(floor(o_totalprice)) AS mean_price
  FROM orders GROUP BY 1, 2
),
pct AS (
  SELECT *, 100.0::DOUBLE * (mean_price / NULLIF(lag(mean_price) OVER (PARTITION BY series_code ORDER BY reference_date), 0) - 1.0::DOUBLE) AS monthly_pct_change
  FROM monthly
),
idx AS (
  SELECT series_code, reference_date,
         CAST(year(reference_date) AS INTEGER) AS reference_year,
         CAST(month(reference_date) AS INTEGER) AS reference_month,
         monthly_pct_change,
         100.0::DOUBLE * exp(sum(CASE WHEN 1.0::DOUBLE + monthly_pct_change / 100.0::DOUBLE > 0
                                      THEN ln(1.0::DOUBLE + monthly_pct_change / 100.0::DOUBLE) END)
             OVER (PARTITION BY series_code ORDER BY reference_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS index_value
  FROM pct WHERE monthly_pct_change IS NOT NULL
)"""

FX_CTES = """
fx AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' END AS currency,
         CAST(o_orderdate AS DATE) AS reference_date,
         max(floor(o_totalprice / 1000.0::DOUBLE)) AS brl_per_foreign_unit
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2
)"""

DEFLATION_CTES = """
year_end AS (
  SELECT reference_year,
         max(CASE WHEN series_code = '433' THEN v END) AS ipca_year_end,
         max(CASE WHEN series_code = '189' THEN v END) AS igpm_year_end,
         max(CASE WHEN series_code = '190' THEN v END) AS igpdi_year_end
  FROM (SELECT reference_year, series_code, arg_max(index_value, reference_month) AS v
        FROM idx WHERE index_value IS NOT NULL GROUP BY 1, 2) GROUP BY 1
),
latest AS (
  SELECT max(CASE WHEN series_code = '433' THEN v END) AS ipca_current,
         max(CASE WHEN series_code = '189' THEN v END) AS igpm_current,
         max(CASE WHEN series_code = '190' THEN v END) AS igpdi_current
  FROM (SELECT series_code, arg_max(index_value, reference_date) AS v
        FROM idx WHERE index_value IS NOT NULL GROUP BY 1)
),
fx_year AS (
  SELECT CAST(year(reference_date) AS INTEGER) AS reference_year,
         avg(CASE WHEN currency = 'USD' THEN brl_per_foreign_unit END) AS brl_per_usd_avg,
         avg(CASE WHEN currency = 'EUR' AND year(reference_date) >= 1999 THEN brl_per_foreign_unit END) AS brl_per_eur_avg
  FROM fx
  WHERE brl_per_foreign_unit IS NOT NULL AND (year(reference_date) <> 1994 OR reference_date >= DATE '1994-07-01')
  GROUP BY 1
),
fx_last AS (
  SELECT max(CASE WHEN currency = 'USD' THEN r END) AS brl_per_usd_current,
         max(CASE WHEN currency = 'EUR' THEN r END) AS brl_per_eur_current
  FROM (SELECT currency, arg_max(brl_per_foreign_unit, reference_date) AS r FROM fx
        WHERE brl_per_foreign_unit IS NOT NULL GROUP BY 1)
)"""


def value_matrix_sql(v: str = "val_raw", year: str = "reference_year", rounded: bool = True) -> str:
    """The 12 value columns of ``strata.operators.deflate.deflate``."""
    rnd = (lambda e: f"round({e}, 2)") if rounded else (lambda e: e)
    cols = [f"{rnd(v)} AS val_yearfx_brl"]
    for cur in ("usd", "eur"):
        cols.append(f"{rnd(f'CASE WHEN {year} >= 1994 THEN {v} / NULLIF(brl_per_{cur}_avg, 0) END')} AS val_yearfx_{cur}")
    for d in ("ipca", "igpm", "igpdi"):
        real = f"({v} * ({d}_current / NULLIF({d}_year_end, 0)))"
        cols.append(f"{rnd(real)} AS val_real_{d}_brl")
        for cur in ("usd", "eur"):
            cols.append(f"{rnd(f'{real} / NULLIF(brl_per_{cur}_current, 0)')} AS val_real_{d}_{cur}")
    return ",\n       ".join(cols)


REVENUE_CENTS = "round(l_extendedprice * (1.0::DOUBLE - l_discount) * 100.0::DOUBLE)"

ORACLE["deflated_revenue_by_nation_year"] = f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
per_order AS (
  SELECT l_orderkey, CAST(year(l_shipdate) AS INTEGER) AS reference_year, sum({REVENUE_CENTS}) AS cents
  FROM lineitem GROUP BY 1, 2
),
fact AS (
  SELECT c.c_nationkey, p.reference_year, sum(p.cents) / 100.0::DOUBLE AS val_raw
  FROM per_order p JOIN orders o ON p.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2
)
SELECT n.n_name AS nation, f.reference_year,
       {value_matrix_sql()}
FROM fact f JOIN nation n ON f.c_nationkey = n.n_nationkey
LEFT JOIN fx_year USING (reference_year)
LEFT JOIN year_end USING (reference_year)
CROSS JOIN latest CROSS JOIN fx_last
"""


# --- parsing, dedup, edit logs, series --------------------------------------

_NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _safe_numeric_sql(c: str, dash_is_zero: bool) -> str:
    t = f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
    s = f"replace({t}, ',', '.')"
    missing = f"{t} = '' OR {t} IN ('...', '..', '*', 'X')" + ("" if dash_is_zero else f" OR {t} = '-'")
    dash = f"WHEN {t} = '-' THEN 0.0::DOUBLE " if dash_is_zero else ""
    return (f"CASE WHEN {missing} THEN NULL {dash}"
            f"WHEN regexp_full_match({s}, '{_NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END")


ORACLE["safe_numeric_sentinels"] = f"""
WITH d AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_linenumber WHEN 1 THEN '...' WHEN 2 THEN '-'
              WHEN 3 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5 '
              WHEN 4 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'd'
              WHEN 5 THEN '' WHEN 6 THEN 'X'
              ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS raw,
         l_discount, l_tax
  FROM lineitem)
SELECT l_orderkey, l_linenumber, raw,
       {_safe_numeric_sql('raw', False)} AS num,
       {_safe_numeric_sql('raw', True)} AS num_dash_zero,
       NULLIF(l_discount, 0) AS discount_or_null,
       NULLIF(l_tax, 0) AS tax_or_null
FROM d
"""

ORACLE["safe_date_parse"] = """
WITH d AS (
  SELECT o_orderkey,
         CASE o_orderkey % 4 WHEN 1 THEN '31/02/' || CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN 'n/a'
              ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_str,
         CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderkey % 14 AS INTEGER) AS m
  FROM orders),
p AS (SELECT *, CAST(try_strptime(date_str, '%d/%m/%Y') AS DATE) AS parsed FROM d)
SELECT o_orderkey, date_str, parsed,
       CASE WHEN m BETWEEN 1 AND 12 THEN make_date(y, m, 1) END AS from_parts,
       make_date(y, 12, 31) AS year_end,
       CAST(year(parsed) AS INTEGER) AS reference_year,
       CAST(month(parsed) AS INTEGER) AS reference_month,
       CAST(quarter(parsed) AS INTEGER) AS quarter,
       CASE WHEN month(parsed) <= 6 THEN 1 ELSE 2 END AS semester,
       last_day(parsed) AS month_end_date,
       strftime(parsed, '%Y-%m') AS year_month,
       month(parsed) = 12 AS is_year_end,
       ['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro'][month(parsed)] AS month_name_pt
FROM p WHERE parsed IS NOT NULL
"""

ORACLE["latest_wins"] = """
SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
"""

ORACLE["latest_batch"] = """
WITH e AS (SELECT *, CAST(ts AS DATE) AS batch_date FROM events)
SELECT * FROM e QUALIFY batch_date = max(batch_date) OVER (PARTITION BY event_type)
"""

ORACLE["two_stage_dedup"] = """
WITH e AS (SELECT *, CAST(ts AS DATE) AS batch_date, CAST(hour(ts) AS INTEGER) AS batch_hour FROM events),
b AS (SELECT * FROM e QUALIFY batch_hour = max(batch_hour) OVER (PARTITION BY event_type, batch_date))
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
"""

TIMELINE_CTE = """
tl AS (
  SELECT user_id, event_id, event_type,
         CAST(row_number() OVER w AS INTEGER) AS version,
         ts AS valid_from,
         lead(ts) OVER w AS valid_to
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""

ORACLE["scd2_timeline"] = f"WITH {TIMELINE_CTE} SELECT *, valid_to IS NULL AS is_current FROM tl"
ORACLE["scd2_current"] = f"WITH {TIMELINE_CTE} SELECT *, valid_to IS NULL AS is_current FROM tl WHERE valid_to IS NULL"
ORACLE["scd2_cleared"] = f"WITH {TIMELINE_CTE} SELECT *, valid_to IS NULL AS is_current FROM tl WHERE event_type <> 'error'"

LOG_CTE = """
log AS (
  SELECT *, event_type <> 'error' AS active,
         CASE WHEN event_type = 'view' THEN 'oculto' WHEN event_type = 'click' THEN 'visivel' END AS visibilidade,
         CASE WHEN value > 90 THEN 'Fazer Ingestão mas deixar indisponível'
              WHEN value < 10 THEN 'Fazer Ingestão e deixar disponível' END AS ciclo_de_vida,
         CASE WHEN event_type <> 'error' THEN event_type END AS group_name
  FROM events
),
cur AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
hidden AS (
  SELECT user_id FROM cur
  WHERE active AND coalesce(visibilidade,
        CASE ciclo_de_vida WHEN 'Fazer Ingestão mas deixar indisponível' THEN 'oculto'
                           WHEN 'Fazer Ingestão e deixar disponível' THEN 'visivel' END, 'visivel') = 'oculto'
)"""

ORACLE["catalog_current"] = f"WITH {LOG_CTE} SELECT user_id, event_id, event_type, value, ts FROM cur WHERE active"
ORACLE["hidden_registry"] = f"WITH {LOG_CTE} SELECT user_id FROM hidden"
ORACLE["visibility_gate"] = f"""
WITH {LOG_CTE},
li AS (SELECT l_suppkey, l_returnflag, {REVENUE_CENTS} AS cents FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, round(sum(cents) / 100.0::DOUBLE, 2) AS revenue
FROM li WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = li.l_suppkey)
GROUP BY 1
"""
ORACLE["orphans"] = f"""
WITH {LOG_CTE},
lg AS (SELECT user_id, group_name AS last_group_name FROM log WHERE group_name IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c.user_id, c.ts AS removed_at, lg.last_group_name
FROM cur c LEFT JOIN lg ON c.user_id = lg.user_id
WHERE NOT c.active AND c.user_id IN (SELECT o_custkey FROM orders)
"""

ORACLE["idempotent_append"] = """
SELECT event_id % 1000 AS change_id, event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_id % 1000 ORDER BY ts, event_id) = 1
"""
ORACLE["change_id_conflicts"] = """
SELECT event_id % 1000 AS change_id, count(DISTINCT user_id) AS n_keys FROM events
GROUP BY 1 HAVING count(DISTINCT user_id) > 1
"""

ORACLE["chain_index"] = f"""
WITH {INDEX_CTES}
SELECT series_code, reference_date, reference_year, reference_month,
       round(monthly_pct_change, 6) AS monthly_pct_change, round(index_value, 6) AS index_value
FROM idx
"""

ORACLE["month_gaps"] = """
WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_date FROM orders),
l AS (SELECT *, lag(reference_date) OVER (PARTITION BY o_custkey ORDER BY reference_date) AS prev_date FROM m)
SELECT o_custkey, reference_date, prev_date, CAST(date_diff('month', prev_date, reference_date) AS INTEGER) AS gap_months
FROM l WHERE date_diff('month', prev_date, reference_date) > 1
"""

ORACLE["year_end_index"] = f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES}
SELECT reference_year, round(ipca_year_end, 6) AS ipca_year_end, round(igpm_year_end, 6) AS igpm_year_end,
       round(igpdi_year_end, 6) AS igpdi_year_end FROM year_end
"""
ORACLE["latest_index"] = f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES}
SELECT round(ipca_current, 6) AS ipca_current, round(igpm_current, 6) AS igpm_current,
       round(igpdi_current, 6) AS igpdi_current FROM latest
"""
ORACLE["fx_year_average"] = f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES}
SELECT reference_year, round(brl_per_usd_avg, 6) AS brl_per_usd_avg, round(brl_per_eur_avg, 6) AS brl_per_eur_avg FROM fx_year
"""


# --- lookups, harmonisation, roll-ups, quality, marts ------------------------

REV = REVENUE_CENTS
YEAR = "CAST(year(l_shipdate) AS INTEGER)"
MONTH = "CAST(month(l_shipdate) AS INTEGER)"

ORACLE["range_lookup"] = f"""
WITH li AS (SELECT l_linestatus AS unit, {YEAR} AS year, sum({REV}) AS cents, count(*) AS n_rows FROM lineitem GROUP BY 1, 2),
r AS (SELECT * FROM (VALUES ('F', 1995, 1997, 1.5::DOUBLE), ('F', 1998, 2001, 2.0::DOUBLE), ('O', 1995, 1999, 0.5::DOUBLE))
      t(unit_of_measure, year_from, year_to, brl_factor))
SELECT li.unit, li.year, li.n_rows, round(cents / 100.0::DOUBLE, 2) AS val, r.brl_factor,
       round(cents / 100.0::DOUBLE * r.brl_factor, 2) AS val_converted
FROM li LEFT JOIN r ON lower(trim(li.unit)) = lower(trim(r.unit_of_measure)) AND li.year BETWEEN r.year_from AND r.year_to
"""

ORACLE["factor_overlap_check"] = f"""
WITH r AS (SELECT l_linestatus AS unit, l_returnflag AS flow, min({YEAR}) AS lo, max({YEAR}) AS hi FROM lineitem GROUP BY 1, 2),
w AS (SELECT unit AS k, flow AS id, lo, hi,
             max(hi) OVER (PARTITION BY unit ORDER BY lo, hi, flow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max_hi
      FROM r)
SELECT k, id, lo, hi, prev_max_hi, 'range_overlap' AS "check", 'error' AS severity FROM w WHERE lo <= prev_max_hi
"""

ORACLE["unit_harmonise"] = """
WITH li AS (
  SELECT p.p_brand AS product, l.l_quantity AS qty,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'Caixas'
              WHEN l.l_linestatus = 'F' THEN ' Toneladas' ELSE 'quilogramas' END AS unit_raw
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
fam AS (SELECT * FROM (VALUES ('Toneladas', 'massa', 't', 1.0::DOUBLE), ('Quilogramas', 'massa', 't', 0.001::DOUBLE),
                              ('Mil litros', 'volume', 'm³', 1.0::DOUBLE)) t(unit_raw, family, base_unit, to_base)),
ov AS (SELECT * FROM (VALUES ('tpch', 'Brand#13', 'Quilogramas', 'massa', 't', 0.002::DOUBLE))
       t(source, product_code, unit_raw, family, base_unit, to_base)),
h AS (
  SELECT li.product, li.qty, coalesce(ov.family, fam.family, 'desconhecida') AS family,
         coalesce(ov.base_unit, fam.base_unit) AS base_unit, li.qty * coalesce(ov.to_base, fam.to_base) AS qty_base
  FROM li LEFT JOIN fam ON lower(trim(li.unit_raw)) = lower(trim(fam.unit_raw))
          LEFT JOIN ov ON li.product = ov.product_code AND lower(trim(li.unit_raw)) = lower(trim(ov.unit_raw)))
SELECT product, family, base_unit, count(*) AS n_rows, sum(qty) AS qty_native, round(sum(qty_base), 6) AS qty_base
FROM h GROUP BY 1, 2, 3
"""

ORACLE["succession_remap"] = """
SELECT p_partkey, p_brand, coalesce(s.current_code, p_brand) AS current_brand
FROM part LEFT JOIN (VALUES ('Brand#1', 'Brand#10'), ('Brand#2', 'Brand#20'), ('Brand#3', 'Brand#30')) s(reported_code, current_code)
  ON p_brand = s.reported_code
"""

ORACLE["long_to_wide"] = f"""
WITH long AS (
  SELECT {YEAR} AS year, l_suppkey, l_returnflag AS flow, 'qty' AS variable, l_quantity AS v FROM lineitem
  UNION ALL SELECT {YEAR}, l_suppkey, l_returnflag, 'val', {REV} FROM lineitem
  UNION ALL SELECT {YEAR}, l_suppkey, l_returnflag, 'disc', NULLIF(l_discount, 0) FROM lineitem),
agg AS (SELECT year, l_suppkey, flow, variable, sum(v) AS numeric_value FROM long GROUP BY 1, 2, 3, 4),
wide AS (
  SELECT year, l_suppkey, flow,
         max(CASE WHEN variable = 'qty' THEN numeric_value END) AS qty,
         max(CASE WHEN variable = 'val' THEN numeric_value END) AS val,
         max(CASE WHEN variable = 'disc' THEN numeric_value END) AS disc
  FROM agg GROUP BY 1, 2, 3)
SELECT year, l_suppkey, flow, qty, round(val / 100.0::DOUBLE, 2) AS val, round(disc, 6) AS disc
FROM wide WHERE qty IS NOT NULL OR val IS NOT NULL OR disc IS NOT NULL
"""

ORACLE["dominant_unit_rollup"] = f"""
WITH li AS (
  SELECT l_returnflag AS flow, {YEAR} AS year, {MONTH} AS month, l_suppkey, l_linestatus AS unit,
         CASE WHEN l_linestatus = 'F' THEN 'finished' ELSE 'open' END AS unit_name, l_quantity AS qty, {REV} AS cents
  FROM lineitem),
r AS (SELECT *, first_value(unit) OVER (PARTITION BY flow, year, month, l_suppkey ORDER BY qty DESC NULLS LAST, unit) AS dom FROM li)
SELECT flow, year, month, l_suppkey, max(dom) AS unit, max(CASE WHEN unit = dom THEN unit_name END) AS unit_name,
       sum(CASE WHEN unit = dom THEN qty END) AS qty, round(sum(cents) / 100.0::DOUBLE, 2) AS value, count(*) AS source_rows
FROM r GROUP BY 1, 2, 3, 4
"""

ORACLE["implied_price_flags"] = f"""
WITH li AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS flow, p.p_brand AS product, l.l_quantity AS qty,
         {REV} / 100.0::DOUBLE AS value
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
d AS (
  SELECT *, CASE WHEN value / NULLIF(qty, 0) > 0 THEN ln(value / NULLIF(qty, 0)) END AS lp,
         CASE WHEN value > 0 THEN ln(value) END AS lv, CASE WHEN qty > 0 THEN ln(qty) END AS lq
  FROM li),
s AS (
  SELECT flow, product, quantile_cont(lp, 0.5) AS med_price, quantile_cont(lv, 0.5) AS med_val,
         quantile_cont(lv, 0.75) AS p75_val, quantile_cont(lq, 0.5) AS med_qty, quantile_cont(lq, 0.75) AS p75_qty,
         count(value / NULLIF(qty, 0)) AS n
  FROM d GROUP BY 1, 2),
x AS (
  SELECT d.*, abs(lp - med_price) AS dev,
         (lv - med_val) / NULLIF(p75_val - med_val, 0) AS vex,
         (lq - med_qty) / NULLIF(p75_qty - med_qty, 0) AS qex,
         (value IS NULL OR value <= 0 OR qty IS NULL OR qty <= 0 OR med_price IS NULL OR n < 100 OR value < 10000) AS guard
  FROM d JOIN s USING (flow, product)),
lv AS (
  SELECT *,
         CASE WHEN guard THEN NULL WHEN dev >= ln(2.0) AND abs(vex) >= abs(qex) THEN 'problematic'
              WHEN vex >= 1.5 THEN 'outlier' END AS val_level,
         CASE WHEN guard THEN NULL WHEN dev >= ln(2.0) AND abs(qex) > abs(vex) THEN 'problematic'
              WHEN qex >= 1.5 THEN 'outlier' END AS qty_level
  FROM x)
SELECT l_orderkey, l_linenumber, flow, product, val_level, qty_level,
       CASE WHEN qty IS NULL AND value IS NULL THEN 'INCOMPLETE' WHEN value IS NULL THEN 'MISSING_VALUE'
            WHEN qty IS NULL THEN 'MISSING_QUANTITY' WHEN val_level = 'problematic' THEN 'PROBLEMATIC_VALUE'
            WHEN qty_level = 'problematic' THEN 'PROBLEMATIC_QUANTITY' WHEN val_level = 'outlier' THEN 'OUTLIER_VALUE'
            WHEN qty_level = 'outlier' THEN 'OUTLIER_QUANTITY' ELSE 'OK' END AS data_quality_flag
FROM lv
"""


def _flag4(q: str, v: str) -> str:
    return (f"CASE WHEN {q} IS NOT NULL AND {v} IS NOT NULL THEN 'OK' WHEN {q} IS NOT NULL THEN 'MISSING_VALUE' "
            f"WHEN {v} IS NOT NULL THEN 'MISSING_QUANTITY' ELSE 'INCOMPLETE' END")


ORACLE["quality_by_source"] = f"""
WITH f AS (
  SELECT 'lineitem' AS source, {_flag4('q', 'v')} AS data_quality_flag
  FROM (SELECT NULLIF(l_tax, 0) AS q, NULLIF(l_discount, 0) AS v FROM lineitem)
  UNION ALL
  SELECT 'orders', {_flag4('q', 'v')}
  FROM (SELECT NULLIF(o_custkey % 7, 0) AS q, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)),
c AS (SELECT source, data_quality_flag, count(*) AS n_rows FROM f GROUP BY 1, 2)
SELECT *, round(CAST(n_rows AS DOUBLE) / CAST(sum(n_rows) OVER (PARTITION BY source) AS DOUBLE), 6) AS share FROM c
"""

ORACLE["mart_annual"] = f"""
SELECT l_returnflag AS flow, {YEAR} AS year, p.p_brand AS product, s.s_nationkey AS reporter,
       round(sum({REV}) / 100.0::DOUBLE, 2) AS value, sum(l_quantity) AS weight, count(*) AS source_rows,
       count(DISTINCT month(l_shipdate)) AS n_months
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2, 3, 4
"""

ORACLE["mart_seasonality"] = f"""
SELECT l_returnflag AS flow, {YEAR} AS year, {MONTH} AS month, round(sum({REV}) / 100.0::DOUBLE, 2) AS value,
       sum(l_quantity) AS weight, count(*) AS source_rows
FROM lineitem GROUP BY 1, 2, 3
"""

ORACLE["mart_bilateral"] = f"""
SELECT l_returnflag AS flow, {YEAR} AS year, s.s_nationkey AS reporter, c.c_nationkey AS partner,
       round(sum({REV}) / 100.0::DOUBLE, 2) AS value, sum(l_quantity) AS weight, count(*) AS source_rows
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2, 3, 4
"""

ORACLE["source_metadata"] = """
SELECT 'lineitem' AS source, CAST(min(year(l_shipdate)) AS INTEGER) AS min_year, CAST(max(year(l_shipdate)) AS INTEGER) AS max_year,
       count(*) AS n_rows, count(DISTINCT l_partkey) AS n_products, count(DISTINCT l_suppkey) AS n_states, max(l_shipdate) AS last_refresh
FROM lineitem
UNION ALL
SELECT 'orders', CAST(min(year(o_orderdate)) AS INTEGER), CAST(max(year(o_orderdate)) AS INTEGER), count(*),
       count(DISTINCT o_orderpriority), count(DISTINCT o_custkey), max(o_orderdate)
FROM orders
UNION ALL
SELECT 'events', CAST(min(year(ts)) AS INTEGER), CAST(max(year(ts)) AS INTEGER), count(*),
       count(DISTINCT event_type), count(DISTINCT user_id), max(ts)
FROM events
"""


# --- parameterised reads -----------------------------------------------------

GOLD_CTE = f"""
g AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_tax, l.l_returnflag AS flow, l.l_linestatus AS unit, l.l_quantity AS qty,
         {REV} AS value_cents, {YEAR} AS year, {MONTH} AS month, p.p_brand AS product,
         s.s_nationkey AS reporter, n.n_name AS state,
         CASE WHEN l.l_linestatus = 'F' THEN 'massa' ELSE 'volume' END AS family
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""
_PRODUCTS = "('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')"
_STATES = "('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')"
_MONEY = "round(sum(value_cents) / 100.0::DOUBLE, 2)"
_FAMS = ("sum(CASE WHEN family = 'massa' THEN qty END) AS q_mass, sum(CASE WHEN family = 'volume' THEN qty END) AS q_vol, "
         "sum(CASE WHEN family = 'contagem' THEN qty END) AS q_count")

ORACLE["read_overview"] = f"""WITH {GOLD_CTE}
SELECT year, {_MONEY} AS value, count(*) AS n_rows FROM g
WHERE year BETWEEN 1996 AND 2000 AND product IN {_PRODUCTS} GROUP BY 1"""

ORACLE["latest_year_by_nation"] = f"""WITH {GOLD_CTE}, f AS (SELECT * FROM g WHERE flow IN ('A', 'R'))
SELECT state, {_MONEY} AS value, {_FAMS} FROM f WHERE year = (SELECT max(year) FROM f) GROUP BY 1"""

ORACLE["read_state_yearly"] = f"""WITH {GOLD_CTE} SELECT state, year, {_MONEY} AS value FROM g GROUP BY 1, 2"""

ORACLE["read_products_by_state"] = f"""WITH {GOLD_CTE},
r AS (SELECT product, sum(value_cents) AS value FROM g WHERE state IN {_STATES} AND flow IN ('N')
      GROUP BY 1 ORDER BY value DESC NULLS LAST, product LIMIT 100)
SELECT product, round(value / 100.0::DOUBLE, 2) AS value,
       CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, product) AS INTEGER) AS rank FROM r"""

ORACLE["read_seasonality"] = f"""WITH {GOLD_CTE}
SELECT year, month, {_MONEY} AS value, sum(qty) AS weight FROM g
WHERE year BETWEEN 1997 AND 2000 AND flow IN ('A', 'N') GROUP BY 1, 2"""

ORACLE["read_months_present"] = f"""WITH {GOLD_CTE} SELECT year, count(DISTINCT month) AS n_months FROM g GROUP BY 1"""
ORACLE["read_reporters_present"] = f"""WITH {GOLD_CTE}
SELECT year, count(DISTINCT reporter) AS n_reporters FROM g WHERE flow = 'A' GROUP BY 1"""

ORACLE["read_trade_overview"] = f"""WITH {GOLD_CTE}
SELECT year, {_MONEY} AS value, sum(qty) AS weight, count(*) AS n_rows FROM g
WHERE reporter IN (1, 2, 3) AND flow IN ('A', 'R') GROUP BY 1"""

PARTNER_LINES = f"""
pl AS (
  SELECT c.c_nationkey AS partner, s.s_nationkey AS reporter, l.l_returnflag AS flow, l.l_quantity AS qty, {REV} AS v
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

ORACLE["partner_ranking"] = f"""WITH {PARTNER_LINES},
p AS (SELECT partner, sum(CASE WHEN flow = 'A' THEN v END) AS exports, sum(CASE WHEN flow = 'R' THEN v END) AS imports,
             sum(v) AS total, sum(qty) AS weight, sum(v) / NULLIF(sum(qty), 0) AS unit_price
      FROM pl GROUP BY 1 ORDER BY total DESC NULLS LAST, partner LIMIT 30)
SELECT partner, round(exports / 100.0::DOUBLE, 2) AS exports, round(imports / 100.0::DOUBLE, 2) AS imports,
       round(total / 100.0::DOUBLE, 2) AS total, weight, round(unit_price / 100.0::DOUBLE, 2) AS unit_price FROM p"""

LINKS_CTE = """
links AS (SELECT reporter, partner, sum(v) AS value FROM pl GROUP BY 1, 2
          ORDER BY value DESC NULLS LAST, reporter, partner LIMIT 40)"""

ORACLE["flow_links"] = f"""WITH {PARTNER_LINES}, {LINKS_CTE}
SELECT reporter, partner, round(value / 100.0::DOUBLE, 2) AS value FROM links"""

ORACLE["flow_nodes"] = f"""WITH {PARTNER_LINES}, {LINKS_CTE}
SELECT reporter AS node, round(sum(value) / 100.0::DOUBLE, 2) AS value, 'origin' AS side FROM links GROUP BY 1
UNION ALL
SELECT partner AS node, round(sum(value) / 100.0::DOUBLE, 2) AS value, 'destination' AS side FROM links GROUP BY 1"""

ORACLE["country_universes"] = """
SELECT s_nationkey AS nation, count(*) AS n_rows, 'reporter' AS role FROM supplier GROUP BY 1
UNION ALL
SELECT c_nationkey AS nation, count(*) AS n_rows, 'partner' AS role FROM customer GROUP BY 1"""

_FLAGGED = f"""{GOLD_CTE},
fl AS (SELECT *, {_flag4('NULLIF(l_tax, 0)', 'value_cents')} AS data_quality_flag FROM g)"""

ORACLE["read_quality_timeseries"] = f"""WITH {_FLAGGED}
SELECT year, data_quality_flag, count(*) AS n_rows FROM fl GROUP BY 1, 2"""
ORACLE["read_quality_by_product"] = f"""WITH {_FLAGGED}
SELECT product, data_quality_flag, count(*) AS n_rows FROM fl GROUP BY 1, 2"""

ORACLE["read_product_timeseries"] = f"""WITH {GOLD_CTE}
SELECT product, year, {_MONEY} AS value, sum(qty) AS qty_native, {_FAMS} FROM g GROUP BY 1, 2"""

ORACLE["read_cross_annual"] = f"""WITH {GOLD_CTE}
SELECT year, sum(qty) AS measure FROM g WHERE flow = 'A' AND product IN {_PRODUCTS} AND reporter = 7 GROUP BY 1"""

ORACLE["read_products"] = "SELECT p_brand, max(p_name) AS name, count(*) AS n_codes FROM part GROUP BY 1"

_BROWSE_WHERE = "o_orderstatus = 'F' AND o_totalprice >= 100000.0 AND contains(lower(o_orderpriority), 'urgent')"
ORACLE["browse_page"] = f"""SELECT * FROM orders WHERE {_BROWSE_WHERE}
ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 500 OFFSET 100"""
ORACLE["browse_count"] = f"SELECT count(*) AS n_rows FROM orders WHERE {_BROWSE_WHERE}"


# --- analyses and statistics -------------------------------------------------

SUPP_LINES = f"""
sl AS (
  SELECT {YEAR} AS year, {MONTH} AS month, l.l_suppkey, l.l_returnflag AS flow, l.l_linestatus AS unit,
         l.l_quantity AS qty, {REV} AS v, s.s_nationkey AS reporter
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

SETTLED = """
cnt AS (SELECT year, count(DISTINCT l_suppkey) AS n FROM sl WHERE flow = 'A' GROUP BY 1),
st AS (SELECT max(year) AS settled_year FROM cnt WHERE n >= 0.9 * (SELECT max(n) FROM cnt))"""

ORACLE["settled_year"] = f"""WITH {SUPP_LINES}, cnt AS (SELECT year, count(DISTINCT l_suppkey) AS n FROM sl WHERE flow = 'A' GROUP BY 1)
SELECT max(year) AS settled_year, max(mx) AS max_reporters FROM cnt, (SELECT max(n) AS mx FROM cnt) m WHERE n >= 0.9 * mx"""

ORACLE["market_share"] = f"""WITH {SUPP_LINES}, {SETTLED},
world AS (SELECT year, sum(v) AS wv FROM sl WHERE flow = 'A' GROUP BY 1),
country AS (SELECT year, sum(v) AS cv FROM sl WHERE flow = 'A' AND reporter = 7 GROUP BY 1)
SELECT year, round(cv / 100.0::DOUBLE, 2) AS country_value, round(wv / 100.0::DOUBLE, 2) AS world_value,
       round(CASE WHEN wv = 0 THEN 0.0 ELSE cv / wv * 100 END, 6) AS share
FROM country JOIN world USING (year) CROSS JOIN st WHERE year <= settled_year"""

ORACLE["share_by_group"] = f"""WITH {SUPP_LINES}, {SETTLED},
li AS (SELECT {YEAR} AS year, p.p_type AS level, s.s_nationkey AS reporter, {REV} AS v
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
       WHERE l.l_returnflag = 'A'),
world AS (SELECT year, level, sum(v) AS wv FROM li GROUP BY 1, 2),
country AS (SELECT year, level, sum(v) AS cv FROM li WHERE reporter = 7 GROUP BY 1, 2),
j AS (SELECT * FROM country JOIN world USING (year, level) CROSS JOIN st WHERE year <= settled_year)
SELECT level, year, round(CASE WHEN wv = 0 THEN 0.0 ELSE cv / wv * 100 END, 6) AS share FROM j
QUALIFY year = max(year) OVER (PARTITION BY level)"""

ORACLE["export_coefficient"] = f"""WITH {SUPP_LINES},
prod AS (SELECT reporter, year, sum(qty) AS produced FROM sl GROUP BY 1, 2),
expo AS (SELECT reporter, year, sum(qty) AS exported FROM sl WHERE flow = 'A' GROUP BY 1, 2),
ys AS (SELECT year, produced, exported FROM (SELECT year, sum(produced) AS produced FROM prod GROUP BY 1)
       JOIN (SELECT year, sum(exported) AS exported FROM expo GROUP BY 1) USING (year)),
w AS (SELECT min(year) AS y0, max(year) AS y1 FROM ys),
pk AS (SELECT reporter, sum(produced) AS produced FROM prod, w WHERE year BETWEEN y0 AND y1 GROUP BY 1),
ek AS (SELECT reporter, sum(exported) AS exported FROM expo, w WHERE year BETWEEN y0 AND y1 GROUP BY 1),
bk AS (SELECT coalesce(pk.reporter, ek.reporter) AS reporter, coalesce(produced, 0.0) AS produced, coalesce(exported, 0.0) AS exported
       FROM pk FULL OUTER JOIN ek ON pk.reporter = ek.reporter),
u AS (SELECT 'year' AS scope, NULL AS reporter, year, produced, exported FROM ys
      UNION ALL SELECT 'state', reporter, NULL, produced, exported FROM bk
      UNION ALL SELECT 'national', NULL, NULL, sum(produced), sum(exported) FROM bk)
SELECT scope, reporter, year, produced, exported, round(CASE WHEN produced = 0 THEN 0.0 ELSE exported / produced * 100 END, 6) AS coefficient
FROM u WHERE produced IS NOT NULL"""

ORACLE["price_spread"] = f"""
WITH g AS (SELECT {YEAR} AS year, CASE WHEN sum(l_quantity) = 0 THEN 0.0 ELSE sum({REV}) / 100.0::DOUBLE / (sum(l_quantity) * 1000) END AS gate_price
           FROM lineitem GROUP BY 1),
e AS (SELECT {YEAR} AS year, sum({REV}) / 100.0::DOUBLE / NULLIF(sum(l_quantity), 0) AS fob_price FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT year, round(gate_price, 6) AS gate_price, round(fob_price, 6) AS fob_price, round(fob_price - gate_price, 6) AS spread,
       round(CASE WHEN gate_price = 0 THEN 0.0 ELSE fob_price / gate_price END, 6) AS markup
FROM g JOIN e USING (year) WHERE fob_price IS NOT NULL"""

ORACLE["trade_mirror"] = f"""
WITH li AS (SELECT {YEAR} AS year, l.l_returnflag AS flow, s.s_nationkey AS reporter, c.c_nationkey AS partner, {REV} AS v
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN orders o ON l.l_orderkey = o.o_orderkey
            JOIN customer c ON o.o_custkey = c.c_custkey),
a AS (SELECT year, sum(v) AS a FROM li WHERE flow = 'A' AND reporter = 7 GROUP BY 1),
b AS (SELECT year, sum(v) AS b FROM li WHERE flow = 'R' AND partner = 7 GROUP BY 1),
c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(round(o_totalprice * 100)) AS c FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1)
SELECT year, round(a / 100.0::DOUBLE, 2) AS reporter_exports, round(b / 100.0::DOUBLE, 2) AS partner_imports,
       round(c / 100.0::DOUBLE, 2) AS orders_placed,
       round(abs(a - b) / CASE WHEN a + b = 0 THEN 1.0 ELSE (a + b) / 2.0::DOUBLE END * 100.0::DOUBLE, 6) AS discrepancy_pct
FROM a JOIN b USING (year) LEFT JOIN c USING (year)"""

LEVELS = f"""
lv AS (SELECT {YEAR} AS year, p.p_type AS level, sum({REV}) AS value, sum(l_quantity) AS weight,
              sum({REV}) / NULLIF(sum(l_quantity), 0) AS unit_price
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2)"""

ORACLE["value_added"] = f"""WITH {LEVELS}
SELECT year, level, round(value / 100.0::DOUBLE, 2) AS value, weight, round(unit_price / 100.0::DOUBLE, 6) AS unit_price FROM lv"""

ORACLE["premium"] = f"""WITH {LEVELS},
r AS (SELECT *, CASE level WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'SMALL' THEN 3 WHEN 'MEDIUM' THEN 4
                           WHEN 'LARGE' THEN 5 WHEN 'PROMO' THEN 6 END AS rk FROM lv),
rr AS (SELECT * FROM r WHERE rk IS NOT NULL AND year = (SELECT max(year) FROM r WHERE rk IS NOT NULL))
SELECT year, arg_max(level, rk) FILTER (WHERE unit_price > 0) AS top_level, arg_min(level, rk) FILTER (WHERE unit_price > 0) AS base_level,
       round(CASE WHEN count(*) FILTER (WHERE unit_price > 0) < 2 THEN 0.0 ELSE arg_max(unit_price, rk) FILTER (WHERE unit_price > 0)
             / arg_min(unit_price, rk) FILTER (WHERE unit_price > 0) END, 6) AS premium
FROM rr GROUP BY 1"""

ORACLE["predominant_level"] = f"""WITH {LEVELS}
SELECT year, level, round(value / CASE WHEN sum(value) OVER (PARTITION BY year) = 0 THEN 1 ELSE sum(value) OVER (PARTITION BY year) END * 100, 6) AS share FROM lv
QUALIFY row_number() OVER (PARTITION BY year ORDER BY value DESC, level DESC) = 1"""

ORACLE["market_nature_pivot"] = f"""
WITH li AS (SELECT {YEAR} AS year, CASE WHEN l_linestatus = 'F' THEN 'commodity' ELSE 'processed' END AS nature, {REV} AS v FROM lineitem)
SELECT year,
       round(coalesce(sum(CASE WHEN nature = 'commodity' THEN v END), 0) / 100.0::DOUBLE, 2) AS commodity,
       round(coalesce(sum(CASE WHEN nature = 'processed' THEN v END), 0) / 100.0::DOUBLE, 2) AS processed,
       round(coalesce(sum(CASE WHEN nature = 'unclassified' THEN v END), 0) / 100.0::DOUBLE, 2) AS unclassified
FROM li GROUP BY 1"""

_MCOLS = ",\n       ".join(
    f"round(coalesce(max(CASE WHEN month = {m} THEN v END), 0) / 100.0::DOUBLE, 2) AS m{m:02d}" for m in range(1, 13))
_MONTHLY = f"""m AS (SELECT {YEAR} AS year, {MONTH} AS month, sum({REV}) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"""
ORACLE["seasonality_matrix"] = f"""
WITH {_MONTHLY}
SELECT year, {_MCOLS}
FROM m GROUP BY 1"""

ORACLE["seasonality_profile"] = f"""
WITH {_MONTHLY},
p AS (SELECT s.month, coalesce(avg(v), 0.0) AS mean FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) s LEFT JOIN m ON s.month = m.month GROUP BY 1),
st AS (SELECT first(month ORDER BY mean DESC, month ASC) AS peak_month, first(month ORDER BY mean ASC, month ASC) AS trough_month,
              max(mean) / CASE WHEN min(mean) = 0 THEN 1.0 ELSE min(mean) END AS amplitude FROM p)
SELECT month, round(mean / 100.0::DOUBLE, 2) AS mean_value, peak_month, trough_month, round(amplitude, 6) AS amplitude FROM p, st"""

ORACLE["productivity"] = f"""
WITH y AS (SELECT {YEAR} AS year, sum(l_quantity) AS production, sum(round(l_discount * 100)) AS area FROM lineitem GROUP BY 1),
yy AS (SELECT *, production * 1000 / NULLIF(area, 0) AS yield FROM y),
e AS (SELECT min(year) AS fy, max(year) AS ly, arg_min(yield, year) AS fv, arg_max(yield, year) AS lv FROM yy WHERE yield IS NOT NULL)
SELECT year, production, area, round(yield, 6) AS yield,
       round(CASE WHEN fv > 0 THEN (pow(lv / fv, 1.0::DOUBLE / (CASE WHEN ly - fy > 0 THEN ly - fy ELSE 1 END)) - 1) * 100
             ELSE 0.0 END, 6) AS cagr_pct
FROM yy, e"""

ORACLE["region_rollup"] = f"""WITH {SUPP_LINES}, v AS (SELECT reporter, sum(v) AS value FROM sl GROUP BY 1)
SELECT r_name, round(sum(value) / 100.0::DOUBLE, 2) AS value
FROM v JOIN nation ON reporter = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1 HAVING sum(value) IS NOT NULL"""

ORACLE["facet_rollup"] = """
WITH cities AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                WHERE r_name IN ('AMERICA', 'EUROPE') AND c_mktsegment = 'BUILDING')
SELECT n_name, round(sum(round(o_totalprice * 100)) / 100.0::DOUBLE, 2) AS value, count(DISTINCT c_custkey) AS n_cities
FROM orders JOIN cities ON o_custkey = c_custkey GROUP BY 1"""

ORACLE["top_others"] = f"""
WITH pv AS (SELECT l_returnflag AS flow, p.p_brand AS product, sum({REV}) AS value FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY value DESC, product) AS rn, count(*) OVER (PARTITION BY flow) AS n FROM pv),
b AS (SELECT flow, CASE WHEN n <= 7 OR rn <= 6 THEN product ELSE 'others' END AS bucket, sum(value) AS value FROM r GROUP BY 1, 2)
SELECT flow, bucket, round(value / 100.0::DOUBLE, 2) AS value, round(value / sum(value) OVER (PARTITION BY flow), 6) AS share FROM b"""

FLOW_YEAR = f"fy AS (SELECT l_returnflag AS flow, {YEAR} AS year, sum({REV}) AS value FROM lineitem GROUP BY 1, 2)"

ORACLE["yoy"] = f"""WITH {FLOW_YEAR}, l AS (SELECT *, lag(value) OVER (PARTITION BY flow ORDER BY year) AS prev FROM fy)
SELECT flow, year, round(value / 100.0::DOUBLE, 2) AS value,
       round(CASE WHEN prev IS NULL THEN NULL WHEN prev = 0 THEN 0.0 ELSE (value - prev) / prev * 100 END, 6) AS yoy FROM l"""

ORACLE["cagr"] = f"""WITH {FLOW_YEAR},
e AS (SELECT flow, min(year) AS first_year, max(year) AS last_year, arg_min(value, year) AS fv, arg_max(value, year) AS lv
      FROM fy WHERE value IS NOT NULL GROUP BY 1)
SELECT flow, first_year, last_year,
       round(CASE WHEN fv > 0 THEN (pow(lv / fv, 1.0::DOUBLE / (CASE WHEN last_year - first_year > 0 THEN last_year - first_year ELSE 1 END)) - 1) * 100
             ELSE 0.0 END, 6) AS cagr_pct,
       round(CASE WHEN fv > 0 THEN (lv - fv) / fv * 100 ELSE 0.0 END, 6) AS accum_pct
FROM e"""

ORACLE["base100"] = f"""WITH {FLOW_YEAR}
SELECT flow, year, round(100.0::DOUBLE * (value / NULLIF(first_value(value) OVER (PARTITION BY flow ORDER BY year), 0)), 6) AS base100 FROM fy"""

ORACLE["ratio_series"] = f"""WITH {FLOW_YEAR},
r AS (SELECT a.year, 100.0::DOUBLE * (a.value / NULLIF(b.value, 0)) AS ratio FROM fy a JOIN fy b ON a.year = b.year AND a.flow = 'A' AND b.flow = 'R')
SELECT year, round(ratio, 6) AS ratio, round(avg(ratio) OVER (), 6) AS mean_ratio FROM r"""

ORACLE["growth_correlation"] = f"""WITH {FLOW_YEAR},
p AS (SELECT a.flow AS flow_a, b.flow AS flow_b, a.year, a.value AS va, b.value AS vb FROM fy a JOIN fy b ON a.year = b.year AND a.flow < b.flow),
l AS (SELECT *, lag(year) OVER w AS py, lag(va) OVER w AS pa, lag(vb) OVER w AS pb FROM p WINDOW w AS (PARTITION BY flow_a, flow_b ORDER BY year)),
g AS (SELECT flow_a, flow_b, CASE WHEN pa = 0 THEN 0.0 ELSE (va - pa) / pa END AS ga, CASE WHEN pb = 0 THEN 0.0 ELSE (vb - pb) / pb END AS gb
      FROM l WHERE year - py = 1)
SELECT flow_a, flow_b,
       round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(covar_pop(ga, gb) / NULLIF(stddev_pop(ga) * stddev_pop(gb), 0), 0.0) END, 6) AS r,
       count(*) AS n_pairs
FROM g GROUP BY 1, 2"""

ORACLE["ols_trend"] = f"""WITH {FLOW_YEAR},
o AS (SELECT flow, regr_slope(value / 100.0::DOUBLE, year) AS slope, regr_intercept(value / 100.0::DOUBLE, year) AS intercept,
             min(year) AS x0, max(year) AS x1 FROM fy GROUP BY 1)
SELECT flow, round(slope, 2) AS slope, x0, x1, round(slope * x0 + intercept, 2) AS y0, round(slope * x1 + intercept, 2) AS y1 FROM o"""

NATION_YEAR = f"""{SUPP_LINES}, nv AS (SELECT year, reporter, sum(v) AS value FROM sl GROUP BY 1, 2)"""

ORACLE["gini"] = f"""WITH {NATION_YEAR},
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY value) AS i FROM nv WHERE value > 0),
g AS (SELECT year, sum(i * value) AS cum, count(*) AS n, sum(value) AS tot FROM r GROUP BY 1)
SELECT year, n, round(CASE WHEN n < 2 OR tot = 0 THEN 0.0 ELSE 2.0::DOUBLE * cum / (n * tot) - (n + 1)::DOUBLE / n END, 6) AS gini FROM g"""

ORACLE["hhi"] = f"""WITH {NATION_YEAR}, t AS (SELECT nv.*, sum(value) OVER (PARTITION BY year) AS tot FROM nv)
SELECT year, round(coalesce(sum(CASE WHEN tot <> 0 THEN pow(value / NULLIF(tot, 0) * 100.0::DOUBLE, 2) END), 0.0), 6) AS hhi FROM t GROUP BY 1"""

ORACLE["top_n_share"] = f"""WITH {NATION_YEAR},
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY value DESC, reporter) AS rn FROM nv)
SELECT year, round(coalesce(sum(CASE WHEN rn <= 5 THEN value END), 0.0) / CASE WHEN sum(value) = 0 THEN 1.0 ELSE sum(value) END, 6) AS top5_share
FROM r GROUP BY 1"""

ORACLE["lorenz"] = f"""WITH {NATION_YEAR}
SELECT year, reporter, round(row_number() OVER w / count(*) OVER (PARTITION BY year), 6) AS pop_share,
       round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(value) OVER (PARTITION BY year), 6) AS value_share
FROM nv WHERE value > 0 WINDOW w AS (PARTITION BY year ORDER BY value, reporter)"""


# --- check suites, reconcile, incremental, streaming -------------------------

MART_LINES = f"""
li AS (SELECT l.l_returnflag AS flow, {YEAR} AS year, p.p_brand AS product, s.s_nationkey AS reporter, {REV} AS v, l.l_quantity AS qty
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
mart AS (SELECT flow, year, product, reporter, sum(v) AS v, sum(qty) AS qty FROM li GROUP BY 1, 2, 3, 4)"""


def _diff(a: str, b: str) -> str:
    return f"abs(coalesce({a}, 0) - coalesce({b}, 0)) > 1e-6 * greatest(abs(coalesce({a}, 0)), abs(coalesce({b}, 0)), 1.0)"


ORACLE["conservation_checks"] = f"""WITH {MART_LINES},
a AS (SELECT sum(v) AS av, sum(qty) AS aq FROM li), b AS (SELECT sum(v) AS bv, sum(qty) AS bq FROM mart),
af AS (SELECT flow, sum(v) AS av FROM li GROUP BY 1), bf AS (SELECT flow, sum(v) AS bv FROM mart GROUP BY 1)
SELECT 'value_qty_conserved' AS "check", 'error' AS severity, count(*) AS n_failing FROM a, b
WHERE {_diff('av', 'bv')} OR {_diff('aq', 'bq')}
UNION ALL
SELECT 'value_conserved_per_flow', 'error', count(*) FROM af FULL OUTER JOIN bf ON af.flow = bf.flow WHERE {_diff('av', 'bv')}
UNION ALL
SELECT 'mart_has_rows', 'error', count(*) FROM (SELECT count(*) AS n FROM mart) WHERE n = 0"""

ORACLE["grain_checks"] = f"""WITH {MART_LINES}
SELECT 'mart_grain_unique' AS "check", 'error' AS severity,
       (SELECT count(*) FROM (SELECT 1 FROM mart GROUP BY flow, year, product, reporter HAVING count(*) > 1)) AS n_failing
UNION ALL SELECT 'lineitem_order_unique', 'warn', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'orders_not_null', 'error', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL OR o_custkey IS NULL
       OR o_orderstatus IS NULL OR o_totalprice IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL)
UNION ALL SELECT 'flow_accepted', 'error', (SELECT count(*) FROM lineitem WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A', 'N', 'R'))
UNION ALL SELECT 'priority_accepted', 'warn', (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
UNION ALL SELECT 'supplier_exists', 'error', (SELECT count(*) FROM lineitem WHERE l_suppkey IS NOT NULL
       AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier))"""


def _out(x: str, lo: float, hi: float) -> str:
    return f"({x}) IS NOT NULL AND (({x}) < {lo} OR ({x}) > {hi})"


ORACLE["bounded_checks"] = f"""
SELECT 'implied_rate_bounded' AS "check", 'error' AS severity,
       (SELECT count(*) FROM orders WHERE {_out('o_totalprice / 1000.0::DOUBLE', 1.0, 400.0)}) AS n_failing
UNION ALL SELECT 'discount_bounded', 'warn', (SELECT count(*) FROM lineitem WHERE {_out('l_discount', 0.0, 0.08)})
UNION ALL SELECT 'unit_price_bounded', 'warn',
       (SELECT count(*) FROM lineitem WHERE {_out('l_extendedprice / NULLIF(l_quantity, 0)', 900.0, 2000.0)})"""

ORACLE["incremental_equals_full"] = ORACLE["mart_seasonality"]

ORACLE["stream_latest_equals_batch"] = """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


# --- source bookkeeping and curation -----------------------------------------

ORACLE["archive_roundtrip"] = """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS batch_id, count(*) AS rows, count(*) AS n_read FROM orders GROUP BY 1"""

_HWM = "max(CAST(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE))"
ORACLE["bronze_high_water"] = f"""
SELECT o_orderpriority AS series_code, {_HWM} AS hwm,
       greatest(DATE '1996-01-01', CAST({_HWM} - INTERVAL 12 MONTH AS DATE)) AS window_start
FROM orders GROUP BY 1"""

ORACLE["scope_fingerprint"] = """
WITH d AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_suppkey AS VARCHAR) AS c FROM lineitem)
SELECT year, bit_xor(CAST(('0x' || substr(sha256(c), 1, 15)) AS BIGINT)) AS fingerprint, count(*) AS n_codes FROM d GROUP BY 1"""

ORACLE["chunk_plan"] = """
WITH m AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS member FROM supplier),
c AS (SELECT member, CAST(floor((row_number() OVER (ORDER BY member) - 1) / 25) AS INTEGER) AS chunk FROM m),
ch AS (SELECT chunk, CAST(count(*) AS INTEGER) AS n_members, substr(sha1(string_agg(member, ',' ORDER BY member)), 1, 10) AS batch_hash
       FROM c GROUP BY 1),
y AS (SELECT CAST(unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS INTEGER) AS year FROM lineitem)
SELECT year, chunk, n_members, batch_hash FROM y CROSS JOIN ch"""

ORACLE["source_freshness"] = """
WITH m AS (SELECT max(ts) AS newest FROM events),
a AS (SELECT newest, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(newest))) / 3600.0 AS age FROM m)
SELECT newest, round(age, 6) AS age_hours, CASE WHEN age > 72.0 THEN 'error' WHEN age > 24.0 THEN 'warn' ELSE 'pass' END AS status FROM a"""

ORACLE["groups_with_counts"] = f"""WITH {LOG_CTE},
g AS (SELECT DISTINCT event_type AS group_id FROM events),
m AS (SELECT group_name AS group_id, count(*) AS n FROM cur WHERE active GROUP BY 1)
SELECT g.group_id, coalesce(m.n, 0) AS n_members FROM g LEFT JOIN m ON g.group_id = m.group_id"""

CATALOG_CTE = f"""{LOG_CTE},
cat AS (SELECT user_id, group_name AS group_id, CASE WHEN user_id % 2 = 0 THEN 'pevs' ELSE 'comex' END AS source FROM cur WHERE active)"""

ORACLE["catalog_worklist"] = f"""WITH {CATALOG_CTE}
SELECT group_id, count(*) AS n_codes, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM cat GROUP BY 1"""

ORACLE["code_status"] = f"""WITH {CATALOG_CTE},
d AS (SELECT o_custkey AS user_id, count(*) AS n_rows, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year,
             CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders GROUP BY 1)
SELECT cat.user_id, cat.group_id, cat.source, coalesce(d.n_rows, 0) AS n_rows, d.first_year, d.last_year, d.n_rows IS NOT NULL AS has_data
FROM cat LEFT JOIN d ON cat.user_id = d.user_id"""

ORACLE["level_worklist"] = f"""WITH {TIMELINE_CTE},
lv AS (SELECT user_id AS code, event_type AS level FROM tl WHERE valid_to IS NULL)
SELECT lv.level, count(*) AS n_codes FROM customer c LEFT JOIN lv ON c.c_custkey = lv.code GROUP BY 1"""

ORACLE["matrix_with_mapping"] = """
WITH cells AS (SELECT l_returnflag AS flow, l_linestatus AS unit, count(*) AS n_rows FROM lineitem GROUP BY 1, 2),
mp AS (SELECT * FROM (VALUES ('A', 'F', 'external'), ('A', 'O', 'external'), ('N', 'F', 'domestic'), ('X', 'F', 'domestic')) t(flow, unit, market))
SELECT coalesce(cells.flow, mp.flow) AS flow, coalesce(cells.unit, mp.unit) AS unit, n_rows, market
FROM cells FULL OUTER JOIN mp ON cells.flow = mp.flow AND cells.unit = mp.unit"""

ORACLE["auto_mark_orphans"] = f"""WITH {LOG_CTE},
o AS (SELECT user_id, ts AS removed_at FROM cur WHERE NOT active AND user_id IN (SELECT o_custkey FROM orders)),
g AS (SELECT user_id, max_by(group_name, (ts, event_id)) FILTER (WHERE group_name IS NOT NULL) AS grp FROM log GROUP BY 1),
p AS (SELECT user_id, max(CASE WHEN value > 95 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT 'comex' AS banco, CAST(user_id AS VARCHAR) AS code, 'descontinuado' AS status,
       'Removida do cadastro; dados em Gold pendentes (agrupamento ' || coalesce(grp, '—') || ').' AS reason,
       'Descontinuada: será removida do Gold por um operador (com backup), nunca automaticamente.' AS purge_note,
       'system:orphan-detector' AS edited_by, TIMESTAMP '2024-02-01 00:00:00' AS edited_at,
       'descontinuado:commodity:comex:' || CAST(user_id AS VARCHAR) || ':' || strftime(removed_at, '%Y-%m-%dT%H:%M:%S') AS change_id
FROM o LEFT JOIN g USING (user_id) LEFT JOIN p USING (user_id) WHERE p.at IS NULL OR p.at < removed_at"""

ORACLE["purge_plan"] = f"""WITH {LOG_CTE},
r AS (SELECT DISTINCT user_id, x.prefix || CAST(user_id AS VARCHAR) AS code, x.prefix = 'N' AS letter FROM events, (VALUES (''), ('N')) x(prefix)),
j AS (SELECT r.code, CASE WHEN letter THEN 'invalid'
                          WHEN r.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'not_marked'
                          WHEN cur.active THEN 're_added' END AS refused
      FROM r JOIN cur ON r.user_id = cur.user_id)
SELECT 'comex' AS banco, code, refused,
       CASE WHEN refused IS NULL THEN 'DELETE FROM `gold.gold_comex_flows` WHERE ncm_code = ' || chr(39) || code || chr(39) || ';' END AS statement,
       true AS backup_ok, refused IS NULL AS allowed
FROM j"""

ORACLE["gold_snapshot"] = f"""
SELECT 'gold_by_year' AS "table", count(*) AS n_rows, 'gold' AS dataset FROM (SELECT DISTINCT l_returnflag, {YEAR} FROM lineitem)
UNION ALL SELECT 'gold_by_month', count(*), 'gold' FROM (
  SELECT DISTINCT l_returnflag, {YEAR}, {MONTH}, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
UNION ALL SELECT 'gold_orders', count(*), 'gold' FROM orders"""

ORACLE["correlation_matrix"] = f"""
WITH s AS (SELECT {YEAR} AS year, p_brand AS k, sum({REV})::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT a.k AS series_a, b.k AS series_b, count(*) AS n_years,
       round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(covar_pop(a.v, b.v) / NULLIF(stddev_pop(a.v) * stddev_pop(b.v), 0), 0.0) END, 6) AS r
FROM s a JOIN s b ON a.year = b.year AND a.k < b.k GROUP BY 1, 2"""

ORACLE["median_price_sketch"] = f"SELECT {YEAR} AS year, count(*) AS n_rows, true AS within_error FROM lineitem WHERE l_quantity <> 0 GROUP BY 1"

ORACLE["reconcile_samples"] = """
WITH live AS (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1),
src AS (SELECT CASE WHEN k % 11 = 0 THEN -k - 1 ELSE k END AS k, CASE WHEN k % 7 = 0 THEN qty + 1 ELSE qty END AS qty FROM live),
j AS (SELECT coalesce(live.k, src.k) AS k, live.qty AS lv, src.qty AS sv,
             CASE WHEN live.k IS NULL THEN 'only_source' WHEN src.k IS NULL THEN 'only_live' WHEN live.qty <> src.qty THEN 'diverged' ELSE 'equal' END AS status
      FROM live FULL OUTER JOIN src ON live.k = src.k),
n AS (SELECT status, count(*) AS n FROM j GROUP BY 1),
f AS (SELECT * FROM j WHERE status <> 'equal' QUALIFY row_number() OVER (PARTITION BY status ORDER BY k) <= 5),
s AS (SELECT status, string_agg(k || ': source=' || coalesce(CAST(sv AS VARCHAR), '-') || ' live=' || coalesce(CAST(lv AS VARCHAR), '-'), '; ' ORDER BY k) AS samples FROM f GROUP BY 1)
SELECT n.status, n.n, s.samples FROM n LEFT JOIN s ON n.status = s.status"""

ORACLE["header_payload"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS fornecedor_codigo, s_name AS razao_social,
       CASE WHEN (s_suppkey // 100) % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS nacao FROM supplier"""

ORACLE["mesh_flatten"] = """
SELECT c_custkey AS code, c_name AS name, n_name AS uf, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


# --- more reads and joins ----------------------------------------------------

ORDER_CENTS = "round(o_totalprice * 100)"

ORACLE["municipio_yearly"] = f"""WITH {LOG_CTE}
SELECT o.o_custkey AS city, n.n_name AS state, CAST(year(o.o_orderdate) AS INTEGER) AS year,
       round(sum({ORDER_CENTS}) / 100.0::DOUBLE, 2) AS value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = o.o_custkey)
GROUP BY 1, 2, 3"""

ORACLE["geo_mesh"] = """
SELECT c_custkey AS city_code, c_name AS city_name, n_name AS state_name, r_name AS region_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

ORACLE["productivity_read"] = f"""
SELECT {YEAR} AS year, s.s_nationkey AS state, sum(l_quantity) AS production,
       sum(round(l_discount * 100)) AS area_planted, sum(round(l_tax * 100)) AS area_harvested
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE p.p_brand = 'Brand#7' GROUP BY 1, 2"""

ORACLE["current_flow_market"] = f"""WITH {TIMELINE_CTE}
SELECT user_id, event_type AS market, version, valid_from FROM tl WHERE valid_to IS NULL AND event_type <> 'error'"""

ORACLE["flow_market_values"] = f"""
SELECT o.o_orderpriority AS regime, l.l_returnflag AS flow, round(sum({REV}) / 100.0::DOUBLE, 2) AS value, count(*) AS n_rows
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderpriority <> '5-LOW' GROUP BY 1, 2"""

ORACLE["market_nature_series"] = f"""WITH {TIMELINE_CTE},
cur AS (SELECT user_id, event_type AS market FROM tl WHERE valid_to IS NULL AND event_type <> 'error')
SELECT cur.market, CAST(year(o.o_orderdate) AS INTEGER) AS year, round(sum({ORDER_CENTS}) / 100.0::DOUBLE, 2) AS value, count(*) AS n_rows
FROM orders o JOIN cur ON o.o_custkey = cur.user_id GROUP BY 1, 2"""

ORACLE["quality_by_source_read"] = f"SELECT * FROM ({ORACLE['quality_by_source']}) WHERE source = 'orders'"
ORACLE["source_metadata_read"] = f"SELECT * FROM ({ORACLE['source_metadata']}) WHERE source = 'lineitem'"

ORACLE["bilateral_named"] = f"""
WITH m AS (SELECT {YEAR} AS year, s.s_nationkey AS reporter, c.c_nationkey AS partner, sum({REV}) AS cents
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
           JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2, 3)
SELECT m.year, r.n_name AS reporter_name, p.n_name AS partner_name, round(cents / 100.0::DOUBLE, 2) AS value
FROM m JOIN nation r ON m.reporter = r.n_nationkey JOIN nation p ON m.partner = p.n_nationkey"""

ORACLE["seasonality_calendar"] = f"""
WITH m AS (SELECT l_returnflag AS flow, {YEAR} AS year, {MONTH} AS month, sum({REV}) AS cents FROM lineitem GROUP BY 1, 2, 3)
SELECT flow, year, month,
       ['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro'][month] AS month_name_pt,
       CAST(quarter(make_date(year, month, 1)) AS INTEGER) AS quarter, round(cents / 100.0::DOUBLE, 2) AS value
FROM m"""

ORACLE["median_price_by_year"] = f"""
WITH p AS (SELECT {YEAR} AS year, ({REV} / 100.0::DOUBLE) / NULLIF(l_quantity, 0) AS price FROM lineitem),
m AS (SELECT year, quantile_cont(price, 0.5) AS median_price FROM p WHERE price IS NOT NULL GROUP BY 1)
SELECT year, round(median_price, 6) AS median_price,
       median_price < 0.1 * ((lag(median_price) OVER (ORDER BY year) + lead(median_price) OVER (ORDER BY year)) / 2) AS cliffed
FROM m"""

ORACLE["unit_list_per_product"] = """
SELECT p.p_brand AS product, count(DISTINCT l.l_linestatus) AS n_values,
       string_agg(DISTINCT l.l_linestatus, ', ' ORDER BY l.l_linestatus) AS "values", 'single_stat_unit' AS "check", 'warn' AS severity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1 HAVING count(DISTINCT l.l_linestatus) > 1"""


# --- dashboard compositions and domain checks --------------------------------

ORACLE["overview_with_families"] = f"""WITH {GOLD_CTE},
ov AS (SELECT year, sum(value_cents) AS cents, count(*) AS n_rows FROM g GROUP BY 1),
pf AS (SELECT product, year, {_FAMS} FROM g GROUP BY 1, 2),
fam AS (SELECT year, sum(q_mass) AS q_mass, sum(q_vol) AS q_vol, sum(q_count) AS q_count FROM pf GROUP BY 1)
SELECT ov.year, round(cents / 100.0::DOUBLE, 2) AS value, n_rows, q_mass, q_vol, q_count FROM ov LEFT JOIN fam ON ov.year = fam.year"""

ORACLE["latest_complete_year"] = f"""
WITH m AS (SELECT {YEAR} AS year, count(DISTINCT {MONTH}) AS n_months FROM lineitem GROUP BY 1),
l AS (SELECT arg_max(n_months, year) AS n_last, max(year) AS latest_year FROM m)
SELECT latest_year, n_last, CASE WHEN n_last = 12 THEN latest_year ELSE latest_year - 1 END AS latest_complete_year FROM l"""

ORACLE["quality_shares"] = f"""WITH {_FLAGGED},
c AS (SELECT year, data_quality_flag, count(*) AS n_rows FROM fl GROUP BY 1, 2)
SELECT year, data_quality_flag, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY year), 6) AS share FROM c"""

ORACLE["quality_mix"] = f"""WITH {_FLAGGED},
c AS (SELECT data_quality_flag, count(*) AS n_rows FROM fl WHERE data_quality_flag IN ('OK', 'MISSING_QUANTITY') GROUP BY 1)
SELECT data_quality_flag, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share FROM c"""

ORACLE["partner_top3"] = f"""WITH {PARTNER_LINES},
p AS (SELECT flow, partner, sum(v) AS v FROM pl GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY v DESC, partner) AS rn FROM p)
SELECT flow, count(*) AS n_partners, round(sum(v) / 100.0::DOUBLE, 2) AS total,
       round(sum(CASE WHEN rn <= 3 THEN v END) / sum(v), 6) AS top3_share FROM r GROUP BY 1"""

ORACLE["products_by_group"] = f"""WITH {LOG_CTE},
p AS (SELECT p_partkey, p_type AS group_id, p_brand AS code, CASE WHEN p_size > 25 THEN 'massa' ELSE 'volume' END AS family
      FROM part WHERE p_partkey NOT IN (SELECT user_id FROM hidden))
SELECT group_id, count(*) AS n_parts, string_agg(DISTINCT code, ',' ORDER BY code) AS codes,
       count(DISTINCT family) = 1 AS single_family
FROM p GROUP BY 1"""

ORACLE["basket_series"] = f"""WITH {GOLD_CTE}
SELECT state, year, {_MONEY} AS value FROM g WHERE product IN {_PRODUCTS} AND state IN {_STATES} GROUP BY 1, 2"""

ORACLE["coverage_shares"] = f"""WITH {GOLD_CTE},
s AS (SELECT count(DISTINCT year) AS sy, count(DISTINCT state) AS ss FROM g WHERE year BETWEEN 1996 AND 1999 AND state IN {_STATES}),
tt AS (SELECT count(DISTINCT year) AS ty, count(DISTINCT state) AS ts FROM g)
SELECT round(sy / ty, 6) AS year_share, round(ss / ts, 6) AS state_share FROM s, tt"""

ORACLE["herd_composition"] = f"""
WITH s AS (SELECT p.p_brand AS product, {YEAR} AS year, sum(l_quantity) AS stock FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
last AS (SELECT product, arg_max(stock, year) AS stock, max(year) AS year FROM s GROUP BY 1)
SELECT product, year, stock, round(stock / sum(stock) OVER (), 6) AS share FROM last"""

ORACLE["top_states_heatmap"] = f"""WITH {GOLD_CTE},
top AS (SELECT state FROM g GROUP BY 1 ORDER BY sum(value_cents) DESC, state LIMIT 12)
SELECT state, year, {_MONEY} AS value FROM g WHERE state IN (SELECT state FROM top) GROUP BY 1, 2"""

ORACLE["product_profile"] = f"""WITH {GOLD_CTE},
yr AS (SELECT year, sum(value_cents) AS year_total FROM g GROUP BY 1),
p AS (SELECT year, sum(value_cents) AS v, sum(qty) AS q FROM g WHERE product = 'Brand#11' GROUP BY 1),
pk AS (SELECT first(year ORDER BY v DESC, year ASC) AS peak_year FROM p)
SELECT p.year, round(v / 100.0::DOUBLE, 2) AS value, round(lag(v) OVER (ORDER BY p.year) / 100.0::DOUBLE, 2) AS previous,
       round((v / 100.0::DOUBLE) / NULLIF(q, 0), 6) AS unit_price, round(v / year_total, 6) AS share_of_year, peak_year
FROM p JOIN yr ON p.year = yr.year CROSS JOIN pk"""

ORACLE["flow_headline"] = f"""WITH {PARTNER_LINES},
o AS (SELECT reporter, sum(v) AS v FROM pl GROUP BY 1), d AS (SELECT partner, sum(v) AS v FROM pl GROUP BY 1)
SELECT round((SELECT sum(v) FROM o) / 100.0::DOUBLE, 2) AS total,
       (SELECT first(reporter ORDER BY v DESC, reporter ASC) FROM o) AS top_origin,
       (SELECT first(partner ORDER BY v DESC, partner ASC) FROM d) AS top_destination"""

ORACLE["stacked_year_max"] = f"""
WITH fy AS (SELECT l_returnflag AS flow, {YEAR} AS year, sum({REV}) AS v FROM lineitem GROUP BY 1, 2),
y AS (SELECT year, sum(v) AS total FROM fy GROUP BY 1)
SELECT round(greatest(coalesce(max(total), 0.0), 0.0) / 100.0::DOUBLE, 2) AS stack_max FROM y"""

ORACLE["domain_checks"] = f"""WITH {LOG_CTE},
li AS (SELECT p.p_brand AS product, {YEAR} AS year, l.l_linestatus AS unit, l.l_discount, l.l_tax
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
cells AS (SELECT DISTINCT unit, year FROM li),
r AS (SELECT * FROM (VALUES ('F', 1995, 1997, 1.5::DOUBLE), ('F', 1998, 2001, 2.0::DOUBLE), ('O', 1995, 1999, 0.5::DOUBLE))
      t(unit_of_measure, year_from, year_to, brl_factor)),
nf AS (SELECT cells.* FROM cells LEFT JOIN r ON lower(cells.unit) = lower(r.unit_of_measure) AND cells.year BETWEEN r.year_from AND r.year_to
       WHERE r.brl_factor IS NULL),
areas AS (SELECT product, year, sum(round(l_discount * 100)) AS planted, sum(round(l_tax * 100)) AS harvested FROM li GROUP BY 1, 2),
fam AS (SELECT product FROM li GROUP BY 1 HAVING count(DISTINCT CASE WHEN unit = 'F' THEN 'massa' ELSE 'volume' END) > 1),
cat AS (SELECT user_id AS code FROM cur WHERE active),
conf AS (SELECT c_custkey AS code FROM customer),
side AS (SELECT 1 FROM cat FULL OUTER JOIN conf ON cat.code = conf.code WHERE cat.code IS NULL OR conf.code IS NULL),
orph AS (SELECT user_id FROM cur WHERE NOT active AND user_id IN (SELECT o_custkey FROM orders))
SELECT 'monetary_unit_has_factor' AS "check", 'error' AS severity, (SELECT count(*) FROM nf) AS n_failing
UNION ALL SELECT 'planted_ge_harvested', 'warn', (SELECT count(*) FROM areas WHERE planted < harvested)
UNION ALL SELECT 'single_family_per_product', 'warn', (SELECT count(*) FROM fam)
UNION ALL SELECT 'catalog_vs_configured', 'warn', (SELECT count(*) FROM side)
UNION ALL SELECT 'orphans_unmarked', 'warn', (SELECT count(*) FROM orph)"""



def _resolved_sql(ingestion: str) -> str:
    return f"""WITH {LOG_CTE},
cat AS (SELECT user_id AS code FROM cur WHERE active AND coalesce({ingestion}, 'ativa') <> 'pausada'),
n AS (SELECT count(*) AS n FROM cat)
SELECT code, 'catalog' AS origin FROM cat, n WHERE n.n >= 1
UNION ALL
SELECT c_custkey AS code, 'configured' AS origin FROM customer, n WHERE n.n = 0"""


ORACLE["resolved_scope"] = _resolved_sql("CASE WHEN event_type = 'signup' THEN 'pausada' END")


ORACLE["dedup_prefer_real"] = """
SELECT *, CAST(ts AS DATE) AS day FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (event_type = 'error') ASC, ts DESC, event_id DESC) = 1"""

ORACLE["name_state_split"] = r"""
WITH d AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 2 = 0 THEN c_name || ' - ' || upper(substr(c_mktsegment, 1, 2)) ELSE c_name END AS municipio,
         CAST(c_nationkey AS VARCHAR) || '.1 - ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Ção' AS descricao
  FROM customer)
SELECT c_custkey,
       trim(regexp_replace(municipio, '\s-\s[A-Z]{2}$', '')) AS city_name,
       NULLIF(regexp_extract(municipio, '\s-\s([A-Z]{2})$', 1), '') AS state_acronym,
       trim(regexp_replace(descricao, '^([^-]+)\s-\s', '')) AS product_description,
       lower(regexp_replace(regexp_replace(descricao, '^\s+', ''), '\s+$', '')) AS desc_key,
       regexp_replace(regexp_replace(translate(lower(descricao), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'),
                                     '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
FROM d"""


ORACLE["value_matrix_checks"] = f"""
WITH g AS ({ORACLE['deflated_revenue_by_nation_year']}),
x AS (SELECT *, val_yearfx_brl / NULLIF(val_yearfx_usd, 0) AS implied FROM g)
SELECT 'eur_null_before_1999' AS "check", 'error' AS severity,
       (SELECT count(*) FROM g WHERE reference_year < 1999 AND val_yearfx_eur IS NOT NULL) AS n_failing
UNION ALL SELECT 'implied_usd_rate_bounded', 'error', (SELECT count(*) FROM x WHERE implied IS NOT NULL AND (implied < 100.0 OR implied > 400.0))
UNION ALL SELECT 'real_values_present', 'warn', (SELECT count(*) FROM g WHERE val_real_ipca_brl IS NULL)"""

ORACLE["unconvertible_quantities"] = """
WITH li AS (SELECT l_quantity AS qty,
                   CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Caixas'
                        WHEN l_linestatus = 'F' THEN ' Toneladas' ELSE 'quilogramas' END AS unit_raw FROM lineitem)
SELECT unit_raw, count(*) AS n_rows, sum(qty) AS qty_native FROM li
WHERE lower(trim(unit_raw)) NOT IN ('toneladas', 'quilogramas', 'mil litros') GROUP BY 1"""


# --- end-to-end survey pipeline ------------------------------------------------


def _survey_sql(rounded: bool = True) -> str:
    from strata.functions.columns import STATES
    from strata.sources.seeds import HISTORICAL_CURRENCY_FACTORS, UNIT_FAMILY_CONVERSIONS

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{float(v)!r}::DOUBLE" if isinstance(v, float) else str(v)

    fx_rows = ", ".join(f"({lit(u)}, {a}, {b}, {lit(f)})" for u, a, b, f in HISTORICAL_CURRENCY_FACTORS)
    fam_rows = ", ".join(f"({lit(u)}, {lit(f)}, {lit(b)}, {lit(t)})" for u, f, b, t in UNIT_FAMILY_CONVERSIONS)
    ufs = "[" + ", ".join(lit(a) for a, _, _ in STATES) + "]"
    names = " ".join(f"WHEN {lit(a)} THEN {lit(n)}" for a, n, _ in STATES)
    regions = " ".join(f"WHEN {lit(a)} THEN {lit(r)}" for a, _, r in STATES)
    trim = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
    valor_t = trim.format("valor")
    num = f"replace({valor_t}, ',', '.')"
    cols = ["val_yearfx_brl", "val_yearfx_usd", "val_yearfx_eur", "val_real_ipca_brl", "val_real_ipca_usd",
            "val_real_igpm_brl", "val_real_igpdi_eur"] + ([] if rounded else ["val_real_igpm_usd"])
    money = ", ".join(f"round({c}, 2) AS {c}" if rounded else c for c in cols)
    safe_num = (f"CASE WHEN {valor_t} = '' OR {valor_t} IN ('...', '..', '*', 'X') THEN NULL WHEN {valor_t} = '-' THEN 0.0::DOUBLE "
                f"WHEN regexp_full_match({num}, '{_NUM_RE}') THEN TRY_CAST({num} AS DOUBLE) END")
    return f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
agg AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS y, l.l_suppkey, s.s_nationkey, p.p_brand,
         sum(l.l_quantity) AS q, CAST(sum({REV}) AS BIGINT) AS c
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4),
base AS (
  SELECT *, CAST(y AS VARCHAR) AS ano, CAST(l_suppkey AS VARCHAR) AS municipio_codigo,
         'Cidade ' || CAST(l_suppkey AS VARCHAR) || ' - ' || {ufs}[s_nationkey % {len(STATES)} + 1] AS municipio,
         substr(p_brand, 7, 10) AS prod_codigo, '1.' || substr(p_brand, 7, 10) || ' - ' || p_brand AS prod
  FROM agg),
bronze AS (
  SELECT ano, municipio_codigo, municipio, prod_codigo, prod, '144' AS variavel_codigo, 'Toneladas' AS unidade_de_medida,
         CAST(CAST(q AS BIGINT) AS VARCHAR) AS valor, TIMESTAMP '2024-01-01 00:00:00' AS ingestion_timestamp FROM base
  UNION ALL
  SELECT ano, municipio_codigo, municipio, prod_codigo, prod, '145', 'Mil Reais',
         CAST(floor(c / 100000) AS BIGINT)::VARCHAR || ',' || lpad(CAST(c % 100000 AS VARCHAR), 5, '0'),
         TIMESTAMP '2024-01-01 00:00:00' FROM base
  UNION ALL
  SELECT ano, municipio_codigo, municipio, prod_codigo, prod, '144', 'Toneladas', CAST(CAST(q + 1 AS BIGINT) AS VARCHAR),
         TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE y = 2001),
dedup AS (
  SELECT * FROM bronze
  QUALIFY row_number() OVER (PARTITION BY ano, municipio_codigo, prod_codigo, variavel_codigo, lower({trim.format('unidade_de_medida')})
                             ORDER BY ingestion_timestamp DESC) = 1),
parsed AS (
  SELECT TRY_CAST(ano AS INTEGER) AS reference_year, municipio_codigo AS city_code,
         trim(regexp_replace(municipio, '\\s-\\s[A-Z]{{2}}$', '')) AS city_name,
         NULLIF(regexp_extract(municipio, '\\s-\\s([A-Z]{{2}})$', 1), '') AS state_acronym,
         prod_codigo AS product_code, trim(regexp_replace(prod, '^([^-]+)\\s-\\s', '')) AS product_description,
         variavel_codigo, unidade_de_medida, lower({trim.format('unidade_de_medida')}) AS unit_key,
         {safe_num} AS raw, ingestion_timestamp
  FROM dedup),
fxs AS (SELECT * FROM (VALUES {fx_rows}) t(unit_of_measure, year_from, year_to, brl_factor)),
fam AS (SELECT * FROM (VALUES {fam_rows}) t(unit_raw, family, base_unit, to_base)),
silver AS (
  SELECT p.*,
         CASE WHEN variavel_codigo = '145' THEN raw * fxs.brl_factor ELSE raw END AS numeric_value,
         variavel_codigo = '145' AS is_monetary_value,
         CASE WHEN variavel_codigo = '144' THEN unidade_de_medida END AS unit_native,
         CASE WHEN variavel_codigo = '144' THEN coalesce(fam.family, 'desconhecida') END AS family,
         CASE WHEN variavel_codigo = '144' THEN fam.base_unit END AS base_unit,
         CASE WHEN variavel_codigo = '144' THEN raw END AS qty_native,
         CASE WHEN variavel_codigo = '144' THEN raw * fam.to_base END AS qty_base
  FROM parsed p
  LEFT JOIN fxs ON p.unit_key = lower({trim.format('fxs.unit_of_measure')}) AND p.reference_year BETWEEN fxs.year_from AND fxs.year_to
  LEFT JOIN fam ON p.unit_key = fam.unit_raw),
gbase AS (
  SELECT reference_year, state_acronym, city_code, product_code, max(city_name) AS city_name,
         max(product_description) AS product_description, max(family) AS family, max(unit_native) AS unit_native,
         max(qty_native) AS qty_native, max(qty_base) AS qty_base,
         max(CASE WHEN is_monetary_value THEN numeric_value END) AS val_raw
  FROM silver GROUP BY 1, 2, 3, 4
  HAVING max(qty_native) IS NOT NULL OR max(CASE WHEN is_monetary_value THEN numeric_value END) IS NOT NULL),
g AS (
  SELECT gbase.*, {value_matrix_sql(rounded=False)}
  FROM gbase LEFT JOIN fx_year USING (reference_year) LEFT JOIN year_end USING (reference_year)
  CROSS JOIN latest CROSS JOIN fx_last)
SELECT reference_year, make_date(reference_year, 12, 31) AS reference_date, state_acronym,
       CASE state_acronym {names} END AS state_name, CASE state_acronym {regions} END AS region,
       city_code, city_name, product_code, product_description, family, unit_native, qty_native, qty_base,
       CASE WHEN qty_native IS NOT NULL AND val_raw IS NOT NULL THEN 'OK' WHEN qty_native IS NOT NULL THEN 'MISSING_VALUE'
            WHEN val_raw IS NOT NULL THEN 'MISSING_QUANTITY' ELSE 'INCOMPLETE' END AS data_quality_flag,
       {money}
FROM g"""


ORACLE["survey_pipeline"] = _survey_sql()


def _typed(column: str, dash: str = "NULL") -> str:
    """A verbatim value as a number."""
    v = f"regexp_replace(regexp_replace({column}, '^\\s+', ''), '\\s+$', '')"
    num = f"replace({v}, ',', '.')"
    return (f"CASE WHEN {v} IN ('', '...', '..', '*', 'X') THEN NULL WHEN {v} = '-' THEN {dash} "
            f"WHEN regexp_full_match({num}, '{_NUM_RE}') THEN TRY_CAST({num} AS DOUBLE) END")


def _crop_sql() -> str:
    from strata.functions.columns import STATES
    from strata.sources.seeds import HISTORICAL_CURRENCY_FACTORS, UNIT_FAMILY_CONVERSIONS

    text = lambda x: "'" + x.replace("'", "''") + "'"
    fx_rows = ", ".join(f"({text(u)}, {a}, {b}, {f!r}::DOUBLE)" for u, a, b, f in HISTORICAL_CURRENCY_FACTORS)
    fam_rows = ", ".join(
        f"({text(u)}, {text(f)}, {'NULL' if b is None else text(b)}, {'NULL' if x is None else repr(float(x))}::DOUBLE)"
        for u, f, b, x in UNIT_FAMILY_CONVERSIONS)
    ufs = "[" + ", ".join(text(a) for a, _, _ in STATES) + "]"
    names = " ".join(f"WHEN {text(a)} THEN {text(n)}" for a, n, _ in STATES)
    regions = " ".join(f"WHEN {text(a)} THEN {text(r)}" for a, _, r in STATES)
    return f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
agg AS (
  SELECT CAST(CASE WHEN year(l.l_shipdate) >= 1994 THEN year(l.l_shipdate) ELSE 1984 + year(l.l_shipdate) % 2 END AS INTEGER) AS y,
         l.l_suppkey, s.s_nationkey, p.p_brand, CAST(sum(l.l_quantity) AS BIGINT) AS q, CAST(sum({REV}) AS BIGINT) AS c,
         CAST(sum(round(l.l_tax * 100)) AS BIGINT) AS x
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3, 4),
bronze AS (
  SELECT *, '8331' AS var, 'Hectares' AS unit, CAST(q AS VARCHAR) AS valor, 1 AS delivery FROM agg
  UNION ALL SELECT *, '216', 'Hectares', CAST(4 * x AS VARCHAR), 1 FROM agg
  UNION ALL SELECT *, '214', 'Toneladas', CASE WHEN x = 0 THEN '...' ELSE CAST(3 * q AS VARCHAR) END, 1 FROM agg
  UNION ALL SELECT *, '112', 'Quilogramas por Hectare', CASE WHEN x = 0 THEN '-' ELSE CAST(CAST(floor(q * 3000.0::DOUBLE / (x * 4)) AS BIGINT) AS VARCHAR) END, 1 FROM agg
  UNION ALL SELECT *, '215', CASE WHEN y >= 1994 THEN 'Mil Reais' ELSE 'Mil Cruzeiros' END,
         CASE WHEN x % 13 = 12 THEN '..' ELSE CAST(c // 100000 AS VARCHAR) || ',' || lpad(CAST(c % 100000 AS VARCHAR), 5, '0') END, 1 FROM agg
  UNION ALL SELECT *, '214', ' toneladas', CAST(3 * q + 1 AS VARCHAR), 2 FROM agg WHERE y = 1996),
dd AS (
  SELECT *, lower(trim(unit)) AS unit_key, {_typed('valor', '0.0::DOUBLE')} AS raw FROM bronze
  QUALIFY row_number() OVER (PARTITION BY y, l_suppkey, p_brand, var, lower(trim(unit)) ORDER BY delivery DESC) = 1),
fxs AS (SELECT * FROM (VALUES {fx_rows}) t(unit_of_measure, year_from, year_to, brl_factor)),
fam AS (SELECT * FROM (VALUES {fam_rows}) t(unit_raw, family, base_unit, to_base)),
silver AS (
  SELECT dd.*, raw * (fxs.brl_factor * CASE WHEN y = 1985 AND unit_key = 'mil cruzeiros' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) AS money,
         coalesce(fam.family, 'desconhecida') AS family, fam.base_unit, raw * fam.to_base AS based
  FROM dd LEFT JOIN fxs ON unit_key = lower(fxs.unit_of_measure) AND y BETWEEN year_from AND year_to
  LEFT JOIN fam ON unit_key = fam.unit_raw),
gbase AS (
  SELECT y AS reference_year, {ufs}[s_nationkey % {len(STATES)} + 1] AS state_acronym, CAST(l_suppkey AS VARCHAR) AS city_code,
         'Cidade ' || CAST(l_suppkey AS VARCHAR) AS city_name, substr(p_brand, 7, 10) AS product_code, max(p_brand) AS product_description,
         max(CASE WHEN var = '214' THEN family END) AS family, max(CASE WHEN var = '214' THEN unit END) AS unit_native,
         max(CASE WHEN var = '214' THEN base_unit END) AS base_unit, max(CASE WHEN var = '214' THEN raw END) AS qty_native,
         max(CASE WHEN var = '214' THEN based END) AS qty_base, max(CASE WHEN var = '8331' THEN raw END) AS area_planted_ha,
         max(CASE WHEN var = '216' THEN raw END) AS area_harvested_ha, max(CASE WHEN var = '112' THEN raw END) AS yield_kg_ha,
         max(CASE WHEN var = '215' THEN money END) AS val_raw
  FROM silver GROUP BY 1, 2, 3, 4, 5),
g AS (
  SELECT gbase.*, {value_matrix_sql(rounded=False)}
  FROM gbase LEFT JOIN fx_year USING (reference_year) LEFT JOIN year_end USING (reference_year) CROSS JOIN latest CROSS JOIN fx_last),
d AS (
  SELECT *, val_real_ipca_brl AS v, qty_native AS q,
         CASE WHEN val_real_ipca_brl / NULLIF(qty_native, 0) > 0 THEN ln(val_real_ipca_brl / NULLIF(qty_native, 0)) END AS lp,
         CASE WHEN val_real_ipca_brl > 0 THEN ln(val_real_ipca_brl) END AS lv, CASE WHEN qty_native > 0 THEN ln(qty_native) END AS lq
  FROM g),
s AS (
  SELECT product_code, family, quantile_cont(lp, 0.5) AS mp, quantile_cont(lv, 0.5) AS mv, quantile_cont(lv, 0.75) AS pv,
         quantile_cont(lq, 0.5) AS mq, quantile_cont(lq, 0.75) AS pq, count(v / NULLIF(q, 0)) AS n FROM d GROUP BY 1, 2),
e AS (
  SELECT d.*, abs(lp - mp) AS dev, (lv - mv) / NULLIF(pv - mv, 0) AS vex, (lq - mq) / NULLIF(pq - mq, 0) AS qex,
         (v IS NULL OR v <= 0 OR q IS NULL OR q <= 0 OR mp IS NULL OR n < 10 OR v < 1000) AS guard
  FROM d LEFT JOIN s USING (product_code, family))
SELECT reference_year, make_date(reference_year, 12, 31) AS reference_date, state_acronym, CASE state_acronym {names} END AS state_name,
       CASE state_acronym {regions} END AS region, city_code, city_name, product_code, product_description, family, unit_native,
       qty_native, qty_base, base_unit, area_planted_ha, area_harvested_ha, yield_kg_ha, val_yearfx_brl,
       round(val_yearfx_usd, 2) AS val_yearfx_usd, round(val_real_ipca_brl, 2) AS val_real_ipca_brl, round(val_real_igpdi_eur, 2) AS val_real_igpdi_eur,
       CASE WHEN area_planted_ha < area_harvested_ha THEN 'AREA_INCONSISTENT'
            WHEN qty_native IS NULL AND val_raw IS NULL THEN 'INCOMPLETE' WHEN val_raw IS NULL THEN 'MISSING_VALUE' WHEN qty_native IS NULL THEN 'MISSING_QUANTITY'
            WHEN guard THEN 'OK' WHEN dev >= ln(1.2) AND abs(vex) >= abs(qex) THEN 'PROBLEMATIC_VALUE'
            WHEN dev >= ln(1.2) AND abs(qex) > abs(vex) THEN 'PROBLEMATIC_QUANTITY'
            WHEN vex >= 1.5 THEN 'OUTLIER_VALUE' WHEN qex >= 1.5 THEN 'OUTLIER_QUANTITY' ELSE 'OK' END AS data_quality_flag
FROM e"""


ORACLE["crop_pipeline"] = _crop_sql()


def _livestock_sql() -> str:
    from strata.functions.columns import STATES
    from strata.sources.seeds import HISTORICAL_CURRENCY_FACTORS, UNIT_FAMILY_CONVERSIONS

    text = lambda x: "'" + x.replace("'", "''") + "'"
    fx_rows = ", ".join(f"({text(u)}, {a}, {b}, {f!r}::DOUBLE)" for u, a, b, f in HISTORICAL_CURRENCY_FACTORS)
    fam_rows = ", ".join(
        f"({text(u)}, {text(f)}, {'NULL' if b is None else text(b)}, {'NULL' if x is None else repr(float(x))}::DOUBLE)"
        for u, f, b, x in UNIT_FAMILY_CONVERSIONS)
    ufs = "[" + ", ".join(text(a) for a, _, _ in STATES) + "]"
    names = " ".join(f"WHEN {text(a)} THEN {text(n)}" for a, n, _ in STATES)
    regions = " ".join(f"WHEN {text(a)} THEN {text(r)}" for a, _, r in STATES)
    return f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
agg AS (
  SELECT CAST(CASE WHEN year(l.l_shipdate) >= 1994 THEN year(l.l_shipdate) ELSE 1984 + year(l.l_shipdate) % 2 END AS INTEGER) AS y,
         l.l_suppkey, s.s_nationkey, p.p_brand, l.l_returnflag = 'R' AS herd, CAST(sum(l.l_quantity) AS BIGINT) AS q, CAST(sum({REV}) AS BIGINT) AS c
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3, 4, 5),
bronze AS (
  SELECT *, 'H' || substr(p_brand, 7) AS code, '105' AS var, 'Cabeças' AS unit, CASE WHEN q = 13 THEN '-' ELSE CAST(q AS VARCHAR) END AS valor FROM agg WHERE herd
  UNION ALL SELECT *, substr(p_brand, 7), '106', ['Mil litros', 'Mil dúzias', 'Quilogramas'][CAST(substr(p_brand, 7) AS INTEGER) % 3 + 1],
         CASE WHEN q = 17 THEN '...' ELSE CAST(q AS VARCHAR) END FROM agg WHERE NOT herd
  UNION ALL SELECT *, substr(p_brand, 7), '215', CASE WHEN y >= 1994 THEN 'Mil Reais' ELSE 'Mil Cruzeiros' END,
         CASE WHEN q = 19 THEN 'X' ELSE CAST(c // 100000 AS VARCHAR) || ',' || lpad(CAST(c % 100000 AS VARCHAR), 5, '0') END FROM agg WHERE NOT herd),
dd AS (SELECT *, lower(unit) AS unit_key, {_typed('valor', '0.0::DOUBLE')} AS raw FROM bronze),
fxs AS (SELECT * FROM (VALUES {fx_rows}) t(unit_of_measure, year_from, year_to, brl_factor)),
fam AS (SELECT * FROM (VALUES {fam_rows}) t(unit_raw, family, base_unit, to_base)),
silver AS (
  SELECT dd.*, raw * (fxs.brl_factor * CASE WHEN y = 1985 AND unit_key = 'mil cruzeiros' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) AS money,
         coalesce(fam.family, 'desconhecida') AS family, fam.base_unit, raw * fam.to_base AS based
  FROM dd LEFT JOIN fxs ON unit_key = lower(fxs.unit_of_measure) AND y BETWEEN year_from AND year_to
  LEFT JOIN fam ON unit_key = fam.unit_raw),
gbase AS (
  SELECT y AS reference_year, {ufs}[s_nationkey % {len(STATES)} + 1] AS state_acronym, CAST(l_suppkey AS VARCHAR) AS city_code,
         'Cidade ' || CAST(l_suppkey AS VARCHAR) AS city_name, code AS product_code, max(p_brand) AS product_description,
         CASE WHEN herd THEN 'stock' ELSE 'flow' END AS measure_kind,
         max(CASE WHEN var <> '215' THEN family END) AS family, max(CASE WHEN var <> '215' THEN unit END) AS unit_native,
         max(CASE WHEN var <> '215' THEN base_unit END) AS base_unit, max(CASE WHEN var <> '215' THEN raw END) AS qty_native,
         max(CASE WHEN var <> '215' THEN based END) AS qty_base, max(CASE WHEN var = '215' THEN money END) AS val_raw
  FROM silver GROUP BY 1, 2, 3, 4, 5, 7
  HAVING max(CASE WHEN var <> '215' THEN raw END) IS NOT NULL OR max(CASE WHEN var = '215' THEN money END) IS NOT NULL),
g AS (
  SELECT gbase.*, {value_matrix_sql(rounded=False)}
  FROM gbase LEFT JOIN fx_year USING (reference_year) LEFT JOIN year_end USING (reference_year) CROSS JOIN latest CROSS JOIN fx_last),
d AS (
  SELECT *, val_real_ipca_brl AS v, qty_native AS q,
         CASE WHEN val_real_ipca_brl / NULLIF(qty_native, 0) > 0 THEN ln(val_real_ipca_brl / NULLIF(qty_native, 0)) END AS lp,
         CASE WHEN val_real_ipca_brl > 0 THEN ln(val_real_ipca_brl) END AS lv, CASE WHEN qty_native > 0 THEN ln(qty_native) END AS lq
  FROM g),
s AS (
  SELECT product_code, family, quantile_cont(lp, 0.5) AS mp, quantile_cont(lv, 0.5) AS mv, quantile_cont(lv, 0.75) AS pv,
         quantile_cont(lq, 0.5) AS mq, quantile_cont(lq, 0.75) AS pq, count(v / NULLIF(q, 0)) AS n FROM d GROUP BY 1, 2),
e AS (
  SELECT d.*, abs(lp - mp) AS dev, (lv - mv) / NULLIF(pv - mv, 0) AS vex, (lq - mq) / NULLIF(pq - mq, 0) AS qex,
         (v IS NULL OR v <= 0 OR q IS NULL OR q <= 0 OR mp IS NULL OR n < 10 OR v < 1000) AS guard
  FROM d LEFT JOIN s USING (product_code, family))
SELECT reference_year, make_date(reference_year, 12, 31) AS reference_date, state_acronym, CASE state_acronym {names} END AS state_name,
       CASE state_acronym {regions} END AS region, city_code, city_name, product_code, product_description, measure_kind, family, unit_native,
       qty_native, qty_base, base_unit, val_raw AS val_yearfx_brl, round(val_yearfx_usd, 2) AS val_yearfx_usd,
       round(val_real_ipca_brl, 2) AS val_real_ipca_brl, round(val_real_igpdi_eur, 2) AS val_real_igpdi_eur,
       CASE WHEN measure_kind = 'stock' THEN CASE WHEN qty_native IS NOT NULL THEN 'OK' ELSE 'MISSING_QUANTITY' END
            WHEN qty_native IS NULL AND val_raw IS NULL THEN 'INCOMPLETE' WHEN val_raw IS NULL THEN 'MISSING_VALUE' WHEN qty_native IS NULL THEN 'MISSING_QUANTITY'
            WHEN guard THEN 'OK' WHEN dev >= ln(1.2) AND abs(vex) >= abs(qex) THEN 'PROBLEMATIC_VALUE'
            WHEN dev >= ln(1.2) AND abs(qex) > abs(vex) THEN 'PROBLEMATIC_QUANTITY'
            WHEN vex >= 1.5 THEN 'OUTLIER_VALUE' WHEN qex >= 1.5 THEN 'OUTLIER_QUANTITY' ELSE 'OK' END AS data_quality_flag
FROM e"""


ORACLE["livestock_pipeline"] = _livestock_sql()

ORACLE["index_silver_from_strings"] = f"""
WITH m AS (SELECT o_orderstatus AS st, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT CASE st WHEN 'F' THEN '433' WHEN 'O' THEN '189' ELSE '190' END AS series_code, * FROM m
      UNION ALL SELECT '4447', * FROM m WHERE st = 'F'),
days AS (SELECT *, strftime(m, '%d/%m/%Y') AS ds FROM c
         UNION ALL SELECT *, '32/' || strftime(m, '%m/%Y') FROM c WHERE month(m) % 3 = 0),
b AS (SELECT *, CASE WHEN n % 10 = 9 THEN '...' ELSE CAST(n % 300 // 100 AS VARCHAR) || ',' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END AS vs,
             TIMESTAMP '2024-01-01 00:00:00' AS ingestion_timestamp FROM days
      UNION ALL SELECT *, ' -0,25 ', TIMESTAMP '2024-02-01 00:00:00' FROM days WHERE ds LIKE '%1995'),
dd AS (SELECT *, CAST(try_strptime(ds, '%d/%m/%Y') AS DATE) AS reference_date, {_typed('vs')} AS monthly_pct_change FROM b
       WHERE series_code IN ('433', '189', '190')
       QUALIFY row_number() OVER (PARTITION BY series_code, ds ORDER BY ingestion_timestamp DESC) = 1)
SELECT series_code, 'Serie ' || st AS series_name, reference_date, CAST(year(reference_date) AS INTEGER) AS reference_year,
       CAST(month(reference_date) AS INTEGER) AS reference_month, monthly_pct_change,
       round(100.0::DOUBLE * exp(sum(ln(1.0::DOUBLE + monthly_pct_change / 100.0::DOUBLE)) OVER (PARTITION BY series_code ORDER BY reference_date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS index_value, ingestion_timestamp
FROM dd WHERE reference_date IS NOT NULL AND monthly_pct_change IS NOT NULL"""

ORACLE["fx_silver_from_strings"] = f"""
WITH g AS (SELECT o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS day, CAST(max(floor(o_totalprice)) AS BIGINT) AS p
           FROM orders GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN p % 50 = 0 THEN 'X' ELSE CAST(p // 1000 AS VARCHAR) || ',' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') END AS vs FROM g),
b AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS ingestion_timestamp FROM d
      UNION ALL SELECT pr, day, p, '5,125', TIMESTAMP '2024-02-01 00:00:00' FROM d WHERE year(day) = 1996 AND month(day) = 1)
SELECT CASE pr WHEN '1-URGENT' THEN '1' ELSE '21619' END AS series_code, CASE pr WHEN '1-URGENT' THEN 'USD' ELSE 'EUR' END AS currency,
       day AS reference_date, CAST(year(day) AS INTEGER) AS reference_year, CAST(month(day) AS INTEGER) AS reference_month,
       {_typed('vs')} AS brl_per_foreign_unit, ingestion_timestamp
FROM b WHERE pr IN ('1-URGENT', '2-HIGH')
QUALIFY row_number() OVER (PARTITION BY pr, day ORDER BY ingestion_timestamp DESC) = 1"""


def _comex_sql() -> str:
    from strata.functions.columns import STATES
    from strata.sources.seeds import UNIT_FAMILY_CONVERSIONS

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{float(v)!r}::DOUBLE"

    fam_rows = ", ".join(f"({lit(u)}, {lit(f)}, {lit(b)}, {lit(t)})" for u, f, b, t in UNIT_FAMILY_CONVERSIONS)
    ufs = "[" + ", ".join(lit(a) for a, _, _ in STATES) + "]"
    names = " ".join(f"WHEN {lit(a)} THEN {lit(n)}" for a, n, _ in STATES)
    cell = "flow, reference_year, reference_month, ncm_code, country_code, state_acronym, transport_route_code"
    return f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
li AS (
  SELECT CASE l.l_returnflag WHEN 'A' THEN 'EXP' WHEN 'N' THEN 'EXP' WHEN 'R' THEN 'IMP' END AS flow,
         CAST(year(l.l_shipdate) AS VARCHAR) AS co_ano, lpad(CAST(month(l.l_shipdate) AS VARCHAR), 2, '0') AS co_mes,
         lpad(substr(p.p_brand, 7, 10), 8, '0') AS co_ncm, CASE l.l_linestatus WHEN 'F' THEN '10' WHEN 'O' THEN '11' END AS co_unid,
         lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0') AS co_pais, {ufs}[s.s_nationkey % {len(STATES)} + 1] AS sg_uf,
         l.l_quantity, {REV} AS cents, round(l.l_tax * 100) AS tax_cents
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey),
agg AS (
  SELECT flow, co_ano, co_mes, co_ncm, co_unid, co_pais, sg_uf, CAST(sum(l_quantity) AS BIGINT) AS q,
         CAST(sum(cents) AS BIGINT) AS c, CAST(sum(tax_cents) AS BIGINT) AS f
  FROM li GROUP BY 1, 2, 3, 4, 5, 6, 7),
bronze AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM agg
  UNION ALL
  SELECT *, TIMESTAMP '2024-02-01 00:00:00' FROM agg WHERE flow = 'EXP' AND co_ano = '2001' AND co_unid = '10'),
lb AS (SELECT * FROM bronze QUALIFY ts = max(ts) OVER (PARTITION BY flow, co_ano)),
dd AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY flow, co_ano, co_mes, co_ncm, co_pais, sg_uf, co_unid ORDER BY ts DESC) = 1),
units AS (SELECT * FROM (VALUES ('10', 'Quilograma Liquido', 'kg'), ('11', 'Tonelada', 't')) t(co_unid, unit_name, unit_symbol)),
fam AS (SELECT * FROM (VALUES {fam_rows}) t(unit_raw, family, base_unit, to_base)),
silver AS (
  SELECT dd.flow, CAST(dd.co_ano AS INTEGER) AS reference_year, CAST(dd.co_mes AS INTEGER) AS reference_month,
         coalesce(CASE dd.co_ncm WHEN '00000001' THEN '00000010' END, dd.co_ncm) AS ncm_code, dd.co_pais AS country_code,
         dd.sg_uf AS state_acronym, '01' AS transport_route_code, dd.co_unid AS stat_unit_code, u.unit_name AS unit_native,
         coalesce(fam.family, 'desconhecida') AS family, fam.base_unit, CAST(dd.q AS DOUBLE) AS qty_native,
         dd.q * fam.to_base AS qty_base, CAST(dd.q * 10 AS DOUBLE) AS net_weight_kg, CAST(floor(dd.c / 100) AS DOUBLE) AS val_fob_usd,
         CASE WHEN dd.flow = 'IMP' THEN CAST(dd.f AS DOUBLE) END AS freight_usd,
         CASE WHEN dd.flow = 'IMP' THEN 0.5::DOUBLE END AS insurance_usd
  FROM dd LEFT JOIN units u ON dd.co_unid = u.co_unid LEFT JOIN fam ON lower(trim(u.unit_name)) = fam.unit_raw),
r AS (SELECT *, first_value(stat_unit_code) OVER (PARTITION BY {cell} ORDER BY qty_native DESC NULLS LAST, stat_unit_code) AS dom FROM silver),
base AS (
  SELECT {cell}, max(dom) AS stat_unit_code, max(CASE WHEN stat_unit_code = dom THEN unit_native END) AS unit_native,
         max(CASE WHEN stat_unit_code = dom THEN family END) AS family,
         sum(CASE WHEN stat_unit_code = dom THEN qty_native END) AS qty_native,
         sum(CASE WHEN stat_unit_code = dom THEN qty_base END) AS qty_base,
         sum(net_weight_kg) AS net_weight_kg, sum(val_fob_usd) AS val_fob_usd, sum(freight_usd) AS freight_usd,
         sum(insurance_usd) AS insurance_usd, count(*) AS source_rows
  FROM r GROUP BY 1, 2, 3, 4, 5, 6, 7),
fxm AS (
  SELECT CAST(year(reference_date) AS INTEGER) AS reference_year, CAST(month(reference_date) AS INTEGER) AS reference_month,
         avg(CASE WHEN currency = 'USD' THEN brl_per_foreign_unit END) AS usd_avg,
         avg(CASE WHEN currency = 'EUR' AND year(reference_date) >= 1999 THEN brl_per_foreign_unit END) AS eur_avg
  FROM fx WHERE brl_per_foreign_unit IS NOT NULL GROUP BY 1, 2),
im AS (
  SELECT reference_year, reference_month, max(CASE WHEN series_code = '433' THEN index_value END) AS ipca_index,
         max(CASE WHEN series_code = '189' THEN index_value END) AS igpm_index
  FROM idx WHERE index_value IS NOT NULL GROUP BY 1, 2),
g AS (
  SELECT base.*, val_fob_usd * usd_avg AS nominal, eur_avg, ipca_index, igpm_index, ipca_current, igpm_current,
         brl_per_usd_current, brl_per_eur_current
  FROM base LEFT JOIN fxm USING (reference_year, reference_month) LEFT JOIN im USING (reference_year, reference_month)
  CROSS JOIN latest CROSS JOIN fx_last)
SELECT flow, reference_year, reference_month, make_date(reference_year, reference_month, 1) AS reference_date, ncm_code,
       country_code, state_acronym, CASE state_acronym {names} END AS state_name, stat_unit_code, unit_native, family,
       qty_native, qty_base, net_weight_kg, source_rows,
       CASE WHEN net_weight_kg IS NULL AND val_fob_usd IS NULL THEN 'INCOMPLETE' WHEN val_fob_usd IS NULL THEN 'MISSING_VALUE'
            WHEN net_weight_kg IS NULL THEN 'MISSING_WEIGHT' ELSE 'OK' END AS data_quality_flag,
       round(val_fob_usd, 2) AS val_fob_usd, round(freight_usd, 2) AS freight_usd, round(insurance_usd, 2) AS insurance_usd,
       round(nominal, 2) AS val_yearfx_brl, round(nominal / NULLIF(eur_avg, 0), 2) AS val_yearfx_eur,
       round(nominal * (ipca_current / NULLIF(ipca_index, 0)), 2) AS val_real_ipca_brl,
       round((nominal * (igpm_current / NULLIF(igpm_index, 0))) / NULLIF(brl_per_usd_current, 0), 2) AS val_real_igpm_usd
FROM g"""


ORACLE["comex_pipeline"] = _comex_sql()



def _comtrade_sql(extra: str = "") -> str:
    from strata.sources.seeds import UNIT_FAMILY_CONVERSIONS

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{float(v)!r}::DOUBLE"

    fam_rows = ", ".join(f"({lit(u)}, {lit(f)}, {lit(b)}, {lit(t)})" for u, f, b, t in UNIT_FAMILY_CONVERSIONS)
    key = "refYear, reporterCode, partnerCode, cmdCode, flowCode, customsCode"
    return f"""
WITH li AS (
  SELECT CAST(year(l.l_shipdate) AS VARCHAR) AS refYear, CAST(s.s_nationkey AS VARCHAR) AS reporterCode,
         CASE l.l_returnflag WHEN 'A' THEN 'X' WHEN 'R' THEN 'M' WHEN 'N' THEN 'RX' END AS flowCode,
         CAST(c.c_nationkey AS VARCHAR) AS partnerCode,
         CASE WHEN p.p_size <= 5 THEN lpad(substr(p.p_brand, 7, 10), 4, '0') ELSE lpad(substr(p.p_brand, 7, 10), 6, '0') END AS cmdCode,
         CASE WHEN l.l_linestatus = 'F' THEN '8' ELSE '-1' END AS qtyUnitCode,
         CASE WHEN l.l_discount >= 0.09 THEN 'C01' ELSE 'C00' END AS customsCode,
         l.l_quantity, {REV} AS cents
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey),
agg AS (SELECT refYear, reporterCode, flowCode, partnerCode, cmdCode, qtyUnitCode, customsCode,
               CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(cents) AS BIGINT) AS c FROM li GROUP BY 1, 2, 3, 4, 5, 6, 7),
bronze AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM agg
  UNION ALL
  SELECT *, TIMESTAMP '2024-02-01 00:00:00' FROM agg WHERE refYear = '2001' AND reporterCode = '7' AND flowCode <> 'M'),
lb AS (SELECT * FROM bronze QUALIFY ts = max(ts) OVER (PARTITION BY refYear, reporterCode)),
dd AS (
  SELECT * FROM lb
  WHERE partnerCode <> '0' AND flowCode IN ('X', 'M') AND customsCode = 'C00' AND length(cmdCode) = 6
    AND CAST(refYear AS INTEGER) >= 2000
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, (qtyUnitCode = '-1') ASC) = 1),
units AS (SELECT * FROM (VALUES ('8', 'Weight in kilograms', 'kg', 'kg'), ('-1', 'No quantity', '', '')) t(qty_unit_code, unit_name, unit_symbol, unit_raw)),
fam AS (SELECT * FROM (VALUES {fam_rows}) t(unit_raw, family, base_unit, to_base))
SELECT CASE flowCode WHEN 'X' THEN 'export' WHEN 'M' THEN 'import' END AS flow, CAST(refYear AS INTEGER) AS reference_year,
       reporterCode AS reporter_code, partnerCode AS partner_code,
       coalesce(CASE cmdCode WHEN '000001' THEN '000010' END, cmdCode) AS cmd_code, cmdCode AS cmd_code_reported,
       substr(cmdCode, 1, 2) AS hs_chapter, qtyUnitCode AS qty_unit_code, u.unit_name AS unit_native,
       coalesce(fam.family, 'desconhecida') AS family,
       NULLIF(CASE WHEN qtyUnitCode = '-1' THEN 0.0::DOUBLE ELSE CAST(q AS DOUBLE) END, 0) AS qty_native,
       NULLIF(CASE WHEN qtyUnitCode = '-1' THEN 0.0::DOUBLE ELSE CAST(q AS DOUBLE) END, 0) * fam.to_base AS qty_base,
       NULLIF(CAST(q * 10 AS DOUBLE), 0) AS net_weight_kg, NULLIF(CAST(q * 11 AS DOUBLE), 0) AS gross_weight_kg,
       CAST(floor(c / 100) AS DOUBLE) AS primary_value_usd, CAST(floor(c / 100) AS DOUBLE) AS fob_value_usd,
       CAST(NULL AS DOUBLE) AS cif_value_usd{extra}
FROM dd LEFT JOIN units u ON dd.qtyUnitCode = u.qty_unit_code LEFT JOIN fam ON NULLIF(u.unit_raw, '') = fam.unit_raw"""


ORACLE["comtrade_pipeline"] = _comtrade_sql()



def _comtrade_gold_sql() -> str:
    silver = _comtrade_sql(", customsCode AS customs_code, fam.base_unit AS base_unit, u.unit_symbol AS unit_native_symbol")
    cell = "flow, customs_code, reference_year, reporter_code, partner_code, cmd_code"
    return f"""
WITH {INDEX_CTES}, {FX_CTES}, {DEFLATION_CTES},
silver AS ({silver}),
r AS (SELECT *, first_value(qty_unit_code) OVER (PARTITION BY {cell} ORDER BY qty_native DESC NULLS LAST, qty_unit_code) AS dom FROM silver),
base AS (
  SELECT {cell}, max(dom) AS qty_unit_code, max(CASE WHEN qty_unit_code = dom THEN unit_native END) AS unit_native,
         max(CASE WHEN qty_unit_code = dom THEN family END) AS family,
         sum(CASE WHEN qty_unit_code = dom THEN qty_native END) AS qty_native,
         sum(CASE WHEN qty_unit_code = dom THEN qty_base END) AS qty_base,
         sum(net_weight_kg) AS net_weight_kg, sum(gross_weight_kg) AS gross_weight_kg,
         sum(primary_value_usd) AS primary_value_usd, sum(fob_value_usd) AS fob_value_usd, count(*) AS source_rows
  FROM r GROUP BY 1, 2, 3, 4, 5, 6),
g AS (
  SELECT base.*, CASE WHEN reference_year >= 1994 THEN primary_value_usd * brl_per_usd_avg END AS nominal,
         brl_per_usd_avg, brl_per_eur_avg, ipca_year_end, igpm_year_end, igpdi_year_end, ipca_current, igpm_current, igpdi_current,
         brl_per_usd_current, brl_per_eur_current
  FROM base LEFT JOIN fx_year USING (reference_year) LEFT JOIN year_end USING (reference_year) CROSS JOIN latest CROSS JOIN fx_last),
h AS (SELECT DISTINCT lpad(substr(p_brand, 7, 10), 6, '0') AS cmd_code, p_brand AS description FROM part)
SELECT g.reference_year, make_date(g.reference_year, 12, 31) AS reference_date, g.flow, g.customs_code, g.cmd_code,
       substr(g.cmd_code, 1, 2) AS hs_chapter, h.description AS cmd_description, g.reporter_code, rn.n_name AS reporter_name,
       g.partner_code, pn.n_name AS partner_name, pn.n_regionkey = 0 AS partner_is_group, g.family, g.qty_unit_code,
       g.unit_native, g.qty_native, g.qty_base, g.net_weight_kg, g.gross_weight_kg, g.source_rows,
       CASE WHEN coalesce(g.qty_native, g.net_weight_kg) IS NULL AND g.primary_value_usd IS NULL THEN 'INCOMPLETE'
            WHEN g.primary_value_usd IS NULL THEN 'MISSING_VALUE'
            WHEN coalesce(g.qty_native, g.net_weight_kg) IS NULL THEN 'MISSING_QUANTITY' ELSE 'OK' END AS data_quality_flag,
       round(g.primary_value_usd, 2) AS val_yearfx_usd, round(g.nominal, 2) AS val_yearfx_brl,
       round(g.nominal / NULLIF(g.brl_per_eur_avg, 0), 2) AS val_yearfx_eur,
       round(CASE WHEN g.reference_year >= 1994 THEN g.primary_value_usd * g.brl_per_usd_avg * (g.ipca_current / NULLIF(g.ipca_year_end, 0)) END, 2) AS val_real_ipca_brl,
       round(CASE WHEN g.reference_year >= 1994 THEN g.primary_value_usd * g.brl_per_usd_avg * (g.igpm_current / NULLIF(g.igpm_year_end, 0)) END
             / NULLIF(g.brl_per_usd_current, 0), 2) AS val_real_igpm_usd,
       round(CASE WHEN g.reference_year >= 1994 THEN g.primary_value_usd * g.brl_per_usd_avg * (g.igpdi_current / NULLIF(g.igpdi_year_end, 0)) END
             / NULLIF(g.brl_per_eur_current, 0), 2) AS val_real_igpdi_eur,
       round(g.fob_value_usd, 2) AS val_fob_usd
FROM g LEFT JOIN nation rn ON g.reporter_code = CAST(rn.n_nationkey AS VARCHAR)
LEFT JOIN nation pn ON g.partner_code = CAST(pn.n_nationkey AS VARCHAR)
LEFT JOIN h ON g.cmd_code = h.cmd_code"""


ORACLE["comtrade_gold_pipeline"] = _comtrade_gold_sql()



def _survey_mart_sql(kind: str) -> str:
    gold = _survey_sql(rounded=False)
    def r(x: str) -> str:
        return f"round({x}, 2)" if kind == "mart" else x
    base = f"""
WITH {LOG_CTE},
gold AS ({gold}),
gated AS (SELECT * FROM gold WHERE product_code NOT IN (SELECT CAST(user_id AS VARCHAR) FROM hidden)),
cw AS (SELECT DISTINCT substr(p_brand, 7, 10) AS product_code,
              'grp_' || CAST(CAST(trunc((CAST(substr(p_brand, 7, 10) AS INTEGER) - 1) / 4) AS INTEGER) AS VARCHAR) AS group_id FROM part),
mart AS (
  SELECT reference_year, state_acronym, product_code, family, count(DISTINCT city_code) AS n_cities, count(*) AS source_rows,
         sum(qty_native) AS qty_native, sum({r('val_yearfx_brl')}) AS val_yearfx_brl, sum({r('val_real_ipca_brl')}) AS val_real_ipca_brl,
         sum({r('val_real_igpm_usd')}) AS val_real_igpm_usd
  FROM gated GROUP BY 1, 2, 3, 4)"""
    if kind == "mart":
        return base + """
SELECT m.reference_year, m.state_acronym, m.product_code, m.family, cw.group_id, m.n_cities, m.source_rows, m.qty_native,
       round(m.val_yearfx_brl, 2) AS val_yearfx_brl, round(m.val_real_ipca_brl, 2) AS val_real_ipca_brl,
       round(m.val_real_igpm_usd, 2) AS val_real_igpm_usd
FROM mart m LEFT JOIN cw ON m.product_code = cw.product_code"""
    return base + """,
a AS (SELECT sum(qty_native) AS q, sum(val_yearfx_brl) AS v1, sum(val_real_ipca_brl) AS v2, sum(val_real_igpm_usd) AS v3 FROM gated),
b AS (SELECT sum(qty_native) AS q, sum(val_yearfx_brl) AS v1, sum(val_real_ipca_brl) AS v2, sum(val_real_igpm_usd) AS v3 FROM mart)
SELECT 'crosswalk_unique' AS "check", 'error' AS severity,
       (SELECT count(*) FROM (SELECT product_code FROM cw GROUP BY 1 HAVING count(*) > 1)) AS n_failing
UNION ALL SELECT 'silver_conserved_in_gold', 'error', 0
UNION ALL SELECT 'mart_conserves_gated_gold', 'error',
       (SELECT count(*) FROM a, b WHERE abs(coalesce(a.q, 0) - coalesce(b.q, 0)) > 1e-6 * greatest(abs(coalesce(a.q, 0)), abs(coalesce(b.q, 0)), 1.0)
          OR abs(coalesce(a.v1, 0) - coalesce(b.v1, 0)) > 1e-6 * greatest(abs(coalesce(a.v1, 0)), abs(coalesce(b.v1, 0)), 1.0)
          OR abs(coalesce(a.v2, 0) - coalesce(b.v2, 0)) > 1e-6 * greatest(abs(coalesce(a.v2, 0)), abs(coalesce(b.v2, 0)), 1.0)
          OR abs(coalesce(a.v3, 0) - coalesce(b.v3, 0)) > 1e-6 * greatest(abs(coalesce(a.v3, 0)), abs(coalesce(b.v3, 0)), 1.0))
UNION ALL SELECT 'mart_grain_unique', 'error',
       (SELECT count(*) FROM (SELECT 1 FROM mart GROUP BY reference_year, state_acronym, product_code, family HAVING count(*) > 1))"""


ORACLE["survey_serving_mart"] = _survey_mart_sql("mart")
ORACLE["survey_mart_checks"] = _survey_mart_sql("checks")


def _with_levels(facts: str, group: str, value: str, qty: str) -> str:
    """The facts, their flag 'OK' replaced where an implied-price level holds."""
    return f"""
WITH f AS ({facts}),
d AS (
  SELECT *, {value} AS v, {qty} AS q, CASE WHEN {value} / NULLIF({qty}, 0) > 0 THEN ln({value} / NULLIF({qty}, 0)) END AS lp,
         CASE WHEN {value} > 0 THEN ln({value}) END AS lv, CASE WHEN {qty} > 0 THEN ln({qty}) END AS lq
  FROM f),
s AS (
  SELECT {group}, quantile_cont(lp, 0.5) AS mp, quantile_cont(lv, 0.5) AS mv, quantile_cont(lv, 0.75) AS pv,
         quantile_cont(lq, 0.5) AS mq, quantile_cont(lq, 0.75) AS pq, count(v / NULLIF(q, 0)) AS n FROM d GROUP BY ALL),
e AS (
  SELECT d.*, coalesce(v <= 0 OR q <= 0 OR mp IS NULL OR n < 10 OR v < 1000.0, true) AS guard, abs(lp - mp) AS dev,
         (lv - mv) / NULLIF(pv - mv, 0) AS vex, (lq - mq) / NULLIF(pq - mq, 0) AS qex
  FROM d LEFT JOIN s USING ({group}))
SELECT * EXCLUDE (v, q, lp, lv, lq, guard, dev, vex, qex) REPLACE (
  CASE WHEN data_quality_flag <> 'OK' OR guard THEN data_quality_flag
       WHEN dev >= ln(1.2) AND abs(vex) >= abs(qex) THEN 'PROBLEMATIC_VALUE'
       WHEN dev >= ln(1.2) AND abs(qex) > abs(vex) THEN 'PROBLEMATIC_QUANTITY'
       WHEN vex >= 1.5 THEN 'OUTLIER_VALUE' WHEN qex >= 1.5 THEN 'OUTLIER_QUANTITY' ELSE 'OK' END AS data_quality_flag)
FROM e"""


_SURVEY_MONEY = ["val_yearfx_brl", "val_yearfx_usd", "val_yearfx_eur", "val_real_ipca_brl", "val_real_ipca_usd", "val_real_igpm_brl", "val_real_igpdi_eur"]
_SURVEY_ROUNDED = ", ".join(f"round({c}, 2) AS {c}" for c in _SURVEY_MONEY)
ORACLE["survey_outlier_pipeline"] = f"""
SELECT * EXCLUDE (val_real_igpm_usd) REPLACE ({_SURVEY_ROUNDED})
FROM ({_with_levels(_survey_sql(rounded=False), 'product_code, family', 'val_real_ipca_brl', 'qty_native')})"""
# Trade values are whole dollars, so rounding leaves them as they are.
ORACLE["comex_outlier_pipeline"] = _with_levels(_comex_sql(), "flow, ncm_code", "val_fob_usd", "net_weight_kg")
ORACLE["comtrade_outlier_pipeline"] = _with_levels(_comtrade_gold_sql(), "flow, cmd_code", "val_yearfx_usd", "net_weight_kg")


# --- whole tables, where the SQL of the first twins above reads a slice -------

ORACLE["catalog_without_data_whole"] = f"""WITH {LOG_CTE}
SELECT user_id FROM cur WHERE active AND user_id NOT IN (SELECT o_custkey FROM orders)"""

ORACLE["new_codes_whole"] = "SELECT p_partkey AS code FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"

ORACLE["comex_by_partner_latest_whole"] = f"""
WITH f AS (SELECT c.c_nationkey AS partner, {YEAR} AS year, l.l_quantity AS qty, {REV} AS v
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
           WHERE l.l_returnflag IN ('A', 'N'))
SELECT partner, round(sum(v) / 100.0::DOUBLE, 2) AS value, sum(qty) AS weight FROM f
WHERE year = (SELECT max(year) FROM f) GROUP BY 1"""

ORACLE["codes_present_catalog_whole"] = f"""
WITH totals AS (SELECT p.p_brand AS product, sum({REV}) AS cents FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                WHERE l.l_returnflag = 'A' GROUP BY 1),
cat AS (SELECT p_brand AS product, max(p_name) AS name FROM part GROUP BY 1)
SELECT totals.product, cat.name, round(cents / 100.0::DOUBLE, 2) AS value FROM totals LEFT JOIN cat ON totals.product = cat.product"""

ORACLE["reconcile_cells_whole"] = """
WITH live AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
src AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS l_orderkey,
               CASE WHEN l_orderkey % 7 = 0 THEN qty + 1 ELSE qty END AS qty FROM live),
j AS (SELECT live.l_orderkey AS lk, src.l_orderkey AS sk, live.qty AS lv, src.qty AS sv
      FROM live FULL OUTER JOIN src ON live.l_orderkey = src.l_orderkey)
SELECT count(*) FILTER (WHERE lk IS NOT NULL AND sk IS NOT NULL) AS compared,
       count(*) FILTER (WHERE lk IS NOT NULL AND sk IS NOT NULL AND lv IS DISTINCT FROM sv) AS diverged,
       count(*) FILTER (WHERE lk IS NULL) AS only_source,
       count(*) FILTER (WHERE sk IS NULL) AS only_live
FROM j"""

ORACLE["export_unit_price_whole"] = f"""
WITH v AS (SELECT {YEAR} AS year, sum({REV}) AS cents, sum(l_quantity) AS weight FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT year, round(cents / 1e8, 2) AS value_musd, weight / 1e3 AS weight_kt,
       round((cents / 100.0::DOUBLE) / NULLIF(weight, 0), 6) AS unit_price
FROM v"""

ORACLE["resolved_scope_fallback_whole"] = "SELECT c_custkey AS code, 'configured' AS origin FROM customer"
ORACLE["domain_checks_whole"] = ORACLE["domain_checks"]
for _name in [k for k in ORACLE if k.endswith("_whole")]:
    ORACLE[_name.removesuffix("_whole")] = ORACLE[_name]

# The snapshot comparison, and beside it the delivery of all lines.
ORACLE["reconcile_cells"] = f"""
WITH live AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
src AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1),
j AS (SELECT live.l_orderkey AS lk, src.l_orderkey AS sk, live.qty AS lv, src.qty AS sv
      FROM live FULL OUTER JOIN src ON live.l_orderkey = src.l_orderkey),
snapshot AS (SELECT count(*) FILTER (WHERE lk IS NOT NULL AND sk IS NOT NULL) AS compared,
       count(*) FILTER (WHERE lk IS NOT NULL AND sk IS NOT NULL AND lv IS DISTINCT FROM sv) AS diverged,
       count(*) FILTER (WHERE lk IS NULL) AS only_source,
       count(*) FILTER (WHERE sk IS NULL) AS only_live
FROM j)
SELECT snapshot.*, d.compared AS delivery_compared, d.diverged AS delivery_diverged, d.only_source AS delivery_only_source,
       d.only_live AS delivery_only_live
FROM snapshot, ({ORACLE["reconcile_cells_whole"]}) d"""


# Loaded in steps, the result is that of the full build.
ORACLE["livestock_incremental"] = ORACLE["livestock_pipeline"]
ORACLE["comtrade_incremental"] = ORACLE["comtrade_pipeline"]
ORACLE["stream_affected_partitions"] = ORACLE["comtrade_pipeline"]
ORACLE["stream_batch_replacement"] = ORACLE["latest_batch"]
ORACLE["stream_scd2"] = ORACLE["scd2_timeline"]
ORACLE["stream_freshness"] = "SELECT CAST(ts AS DATE) AS day, event_type, max(ts) AS newest, count(*) AS n_rows FROM events GROUP BY 1, 2"


# --- annual marts ------------------------------------------------------------


def _mart_sql(gold: str, source: str, code: str, grain: str, labels: list[str], sums: list[str], values: list[str], states: bool, cities: bool) -> str:
    from strata.functions.columns import REGIONS, STATES

    width = {"comex": 8, "comtrade": 6}.get(source)
    form = lambda x: f"lpad({x}, {width}, '0')" if width else x
    brand = "substr(p_brand, 7)"
    aggs = [f"max({c}) AS {c}" for c in labels] + [f"round(sum({c}), 6) AS {c}" if c == "qty_base" else f"sum({c}) AS {c}" for c in sums] + [f"round(sum({c}), 2) AS {c}" for c in values]
    aggs += ["count(DISTINCT city_code) AS n_cities"] if cities else []
    abbrev = {n: a for n, a, _ in REGIONS}
    rows = ", ".join(f"('{a}', '{n}', '{r}', '{abbrev[r]}')" for a, n, r in ((a, n.replace("'", "''"), r) for a, n, r in STATES))
    return f"""
WITH {LOG_CTE},
gold AS ({gold}),
hid AS (SELECT {form('CAST(user_id AS VARCHAR)')} AS c FROM hidden),
m AS (SELECT {grain}, {', '.join(aggs)}, count(*) AS source_rows FROM gold WHERE {code} NOT IN (SELECT c FROM hid) GROUP BY {grain}),
b AS (SELECT DISTINCT {form(brand)} AS {code}, CAST(trunc((CAST({brand} AS INTEGER) - 1) / 4) AS INTEGER) AS g FROM part),
st AS (SELECT * FROM (VALUES {rows}) s(state_acronym, state_name, region, region_abbrev))
SELECT m.*, make_date(m.reference_year, 12, 31) AS reference_date, 'grp_' || b.g AS group_id, 'Group ' || b.g AS group_name
       {', st.state_name, st.region, st.region_abbrev' if states else ''}
FROM m LEFT JOIN b ON m.{code} = b.{code} {'LEFT JOIN st ON m.state_acronym = st.state_acronym' if states else ''}"""


_SURVEY_GRAIN = "reference_year, state_acronym, product_code, family"
_SURVEY_VALUES = ["val_yearfx_brl", "val_yearfx_usd", "val_real_ipca_brl", "val_real_igpdi_eur"]
ORACLE["crop_serving_mart"] = _mart_sql(ORACLE["crop_pipeline"], "pam", "product_code", _SURVEY_GRAIN, ["product_description", "base_unit", "unit_native"],
                                        ["qty_native", "qty_base", "area_planted_ha", "area_harvested_ha"], _SURVEY_VALUES, True, True)
ORACLE["livestock_serving_mart"] = _mart_sql(ORACLE["livestock_pipeline"], "ppm", "product_code", _SURVEY_GRAIN, ["product_description", "measure_kind", "base_unit", "unit_native"],
                                             ["qty_native", "qty_base"], _SURVEY_VALUES, True, True)
ORACLE["livestock_overview"] = f"""
SELECT reference_year, round(sum(CASE WHEN measure_kind = 'flow' THEN val_real_ipca_brl END), 2) AS value,
       sum(CASE WHEN measure_kind = 'stock' THEN qty_native END) AS heads, count(*) AS n_rows
FROM ({ORACLE["livestock_serving_mart"]}) GROUP BY 1"""
ORACLE["comex_serving_mart"] = _mart_sql(f"SELECT * REPLACE (CASE flow WHEN 'EXP' THEN 'export' ELSE 'import' END AS flow), val_fob_usd AS val_yearfx_usd FROM ({ORACLE['comex_pipeline']})", "comex", "ncm_code",
                                         "reference_year, flow, ncm_code, state_acronym, country_code, family", ["unit_native"],
                                         ["qty_native", "qty_base", "net_weight_kg", "freight_usd", "insurance_usd"],
                                         ["val_yearfx_usd", "val_yearfx_brl", "val_yearfx_eur", "val_real_ipca_brl"], True, False)
_COMTRADE_MART = _mart_sql(f"SELECT *, substr(reporter_name, 1, 3) AS reporter_iso_a3, substr(partner_name, 1, 3) AS partner_iso_a3 FROM ({ORACLE['comtrade_gold_pipeline']})",
                           "comtrade", "cmd_code", "reference_year, flow, customs_code, cmd_code, reporter_code, partner_code, family",
                           ["hs_chapter", "cmd_description", "reporter_name", "reporter_iso_a3", "partner_name", "partner_iso_a3", "unit_native"],
                           ["qty_native", "qty_base", "net_weight_kg"],
                           ["val_yearfx_usd", "val_yearfx_brl", "val_yearfx_eur", "val_real_ipca_brl", "val_real_igpdi_eur"], False, False)
ORACLE["comtrade_serving_mart"] = f"""
WITH e AS (SELECT 'C00' AS cc, CASE WHEN user_id % 2 = 0 THEN 'export' ELSE 'import' END AS fl, event_type, ts, event_id FROM events),
fm AS (SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cc, fl ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error')
SELECT x.*, fm.event_type AS market_nature FROM ({_COMTRADE_MART}) x LEFT JOIN fm ON x.customs_code = fm.cc AND x.flow = fm.fl"""
_METRICS = [  # metric, mart, measure, filter
    ("mdic_comex:exp_value", "cx", "val_yearfx_usd", "flow = 'export'"), ("mdic_comex:imp_value", "cx", "val_yearfx_usd", "flow = 'import'"),
    ("mdic_comex:exp_weight", "cx", "net_weight_kg", "flow = 'export'"),
    ("un_comtrade:exp_value", "ct", "val_yearfx_usd", "flow = 'export' AND reporter_iso_a3 = 'BRA'"),
    ("un_comtrade:imp_value", "ct", "val_yearfx_usd", "flow = 'import' AND reporter_iso_a3 = 'BRA'"),
    ("un_comtrade:partner_exp", "ct", "val_yearfx_usd", "flow = 'import' AND partner_iso_a3 = 'BRA'"),
    ("un_comtrade:world_exp", "ct", "val_yearfx_usd", "flow = 'export'")]
ORACLE["cross_metric_registry"] = f"WITH cx AS ({ORACLE['comex_serving_mart']}), ct AS ({_COMTRADE_MART}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, reference_year, round(sum({v}), 2) AS value FROM {f} WHERE {w} GROUP BY 2" for m, f, v, w in _METRICS)
ORACLE["product_registry"] = f"""
SELECT 'mdic_comex' AS source, ncm_code AS code, CAST(NULL AS VARCHAR) AS name, count(DISTINCT reference_year) AS n_years, round(sum(val_yearfx_usd), 2) AS value
FROM ({ORACLE['comex_serving_mart']}) GROUP BY 2
UNION ALL SELECT 'un_comtrade', cmd_code, max(cmd_description), count(DISTINCT reference_year), round(sum(val_yearfx_usd), 2) FROM ({_COMTRADE_MART}) GROUP BY 2"""
ORACLE["productivity_states"] = f"""
WITH m AS ({ORACLE['crop_serving_mart']}),
y AS (SELECT product_code, max(reference_year) AS reference_year FROM m GROUP BY 1),
s AS (SELECT product_code, reference_year, state_acronym, round(sum(qty_base) / NULLIF(sum(area_harvested_ha), 0), 6) AS yield_t_ha, sum(area_harvested_ha) AS area
      FROM m JOIN y USING (product_code, reference_year) GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY product_code ORDER BY yield_t_ha DESC NULLS LAST, state_acronym) AS INTEGER) AS rank FROM s"""


# The Gold facts have their outlier levels on.
ORACLE["survey_pipeline"] = ORACLE["survey_incremental"] = ORACLE["survey_outlier_pipeline"]
ORACLE["comex_pipeline"] = ORACLE["comex_outlier_pipeline"]
ORACLE["comtrade_gold_pipeline"] = ORACLE["comtrade_outlier_pipeline"]


ORACLE["product_top_states"] = f"""WITH {GOLD_CTE},
s AS (SELECT product, state, sum(value_cents) AS v, sum(qty) AS q FROM g GROUP BY 1, 2),
x AS (SELECT 'value' AS measure, product, state, v AS value FROM s UNION ALL SELECT 'heads', product, state, q FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY measure, product ORDER BY value DESC NULLS LAST, state) AS INTEGER) AS rank,
             round(value / sum(value) OVER (PARTITION BY measure, product), 6) AS share, count(*) OVER (PARTITION BY measure, product) AS n_members FROM x)
SELECT * FROM r WHERE rank <= 10"""
ORACLE["flow_top_links"] = f"""WITH {PARTNER_LINES},
l AS (SELECT reporter, partner, sum(v) AS v FROM pl GROUP BY 1, 2), t AS (SELECT sum(v) AS t FROM l)
SELECT reporter, partner, round(v / 100.0::DOUBLE, 2) AS value, round(v / t.t, 6) AS share FROM l, t ORDER BY v DESC, reporter, partner LIMIT 8"""


ORACLE["catalog_edit_validation"] = """
SELECT CASE WHEN n % 11 = 0 THEN 'code_not_digits' WHEN n % 13 = 0 THEN 'key_missing' WHEN n % 17 = 0 THEN 'code_too_long'
            WHEN n % 7 = 0 THEN 'unknown_source' WHEN n % 3 = 0 THEN 'unknown_ingestion' WHEN n % 5 = 0 THEN 'unknown_visibility'
            WHEN n % 19 = 0 THEN 'unknown_lifecycle' END AS rejected, count(*) AS n
FROM (SELECT p_partkey AS n FROM part) GROUP BY 1"""


# --- the five Gold tables ------------------------------------------------------
_LATER = "TIMESTAMP '2024-02-01 00:00:00'"
_GOLDS = [  # catalogue word, source, table, cadence, code, rows that came with the second delivery, facts
    ("pevs", "ibge_pevs", "gold_pevs_production", "annual", "product_code", "reference_year = 2001", "survey_pipeline"),
    ("pam", "ibge_pam", "gold_pam_production", "annual", "product_code", "reference_year = 1996", "crop_pipeline"),
    ("ppm", "ibge_ppm", "gold_ppm_production", "annual", "product_code", "false", "livestock_pipeline"),
    ("comex", "mdic_comex", "gold_comex_flows", "monthly", "ncm_code", "reference_year = 2001 AND flow = 'EXP'", "comex_pipeline"),
    ("comtrade", "un_comtrade", "gold_comtrade_flows", "annual", "cmd_code", "reference_year = 2001 AND reporter_code = '7'", "comtrade_gold_pipeline")]
_CODE_WIDTH = {"comex": 8, "comtrade": 6}
_form = lambda word, x: f"lpad({x}, {_CODE_WIDTH[word]}, '0')" if word in _CODE_WIDTH else x
_visible = lambda word, code: f"{code} NOT IN (SELECT {_form(word, 'CAST(user_id AS VARCHAR)')} FROM hidden)"
ORACLE["gold_source_metadata"] = f"WITH {LOG_CTE} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS source, '{table}' AS gold_table, '{cadence}' AS cadence, min(reference_year) AS year_start, max(reference_year) AS year_end,
       count(*) AS total_rows, count(DISTINCT {code}) AS products_total,
       {'CAST(NULL AS BIGINT)' if word == 'comtrade' else 'count(DISTINCT CASE WHEN state_name IS NOT NULL THEN state_acronym END)'} AS ufs_total,
       max(CASE WHEN {later} THEN {_LATER} ELSE TIMESTAMP '2024-01-01 00:00:00' END) AS last_refresh
FROM ({ORACLE[facts]}) WHERE {_visible(word, code)} HAVING count(*) > 0""" for word, name, table, cadence, code, later, facts in _GOLDS)
ORACLE["gold_quality_by_source"] = f"WITH {LOG_CTE}, f AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS source, data_quality_flag FROM ({ORACLE[facts]}) WHERE {_visible(word, code)}" for word, name, _, _, code, _, facts in _GOLDS) + """)
SELECT source, data_quality_flag, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM f GROUP BY 1, 2"""
ORACLE["gold_product_bridge"] = "WITH b AS (SELECT DISTINCT substr(p_brand, 7) AS b, CAST(trunc((CAST(substr(p_brand, 7) AS INTEGER) - 1) / 4) AS INTEGER) AS g FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 7 <> 0) " + " UNION ALL ".join(
    f"SELECT DISTINCT '{word}' AS source, {code} AS code, 'grp_' || g AS group_id, 'Group ' || g AS group_name FROM ({ORACLE[facts]}) JOIN b ON {code} = {_form(word, 'b')}"
    for word, _, _, _, code, _, facts in _GOLDS)
# One request after the other; pairs of parts do not touch each other's groups and names, so a step takes all pairs.
ORACLE["group_replay"] = """
WITH RECURSIVE pair AS (SELECT DISTINCT p_partkey // 2 AS c FROM part),
member AS (SELECT 'part_' || p_partkey AS g FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0),
ask AS (
  SELECT c, step, op, CASE who WHEN 'even' THEN 'part_' || 2 * c ELSE 'part_' || (2 * c + 1) END AS g,
         CASE word WHEN 'odd' THEN 'part ' || (2 * c + 1) WHEN 'even' THEN 'part ' || 2 * c WHEN 'another' THEN 'another ' || (2 * c + 1) END AS name
  FROM pair, (VALUES (1, 'create', 'odd', 'odd'), (2, 'rename', 'even', 'odd'), (3, 'delete', 'odd', NULL), (4, 'rename', 'even', 'odd'),
                     (5, 'create', 'odd', 'odd'), (6, 'create', 'odd', 'another'), (7, 'delete', 'even', NULL), (8, 'create', 'even', 'even')) v(step, op, who, word)
  WHERE (c + step) % 11 <> 0),
start AS (SELECT p_partkey // 2 AS c, max(CASE WHEN p_partkey % 2 = 0 THEN 'part ' || p_partkey END) AS even_name,
                 max(CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'part ' || p_partkey END) AS odd_name FROM part GROUP BY 1),
run AS (
  SELECT c, 0 AS step, even_name, odd_name, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS reason FROM start
  UNION ALL
  SELECT c, step, CASE WHEN reason IS NULL AND mine = 'even' THEN to_name ELSE even_name END, CASE WHEN reason IS NULL AND mine = 'odd' THEN to_name ELSE odd_name END, op, g, reason
  FROM (
    SELECT r.c, r.step + 1 AS step, r.even_name, r.odd_name, a.op, a.g, CASE WHEN a.op <> 'delete' THEN a.name END AS to_name,
           CASE WHEN a.g = 'part_' || 2 * r.c THEN 'even' WHEN a.g IS NOT NULL THEN 'odd' ELSE 'none' END AS mine,
           CASE WHEN a.op IS NULL THEN 'skipped'
                WHEN a.op = 'create' AND CASE WHEN a.g = 'part_' || 2 * r.c THEN r.even_name ELSE r.odd_name END IS NOT NULL THEN 'exists'
                WHEN a.op <> 'create' AND CASE WHEN a.g = 'part_' || 2 * r.c THEN r.even_name ELSE r.odd_name END IS NULL THEN 'not_found'
                WHEN a.op <> 'delete' AND CASE WHEN a.g = 'part_' || 2 * r.c THEN r.odd_name ELSE r.even_name END = a.name THEN 'name_taken'
                WHEN a.op = 'delete' AND a.g IN (SELECT g FROM member) THEN 'has_members' END AS reason
    FROM run r LEFT JOIN ask a ON a.c = r.c AND a.step = r.step + 1 WHERE r.step < 8))
SELECT CAST(c * 10 + step AS BIGINT) AS seq, op, g AS group_id, reason FROM run WHERE op IS NOT NULL"""


def all_sql() -> dict[str, str]:
    return dict(ORACLE)
