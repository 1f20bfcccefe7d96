"""Scalar ``Column -> Column`` functions (survey B01-B44).

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none touches a session or does I/O.  The session runs
with ANSI mode on, so every parse or division uses a ``try_*`` form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's vocabulary for identical results)
# ---------------------------------------------------------------------------
# "No data" sentinels that read as NULL.
MISSING_SENTINELS = ["...", "..", "*", "X"]

# Federative units: acronym, name, macro-region.
STATES = [
    ("AC", "Acre", "Norte"),
    ("AL", "Alagoas", "Nordeste"),
    ("AP", "Amapá", "Norte"),
    ("AM", "Amazonas", "Norte"),
    ("BA", "Bahia", "Nordeste"),
    ("CE", "Ceará", "Nordeste"),
    ("DF", "Distrito Federal", "Centro-Oeste"),
    ("ES", "Espírito Santo", "Sudeste"),
    ("GO", "Goiás", "Centro-Oeste"),
    ("MA", "Maranhão", "Nordeste"),
    ("MT", "Mato Grosso", "Centro-Oeste"),
    ("MS", "Mato Grosso do Sul", "Centro-Oeste"),
    ("MG", "Minas Gerais", "Sudeste"),
    ("PA", "Pará", "Norte"),
    ("PB", "Paraíba", "Nordeste"),
    ("PR", "Paraná", "Sul"),
    ("PE", "Pernambuco", "Nordeste"),
    ("PI", "Piauí", "Nordeste"),
    ("RJ", "Rio de Janeiro", "Sudeste"),
    ("RN", "Rio Grande do Norte", "Nordeste"),
    ("RS", "Rio Grande do Sul", "Sul"),
    ("RO", "Rondônia", "Norte"),
    ("RR", "Roraima", "Norte"),
    ("SC", "Santa Catarina", "Sul"),
    ("SP", "São Paulo", "Sudeste"),
    ("SE", "Sergipe", "Nordeste"),
    ("TO", "Tocantins", "Norte"),
]

# Macro-region: abbreviation and official code.
REGIONS = [
    ("Norte", "N", 1),
    ("Nordeste", "NE", 2),
    ("Sudeste", "SE", 3),
    ("Sul", "S", 4),
    ("Centro-Oeste", "CO", 5),
]

# Month names and abbreviations (Portuguese), January first.
MONTH_NAMES = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]
MONTH_ABBR = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]

# Lifecycle vocabulary: legacy prose -> visibility code, and the defaults.
LEGACY_HIDDEN_PROSE = "Fazer Ingestão mas deixar indisponível"
LEGACY_VISIBLE_PROSE = "Fazer Ingestão e deixar disponível"
DEFAULT_VISIBILITY = "visivel"
HIDDEN_VISIBILITY = "oculto"
DEFAULT_INGESTION = "ativa"

# Concentration bands: HHI above 2500 high / above 1500 moderate; Gini above 0.6 / 0.4.
HHI_BANDS = (1500.0, 2500.0)
GINI_BANDS = (0.4, 0.6)

# Boundary-year currency correction: year 1985, unit label 'mil cruzeiros', factor 1000.
CRUZADO_YEAR, CRUZADO_UNIT, CRUZADO_FACTOR = 1985, "mil cruzeiros", 1000.0

# A well-formed decimal number after sentinel handling and comma -> dot.
_NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wtrim(c) -> Column:
    """Trim all leading/trailing white space (``trim`` alone keeps tabs).

    A line separator at the end is not white space, but space before it goes too."""
    by_pattern = F.regexp_replace(F.regexp_replace(_c(c), r"^\s+", ""), r"\s+$", "")
    return F.when(F.right(_c(c), F.lit(1)).isin("\u0085", "\u2028", "\u2029"), by_pattern).otherwise(F.trim(_c(c), F.lit(" \t\n\x0b\f\r")))


def safe_numeric(c, dash_is_zero: bool = False) -> Column:
    """Text -> double; sentinels, blanks and junk -> NULL.

    ``dash_is_zero`` maps a lone ``-`` to an exact 0.0 (measured zero);
    otherwise ``-`` is missing too.  Decimal comma becomes a dot.  Text that
    is not a plain decimal number (``1d``, ``NaN``, ``Infinity``) is NULL,
    which ``try_cast`` alone would accept.
    """
    t = wtrim(c)
    missing = (t == "") | t.isin(MISSING_SENTINELS)
    if not dash_is_zero:
        missing = missing | (t == "-")
    s = F.replace(t, F.lit(","), F.lit("."))
    parsed = F.when(s.rlike(_NUMBER_RE), s.try_cast("double"))
    if dash_is_zero:
        parsed = F.when(t == "-", F.lit(0.0)).otherwise(parsed)
    return F.when(~missing, parsed)


def zero_as_missing(c) -> Column:
    """0 -> NULL (a zero weight or quantity means 'not reported')."""
    return F.nullif(_c(c), F.lit(0))


def safe_date(c, fmt: str = "dd/MM/yyyy") -> Column:
    """Strict date parse; bad text -> NULL."""
    return F.try_to_date(_c(c), fmt)


def safe_date_from_parts(y, m, d=1) -> Column:
    """Date from parts; an impossible date -> NULL (``make_date`` throws)."""
    d = F.lit(d) if isinstance(d, int) else _c(d)
    return F.to_date(F.try_make_timestamp(_c(y), _c(m), d, F.lit(0), F.lit(0), F.lit(0)))


def year_end_date(y) -> Column:
    """Dec-31 of the year."""
    return safe_date_from_parts(y, F.lit(12), 31)


def month_name_pt(m) -> Column:
    """Month number -> Portuguese name."""
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), _c(m).cast("int"))


def month_abbr_pt(m) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_ABBR]), _c(m).cast("int"))


def split_name_state(c) -> tuple[Column, Column]:
    """``'Name - UF'`` -> (name, UF); no match gives NULL UF."""
    col = _c(c)
    name = F.trim(F.regexp_replace(col, r"\s-\s[A-Z]{2}$", ""))
    uf = F.nullif(F.regexp_extract(col, r"\s-\s([A-Z]{2})$", 1), F.lit(""))
    return name, uf


def strip_code_prefix(c) -> Column:
    """Drop a leading hierarchical code ``'1.2 - '`` from a description."""
    return F.trim(F.regexp_replace(_c(c), r"^([^-]+)\s-\s", ""))


def norm_key(c) -> Column:
    """Join-key normalisation."""
    return F.lower(wtrim(c))


def cruzado_factor(year, unit) -> Column:
    """x1000 for the documented boundary year/unit only."""
    return F.when(
        (_c(year) == CRUZADO_YEAR) & (norm_key(unit) == CRUZADO_UNIT), F.lit(CRUZADO_FACTOR)
    ).otherwise(F.lit(1.0))


def chapter(code) -> Column:
    """First two characters of a product code."""
    return F.substring(_c(code), 1, 2)


def flow_name(code, mapping: dict[str, str] | None = None) -> Column:
    """Raw flow code -> 'export' / 'import'; others NULL (then dropped)."""
    mapping = mapping or {"X": "export", "M": "import"}
    expr = None
    for k, v in mapping.items():
        expr = F.when(_c(code) == k, F.lit(v)) if expr is None else expr.when(_c(code) == k, F.lit(v))
    return expr


def safe_divide(a, b) -> Column:
    """A / b, NULL when b is 0 or NULL."""
    return F.try_divide(_c(a), _c(b))


def safe_ln(x) -> Column:
    """ln(x), NULL for x <= 0."""
    return F.when(_c(x) > 0, F.ln(_c(x)))


def _looked_up(c, pairs) -> Column:
    """Value of a key from a constant map (NULL for others): one short lookup, where a chain of
    conditions makes the generated code of a wide Gold too long to be compiled."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), _c(c))


def state_name(uf) -> Column:
    """Acronym -> state name (NULL for pseudo-codes)."""
    return _looked_up(uf, [(acr, name) for acr, name, _ in STATES])


def state_region(uf) -> Column:
    return _looked_up(uf, [(acr, region) for acr, _, region in STATES])


def region_abbrev(region) -> Column:
    """B24."""
    expr = None
    for name, ab, _ in REGIONS:
        expr = F.when(_c(region) == name, F.lit(ab)) if expr is None else expr.when(_c(region) == name, F.lit(ab))
    return expr


def region_code(region) -> Column:
    expr = None
    for name, _, code in REGIONS:
        expr = F.when(_c(region) == name, F.lit(code)) if expr is None else expr.when(_c(region) == name, F.lit(code))
    return expr


def quality_flag_basic(qty, val) -> Column:
    """Four-value completeness flag."""
    q, v = _c(qty), _c(val)
    return (
        F.when(q.isNotNull() & v.isNotNull(), "OK")
        .when(q.isNotNull() & v.isNull(), "MISSING_VALUE")
        .when(q.isNull() & v.isNotNull(), "MISSING_QUANTITY")
        .otherwise("INCOMPLETE")
    )


def quality_flag(qty, val, qty_level=None, val_level=None) -> Column:
    """Eight-value flag, precedence missing > problematic value >
    problematic quantity > outlier value > outlier quantity > OK."""
    q, v = _c(qty), _c(val)
    ql = _c(qty_level) if qty_level is not None else F.lit(None).cast("string")
    vl = _c(val_level) if val_level is not None else F.lit(None).cast("string")
    return (
        F.when(q.isNull() & v.isNull(), "INCOMPLETE")
        .when(v.isNull(), "MISSING_VALUE")
        .when(q.isNull(), "MISSING_QUANTITY")
        .when(vl == "problematic", "PROBLEMATIC_VALUE")
        .when(ql == "problematic", "PROBLEMATIC_QUANTITY")
        .when(vl == "outlier", "OUTLIER_VALUE")
        .when(ql == "outlier", "OUTLIER_QUANTITY")
        .otherwise("OK")
    )


def trade_quality_flag(weight, val, qty_level=None, val_level=None) -> Column:
    """Weight-based trade flag (MISSING_WEIGHT instead of quantity)."""
    w, v = _c(weight), _c(val)
    ql = _c(qty_level) if qty_level is not None else F.lit(None).cast("string")
    vl = _c(val_level) if val_level is not None else F.lit(None).cast("string")
    return (
        F.when(w.isNull() & v.isNull(), "INCOMPLETE")
        .when(v.isNull(), "MISSING_VALUE")
        .when(w.isNull(), "MISSING_WEIGHT")
        .when(vl == "problematic", "PROBLEMATIC_VALUE")
        .when(ql == "problematic", "PROBLEMATIC_QUANTITY")
        .when(vl == "outlier", "OUTLIER_VALUE")
        .when(ql == "outlier", "OUTLIER_QUANTITY")
        .otherwise("OK")
    )


def stock_quality_flag(measure_kind, qty, val, qty_level=None, val_level=None) -> Column:
    """A stock row (herd) has no value by nature, so only quantity counts."""
    q = _c(qty)
    return F.when(
        _c(measure_kind) == "stock", F.when(q.isNotNull(), "OK").otherwise("MISSING_QUANTITY")
    ).otherwise(quality_flag(qty, val, qty_level, val_level))


def area_consistency_flag(planted, harvested, flag) -> Column:
    """Planted < harvested overrides everything."""
    return F.when(_c(planted) < _c(harvested), F.lit("AREA_INCONSISTENT")).otherwise(_c(flag))


def visibility_effective(visibility, lifecycle_prose) -> Column:
    """Stored code -> legacy prose -> default 'visivel' (unknown never hides)."""
    legacy = F.when(_c(lifecycle_prose) == LEGACY_HIDDEN_PROSE, F.lit(HIDDEN_VISIBILITY)).when(
        _c(lifecycle_prose) == LEGACY_VISIBLE_PROSE, F.lit(DEFAULT_VISIBILITY)
    )
    return F.coalesce(_c(visibility), legacy, F.lit(DEFAULT_VISIBILITY))


def ingestion_effective(ingestion) -> Column:
    """NULL ingestion predates the axis and reads as 'ativa'."""
    return F.coalesce(_c(ingestion), F.lit(DEFAULT_INGESTION))


def slug(c) -> Column:
    """ASCII slug of a display name."""
    folded = F.translate(
        F.lower(_c(c)),
        "áàâãäéèêëíìîïóòôõöúùûüçñ",
        "aaaaaeeeeiiiiooooouuuucn",
    )
    return F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def hhi_band(h) -> Column:
    """B42."""
    lo, hi = HHI_BANDS
    return F.when(_c(h) > hi, "alta concentração").when(_c(h) > lo, "concentração moderada").otherwise(
        "baixa concentração"
    )


def gini_band(g) -> Column:
    lo, hi = GINI_BANDS
    return F.when(_c(g) > hi, "muito desigual").when(_c(g) > lo, "desigual").otherwise(
        "relativamente uniforme"
    )


def choropleth_bucket(v, vmax, steps: int) -> Column:
    """Linear bucket 0..steps-1 of v against the max (1 at least); a v above the max
    is in the last one, v <= 0 is 'no data'."""
    share = F.least(F.lit(1.0), _c(v) / F.greatest(_c(vmax).cast("double"), F.lit(1.0)))
    return F.when(
        _c(v) > 0, F.least(F.lit(steps - 1), F.floor(share * F.lit(steps - 1) + F.lit(1e-9))).cast("int")
    )


def display_scale(family, qty) -> tuple[Column, Column]:
    """Display-scaled quantity and its unit label by family."""
    fam = _c(family)
    scaled = (
        F.when(fam == "massa", _c(qty) / 1e3)
        .when(fam == "volume", _c(qty) / 1e6)
        .when(fam == "contagem", _c(qty) / 1e6)
        .otherwise(_c(qty))
    )
    unit = (
        F.when(fam == "massa", "mil t")
        .when(fam == "volume", "milhões m³")
        .when(fam == "contagem", "milhões un")
        .otherwise(F.lit(None).cast("string"))
    )
    return scaled, unit


def is_canonical_state(state_name_col) -> Column:
    """Real states only (pseudo-codes have no name)."""
    return _c(state_name_col).isNotNull()


def normalise_region(c) -> Column:
    """A region given by code (N, NE, ...) or display name -> display
    name; anything else is kept as given."""
    col = _c(c)
    expr = None
    for name, ab, _ in REGIONS:
        cond = (F.upper(wtrim(col)) == ab) | (F.lower(wtrim(col)) == name.lower())
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(col)
