"""Reference seeds (survey A13) as small, explicitly typed DataFrames.

Seeds are bounded lookup tables (a few dozen rows each).  ``seed_frame``
checks the row count it is given and marks the seed for broadcast, so a
join with a fact of any size never shuffles the fact for a lookup.  Larger seeds (country and
product lists of hundreds of rows) are read from CSV with an explicit
schema by ``read_seed_csv``; codes are always strings (leading zeros).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The reference's seed rows, in file order.
# ---------------------------------------------------------------------------
# historical_currency_factors: unit_of_measure, year_from, year_to, brl_factor
HISTORICAL_CURRENCY_FACTORS = [
    ("Mil Cruzeiros", 1942, 1966, 0.0000000000003636363636363636),
    ("Mil Cruzeiros Novos", 1967, 1969, 0.0000000003636363636363636),
    ("Mil Cruzeiros", 1970, 1985, 0.0000000003636363636363636),
    ("Mil Cruzados", 1986, 1988, 0.0000003636363636363636),
    ("Mil Cruzados Novos", 1989, 1989, 0.0003636363636363636),
    ("Mil Cruzeiros", 1990, 1992, 0.0003636363636363636),
    ("Mil Cruzeiros Reais", 1993, 1993, 0.36363636363636365),
    ("Mil Reais", 1994, 2099, 1000.0),
]

# unit_family_conversions: unit_raw, family, base_unit, to_base (None = product-specific)
UNIT_FAMILY_CONVERSIONS = [
    ("t", "massa", "t", 1.0),
    ("toneladas", "massa", "t", 1.0),
    ("tonelada", "massa", "t", 1.0),
    ("tonelada metrica liquida", "massa", "t", 1.0),
    ("kg", "massa", "t", 0.001),
    ("quilograma liquido", "massa", "t", 0.001),
    ("quilograma bruto", "massa", "t", 0.001),
    ("quilogramas", "massa", "t", 0.001),
    ("grama liquido", "massa", "t", 0.000001),
    ("g", "massa", "t", 0.000001),
    ("quilate", "massa", "t", 0.0000002),
    ("saca", "massa", "t", None),
    ("@", "massa", "t", None),
    ("arroba", "massa", "t", None),
    ("bushel", "massa", "t", None),
    ("m³", "volume", "m³", 1.0),
    ("metros cúbicos", "volume", "m³", 1.0),
    ("metro cubico", "volume", "m³", 1.0),
    ("l", "volume", "m³", 0.001),
    ("litro", "volume", "m³", 0.001),
    ("mil litros", "volume", "m³", 1.0),
    ("hl", "volume", "m³", 0.1),
    ("barril", "volume", "m³", None),
    ("mwh", "energia", "MWh", 1.0),
    ("mil quilowatt hora", "energia", "MWh", 1.0),
    ("kwh", "energia", "MWh", 0.001),
    ("gj", "energia", "MWh", 0.277778),
    ("boe", "energia", "MWh", 1.62803),
    ("un", "contagem", "un", 1.0),
    ("unidade", "contagem", "un", 1.0),
    ("numero (unidade)", "contagem", "un", 1.0),
    ("dúzia", "contagem", "un", 12.0),
    ("duzia", "contagem", "un", 12.0),
    ("mil dúzias", "contagem", "un", 12000.0),
    ("mil duzias", "contagem", "un", 12000.0),
    ("milheiro", "contagem", "un", 1000.0),
    ("cabeça", "contagem", "un", 1.0),
    ("cabeças", "contagem", "un", 1.0),
    ("pares", "contagem", "un", 2.0),
    ("ha", "area", "ha", 1.0),
    ("m²", "area", "ha", 0.0001),
    ("metro quadrado", "area", "ha", 0.0001),
    ("alqueire", "area", "ha", 2.42),
]

# product_unit_factors: source, product_code, unit_raw, family, base_unit, to_base
PRODUCT_UNIT_FACTORS = [
    ("_reference", "cafe", "saca", "massa", "t", 0.06),
    ("_reference", "boi", "@", "massa", "t", 0.015),
    ("_reference", "soja", "bushel", "massa", "t", 0.0272155),
    ("_reference", "milho", "bushel", "massa", "t", 0.0254),
    ("_reference", "petroleo", "barril", "volume", "m³", 0.158987),
]

CURRENCY_FACTOR_SCHEMA = T.StructType([
    T.StructField("unit_of_measure", T.StringType()),
    T.StructField("year_from", T.IntegerType()),
    T.StructField("year_to", T.IntegerType()),
    T.StructField("brl_factor", T.DoubleType()),
])
UNIT_FAMILY_SCHEMA = T.StructType([
    T.StructField("unit_raw", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("base_unit", T.StringType()),
    T.StructField("to_base", T.DoubleType()),
])
PRODUCT_UNIT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("unit_raw", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("base_unit", T.StringType()),
    T.StructField("to_base", T.DoubleType()),
])
SUCCESSION_SCHEMA = T.StructType([
    T.StructField("reported_code", T.StringType()),
    T.StructField("current_code", T.StringType()),
    T.StructField("note", T.StringType()),
])


SEED_ROW_LIMIT = 100_000


def seed_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A seed built from rows held on the driver.  Its row count is known
    here, so the broadcast hint is attached only when it is within
    ``SEED_ROW_LIMIT`` (the size check); a larger list stays a shuffle side."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= SEED_ROW_LIMIT else df


def currency_factors(spark: SparkSession, rows=None) -> DataFrame:
    return seed_frame(spark, rows or HISTORICAL_CURRENCY_FACTORS, CURRENCY_FACTOR_SCHEMA)


def unit_families(spark: SparkSession, rows=None) -> DataFrame:
    return seed_frame(spark, rows or UNIT_FAMILY_CONVERSIONS, UNIT_FAMILY_SCHEMA)


def product_unit_factors(spark: SparkSession, rows=None) -> DataFrame:
    return seed_frame(spark, rows or PRODUCT_UNIT_FACTORS, PRODUCT_UNIT_SCHEMA)


def read_seed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A seed CSV with an explicit all-typed schema (no inference)."""
    return spark.read.option("header", True).schema(schema).csv(path)
