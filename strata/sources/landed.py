"""Readers for landed source files (survey A06-A13, A33-A35).

Everything is read with an explicit schema (codes stay strings: leading
zeros matter) and every transformation is a DataFrame expression, so a
large extract is split and scanned in parallel instead of being converted
in driver-side chunks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";",
                   encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """``;``-separated Latin-1 text with every column as a string."""
    return (spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
            .option("mode", "PERMISSIVE").schema(all_string_schema(columns)).csv(path))


def union_schemas(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scope_filter(code_col: str, exact: Sequence[str] = (), headings: Sequence[str] = (),
                 chapters: Sequence[str] = ()) -> F.Column:
    """8-digit codes, or 4-digit headings, or 2-digit chapters."""
    c = F.col(code_col)
    cond = F.lit(False)
    if exact:
        cond = cond | c.isin(list(exact))
    if headings:
        cond = cond | F.substring(c, 1, 4).isin(list(headings))
    if chapters:
        cond = cond | F.substring(c, 1, 2).isin(list(chapters))
    return cond


def normalise_header(name: str) -> str:
    """A10: lower case, accents stripped, non-alphanumerics to ``_``, collapsed."""
    s = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    s = re.sub(r"[^a-z0-9]+", "_", s)
    return re.sub(r"_+", "_", s).strip("_")


def header_row_payload(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """JSON arrays of objects whose first element is the header.

    Each file holds ``[{"V": "Valor", ...}, {"V": "12", ...}, ...]``.  Every row
    is a map whose keys are renamed by the header of its own file, so files may
    name or order their keys differently; a payload with a header alone, or
    none, has no rows.  A file is one response of the source, a bounded chunk.

    ``columns`` are the normalised names to return (a name that a file lacks is
    NULL there); without them, all names found are looked up first."""
    payload = F.from_json("value", "array<map<string,string>>")
    files = spark.read.text(path, wholetext=True).select(payload.alias("rows")).filter(F.size("rows") > 1)
    names = F.transform_values(F.get("rows", F.lit(0)), lambda k, v: normal_name(F.coalesce(v, k)))
    renamed = files.select(names.alias("names"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row")).select(
        F.transform_keys("row", lambda k, _: F.coalesce(F.col("names")[k], normal_name(k))).alias("row"))
    if columns is None:
        columns = sorted(r["k"] for r in renamed.select(F.explode(F.map_keys("row")).alias("k")).distinct().collect())
    return renamed.select(*[F.col("row")[c].alias(c) for c in columns])


def normal_name(c: F.Column) -> F.Column:
    """A10 as a column: lower case, accents stripped, other runs to one underscore."""
    folded = F.translate(F.lower(c), "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, r"[^\x00-\x7f]", ""), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def series_payload(spark: SparkSession, path: str, series_code: str, label_cols: dict[str, str] | None = None) -> DataFrame:
    """``[{"data": "dd/mm/yyyy", "valor": "x"}, ...]`` -> typed-as-string rows
    tagged with the series code and label columns."""
    schema = T.StructType([T.StructField("data", T.StringType()), T.StructField("valor", T.StringType())])
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    df = df.select(F.lit(series_code).alias("series_code"), F.col("data").alias("reference_date_str"),
                   F.col("valor").alias("value_str"))
    for k, v in (label_cols or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df


def canonical_int_code(c: str) -> F.Column:
    """``'12.0'`` -> ``'12'``, ``'-1.0'`` -> ``'-1'``; other text kept."""
    return F.regexp_replace(F.col(c), r"^(-?\d+)\.0$", "$1")


def trade_payload(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``{"data": [ {...}, ... ]}`` -> fixed string columns, integer-like
    codes canonicalised."""
    item = all_string_schema(columns)
    schema = T.StructType([T.StructField("data", T.ArrayType(item))])
    df = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("data").alias("r")).select("r.*")
    return df.select(*[canonical_int_code(c).alias(c) for c in columns])


def flatten_mesh(df: DataFrame, mapping: dict[str, tuple[str, ...]], min_rows: int | None = None) -> DataFrame:
    """Nested records -> wide row; each output column takes the first
    non-null of its candidate paths (branch fallback).  A short result is
    refused by the query itself, when it runs: nothing is counted beforehand."""
    out = df.select(*[F.coalesce(*[F.col(p) for p in paths]).alias(name) for name, paths in mapping.items()])
    if min_rows is None:
        return out
    n = out.agg(F.count(F.lit(1)).alias("_n"))
    short = F.raise_error(F.concat(F.lit("refusing a short result: "), F.col("_n").cast("string"), F.lit(f" < {min_rows} rows")))
    held = n.select(F.when(F.col("_n") < min_rows, short.cast("boolean")).otherwise(True).alias("_enough"))
    return out.crossJoin(F.broadcast(held)).filter("_enough").drop("_enough")  # one row


def write_csv_export(df: DataFrame, path: str) -> None:
    """Inventory export as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
