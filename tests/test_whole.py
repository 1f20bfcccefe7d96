"""Twins over whole tables report no code that has data in any year."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
# SQL of what each twin must not do: rows it would wrongly return, or miss
PROBES = {
    "catalog_without_data_whole": ("user_id", "SELECT o_custkey FROM read_parquet('{}/orders.parquet')"),
    "new_codes_whole": ("code", "SELECT l_partkey FROM read_parquet('{}/lineitem.parquet')"),
}


@pytest.mark.parametrize("name", sorted(PROBES))
def test_no_code_with_data_is_reported(spark, name):
    col, sql = PROBES[name]
    have = {r[0] for r in duckdb.sql(sql.format(SF)).fetchall()}
    got = {r[col] for r in E.queries()[name](spark, SF).collect()}
    again = {r[col] for r in E.queries()[name.removesuffix("_whole")](spark, SF).collect()}
    assert not got & have and again == got


def test_configured_scope_is_every_customer(spark):
    n = duckdb.sql(f"SELECT count(*) FROM read_parquet('{SF}/customer.parquet')").fetchall()[0][0]
    assert E.queries()["resolved_scope_fallback_whole"](spark, SF).count() == n


def test_only_codes_without_any_rows_are_new(tmp_path, spark):
    duckdb.sql("SELECT * FROM (VALUES (1::BIGINT), (2), (3)) t(p_partkey)").write_parquet(str(tmp_path / "part.parquet"))
    duckdb.sql("SELECT * FROM (VALUES (1::BIGINT, TIMESTAMP '1995-05-01'), (2, TIMESTAMP '1997-05-01')) t(l_partkey, l_shipdate)").write_parquet(
        str(tmp_path / "lineitem.parquet"))
    assert [r.code for r in E.queries()["new_codes_whole"](spark, str(tmp_path)).collect()] == [3]
