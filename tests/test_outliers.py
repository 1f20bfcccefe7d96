"""Every Gold fact carries the implied-price levels by default."""

import pytest

import __spark_entry__ as E

LEVELS = {"PROBLEMATIC_VALUE", "PROBLEMATIC_QUANTITY", "OUTLIER_VALUE", "OUTLIER_QUANTITY"}


@pytest.mark.parametrize("name", ["survey_pipeline", "comex_pipeline", "comtrade_gold_pipeline"])
def test_gold_facts_have_every_level(spark, name):
    facts = E.queries()[name](spark, "/root/testdata/sf0.01")
    flags = {r.data_quality_flag for r in facts.select("data_quality_flag").distinct().collect()}
    assert LEVELS | {"OK"} <= flags
