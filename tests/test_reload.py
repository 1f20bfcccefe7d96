"""Which scopes are loaded into Bronze again."""

from strata.operators.incremental import reload_decision


def test_reload_when_extracted_never_loaded_or_filter_changed(spark):
    current = spark.createDataFrame(
        [("EXP", 2000, False, "a"), ("EXP", 2001, True, "a"), ("EXP", 2002, False, "a"), ("EXP", 2003, False, "b"),
         ("EXP", 2004, False, "a"), ("EXP", 2005, False, "a"), ("IMP", 2005, True, "a"), ("IMP", 2000, None, "a")],
        "flow string, year int, extracted boolean, fingerprint string")
    manifest = spark.createDataFrame(
        [("EXP", 2000, True, "a"), ("EXP", 2001, True, "a"), ("EXP", 2002, False, "a"), ("EXP", 2003, True, "a"),
         ("EXP", 2004, True, None), ("IMP", 2000, True, "a")],
        "flow string, year int, loaded boolean, fingerprint string")
    got = {(r.flow, r.year): r.reload for r in reload_decision(current, manifest, ["flow", "year"]).collect()}
    assert got == {
        ("EXP", 2000): False,  # loaded under the same filter
        ("EXP", 2001): True,  # extracted
        ("EXP", 2002): True,  # archived, never loaded
        ("EXP", 2003): True,  # filter changed
        ("EXP", 2004): True,  # fingerprint not recorded
        ("EXP", 2005): False,  # nothing archived
        ("IMP", 2005): True,  # extracted for the first time
        ("IMP", 2000): False}
