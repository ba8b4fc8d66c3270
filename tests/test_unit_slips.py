"""The resolution query ranks slips of every unit's name, not of a few."""

from dossierlake import catalog

SF = "/root/testdata/sf0.001"


def test_slips_of_all_units_are_ranked(spark):
    rows = catalog.queries()["b4_unit_resolution"](spark, SF).select("mention_id", "method").collect()
    slips = [(int(unit), r["method"]) for r in rows for order, unit in [r["mention_id"].split("/")] if int(order) % 7 == 2 and int(order) % 6]  # those without a code
    assert len({u for u, _ in slips if u >= 60}) > 20
    assert {m for _, m in slips} <= {"HYBRID_RANKING", "HYBRID_FUZZY_BM25_SEMANTIC"}
