"""The units of candidates are joined once a list, not once a mention."""

from dossierlake.operators import persons
from dossierlake.plans import resolution
from dossierlake.plans.base import Tables


def test_lists_meet_units_once(spark, monkeypatch):
    asked = []
    real = persons._with_units
    monkeypatch.setattr(persons, "_with_units", lambda listed, people, units: (asked.append(listed), real(listed, people, units))[1])
    rows = resolution.j13_candidate_units(Tables(spark, "/root/testdata/sf0.001")).count()
    lists = [x.select("of").distinct().count() for x in asked]
    assert len(lists) == 2 and sum(lists) < rows
