"""Units against a slow walk through the conversions, and in inventories of new sectors."""

import itertools
import random

import pytest
from small import iot

from sectora.functions import units
from sectora.operators import sectors
from sectora.schema import WrongInput


def frame(spark, rows):
    return spark.createDataFrame(rows, units.CONVERSIONS)


def test_closed_conversions_like_walks(spark):
    r = random.Random(1)
    names = [f"u{k}" for k in range(12)]
    worth = {n: r.uniform(0.1, 10) for n in names}  # in an unknown common unit
    edges = [(a, b) for a, b in itertools.pairwise(names[:7])] + [(names[8], names[7]), (names[9], names[8])]
    got = {(x.unit_from, x.unit_to): x.factor for x in units.closed(frame(spark, [(a, b, worth[a] / worth[b]) for a, b in edges])).collect()}
    reach = {n: {n} for n in names[:10]}
    for _ in names:
        for a, b in edges:
            reach[a] |= reach[b]
            reach[b] |= reach[a]
    assert set(got) == {(a, b) for a in reach for b in reach[a]}
    assert all(f == pytest.approx(worth[a] / worth[b]) for (a, b), f in got.items())


def test_prefixes_powers_and_chains(spark):
    known = frame(spark, [("cal", "J", 4.184), ("Wh", "J", 3600.0), ("min", "h", 1 / 60)])
    asked = [("kt", "t"), ("km2", "m2"), ("m^3", "dm3"), ("kcal", "MJ"), ("GWh", "TJ"), ("min", "h"), ("kg CO2", "g CO2"), ("t", "MJ"), ("m2", "m"), ("EUR", "EUR"), ("MEUR", "EUR")]
    got = {(x.unit_from, x.unit_to): x.factor for x in units.factors(spark.createDataFrame(asked, "unit_from string, unit_to string"), known).collect()}
    want = [1e3, 1e6, 1e3, 4.184e-3, 3.6, 1 / 60, 1e3, None, None, 1.0, 1e6]
    assert got == {k: w if w is None else pytest.approx(w) for k, w in zip(asked, want, strict=True)}


def test_contradictions_are_refused(spark):
    for wrong in ([("a", "b", 2.0), ("b", "c", 3.0), ("a", "c", 7.0)], [("a", "b", 0.0)], [("a", "b", None)]):
        with pytest.raises(WrongInput):
            units.closed(frame(spark, wrong))


def test_inventories_in_other_units(spark):
    model = iot(spark)
    row = lambda kind, item, quantity, unit: ("new", "r1", kind, None, item, "Update", quantity, unit)
    kind = sectors.INVENTORY + ", unit string"
    plain = [row("input", "s1", 0.2, None), row("factor", "wages", 0.3, "EUR"), row("satellite", "CO2", 5.0, "kg")]
    other = [row("input", "s1", 0.0002, "kEUR"), row("factor", "wages", 30.0, "cent"), row("satellite", "CO2", 0.005, "Mg")]
    cents = frame(spark, [("cent", "EUR", 0.01)])
    made = [sectors.add_sectors(model, spark.createDataFrame(rows, kind), "EUR", conversions=cents) for rows in (plain, other)]
    cells = [sorted((c.matrix, c.i, c.j, round(c.value, 9)) for c in m.cells.filter("matrix in ('z', 'v', 'e')").collect()) for m in made]
    assert cells[0] == cells[1]
    with pytest.raises(WrongInput):
        sectors.add_sectors(model, spark.createDataFrame([row("satellite", "CO2", 5.0, "EUR")], kind), "EUR", conversions=cents)
