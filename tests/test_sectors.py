"""New activities and commodities, allotment of inputs, and sectors split off others, against plain arithmetic."""

import numpy as np
import pytest
from small import ACT, COM, FACTOR_ROWS, FINAL, GOODS, REGIONS, array, iot, iot_arrays, sut, sut_arrays

from sectora.model import Model
from sectora.operators import sectors, splits
from sectora.schema import LABELLED, WrongInput


def inventory(spark, rows):
    return spark.createDataFrame(rows, sectors.INVENTORY)


@pytest.fixture(scope="module")
def table(spark):
    return iot(spark).with_clusters(region={"all": REGIONS}, sector={"some": ["s1", "s2"]})


def test_new_activities_and_commodities(spark):
    a = sut_arrays()
    xa, xc = a["S"].sum(1), a["U"].sum(1) + a["Yc"].sum(1)
    m = sut(spark).with_clusters(region={"all": REGIONS})
    rows = [
        ("new", "r1", "input", "all", "c1", "Update", 0.2),
        ("new", "r1", "input", "all", "n1", "Update", 0.1),
        ("new", "r1", "input", None, "c2", "Percentage", -0.5),
        ("new", "r1", "factor", None, "wages", "Update", 0.3),
        ("new", "r1", "satellite", None, "CO2", "Update", 0.7),
    ]
    shares = spark.createDataFrame([("new", "r1", "c1", 0.25), ("new", "r1", "n1", 1.0)], sectors.SHARES)
    demand = spark.createDataFrame([("n1", "r1", None, 3.0), ("c1", "r1", "inv", 2.0)], sectors.DEMAND)
    # the new commodity exists in r1 alone, so that the cluster comes down to it
    out = sectors.add_sectors(m, inventory(spark, rows), "EUR", {"new": "a2"}, demand, shares=shares, goods={"n1": "c1"})
    fresh, good = [("r1", "Activity", "new")], [("r1", "Commodity", "n1")]
    u = a["U"] / xa
    got = array(out, out.resolve("u"), COM + good, fresh)[:, 0]
    bought = a["U"][[0, 2], 1]
    assert np.allclose(got[[0, 2]], 0.2 * bought / bought.sum()) and np.isclose(got[1], u[1, 1] / 2) and np.isclose(got[3], u[3, 1]) and np.isclose(got[4], 0.1)
    assert np.allclose(array(out, out.resolve("va"), FACTOR_ROWS, fresh)[:, 0], [(a["Va"] / xa)[0, 1], 0.3])
    s = array(out, out.resolve("s"), ACT + fresh, COM + good)
    assert np.allclose(s[:4, :4], a["S"] / xc) and np.allclose(s[4], [0.25, 0, 0, 0, 1.0])
    y = array(out, out.resolve("Yc"), COM + good, FINAL)
    assert np.isclose(y[0, 1], a["Yc"][0, 1] + 2.0) and np.isclose(y[4, 0], 3.0)
    # the whole system with the new labels solves
    uw, sw = np.zeros((5, 5)), s
    uw[:4, :4], uw[:, 4] = u, got
    want = np.linalg.solve(np.eye(5) - uw @ sw, y.sum(1))
    assert np.allclose(array(out, out.resolve("Xc"), COM + good), want)
    assert {(r.level, r.item) for r in out.units.collect()} >= {("Activity", "new"), ("Commodity", "n1")}


def test_inputs_without_parents(spark, table):
    a = iot_arrays()
    rows = [("new", "r2", "input", "all", "s1", "Update", 0.2), ("new", "r2", "input", "r1", "some", "Update", 0.4), ("new", "r2", "input", None, "s3", "Update", 0.1), ("new", "r2", "input", None, "s3", "Update", 0.05)]
    out = sectors.add_sectors(table, inventory(spark, rows), "EUR")
    got = array(out, out.resolve("z"), GOODS, [("r2", "Sector", "new")])[:, 0]
    bought = a["Z"][:, 3:].sum(1)  # what all of r2 buys
    want = np.zeros(6)
    want[[0, 3]] += 0.2 * bought[[0, 3]] / bought[[0, 3]].sum()
    want[[0, 1]] += 0.4 * bought[[0, 1]] / bought[[0, 1]].sum()
    want[5] += 0.15
    assert np.allclose(got, want)


@pytest.mark.parametrize("row", [("new", "r1", "input", None, "nothing", "Update", 0.1), ("new", "nowhere", "factor", None, "wages", "Update", 0.1), ("new", "r1", "factor", None, "wages", "Percentage", 0.1)])
def test_wrong_inventories(spark, table, row):
    with pytest.raises(WrongInput):
        sectors.add_sectors(table, inventory(spark, [row]), "EUR")


def test_factors_on_several_rows(spark):
    goods = [("r1", "Sector", "s1"), ("r1", "Sector", "s2")]
    rows = [("baseline", "Z", *goods[a], *goods[b], 1.0 + a + b) for a in (0, 1) for b in (0, 1)] + [("baseline", "Y", *g, "r1", "Consumption category", "hh", 9.0) for g in goods]
    rows += [("baseline", "V", k, "Factor of production", "wages", *goods[0], v) for k, v in (("r1", 1.0), ("r2", 3.0))]
    m = Model.from_labelled(spark.createDataFrame(rows, LABELLED), "IOT")
    take = [(n, "r1", "factor", None, "wages", "Update", 0.8) for n in ("heir", "orphan")]
    out = sectors.add_sectors(m, inventory(spark, take), "EUR", {"heir": "s1"})
    wages = [(k, "Factor of production", "wages") for k in ("r1", "r2")]
    assert np.allclose(array(out, out.resolve("v"), wages, [("r1", "Sector", n) for n in ("heir", "orphan")]), [[0.2, 0.4], [0.6, 0.4]])


def split_by_hand(a, outputs, columns):
    """Z, Y, V, E with children of s2 (GOODS[1], GOODS[4]): outputs {region: {child: quantity}}, columns {(block, region, child): coefficients}."""
    names = sorted({c for o in outputs.values() for c in o})
    old, blocks = {"r1": 1, "r2": 4}, {}
    for m in "ZVE":
        x = a[m].copy()
        asked = {(r, c): columns[m, r, c] * q for r, o in outputs.items() for c, q in o.items()}
        short = {r for r, o in outputs.items() if any((sum(asked[r, c][k] for c in o) > x[k, old[r]] * (1 + 1e-9)) or (x[k, old[r]] == 0 and any(asked[r, c][k] for c in o)) for k in range(len(x)))}
        new = {}
        for (r, c), cells in asked.items():
            part = np.divide(cells, x[:, old[r]], out=np.zeros(len(x)), where=x[:, old[r]] != 0)
            if r in short:
                for k in range(len(x)):
                    fine = [asked[q, c][k] / x[k, old[q]] for q in outputs if c in outputs[q] and q not in short and x[k, old[q]]]
                    part[k] = np.median(fine) if fine else 0.0
            new[r, c] = part
        for r, o in outputs.items():
            parts = np.maximum(1.0, sum(new[r, c] for c in o))
            for c in o:
                new[r, c] = x[:, old[r]] * new[r, c] / parts
        for r, o in outputs.items():
            x[:, old[r]] -= sum(new[r, c] for c in o)
        blocks[m] = np.hstack([x] + [new[k][:, None] for k in sorted(new)])
    blocks["Y"] = a["Y"].copy()
    for m in "ZY":
        x = blocks[m]
        extra = []
        for r, c in sorted((r, c) for r, o in outputs.items() for c in o):
            extra.append(a_row := x[old[r]] * outputs[r][c] / a["X"][old[r]])
            assert a_row.shape == (x.shape[1],)
        for r, o in outputs.items():
            x[old[r]] = x[old[r]] * (1 - sum(o.values()) / a["X"][old[r]])
        blocks[m] = np.vstack([x, *extra])
    return blocks, names


def test_split_keeps_totals(spark, table):
    a = iot_arrays()
    x, quantity = a["X"], {"r1": {"k1": float(a["X"][1] * 0.3), "k2": float(a["X"][1] * 0.2)}, "r2": {"k1": float(a["X"][4] * 0.6)}}
    outputs = spark.createDataFrame([(c, r, q) for r, o in quantity.items() for c, q in o.items()], splits.OUTPUTS)
    # k1 in r2 takes more of s1 than its parent has; k2 is its parent in small
    rows = [("k1", "r1", "input", None, "s1", "Update", 0.01), ("k1", "r2", "input", None, "s1", "Update", 0.9), ("k1", "r2", "factor", None, "wages", "Percentage", -0.2)]
    out = splits.split_sectors(table, {"k1": "s2", "k2": "s2"}, outputs, inventory(spark, rows))
    columns = {(m, r, c): (a[m] / x)[:, 1 if r == "r1" else 4].copy() for m in "ZVE" for r, o in quantity.items() for c in o}
    columns["Z", "r1", "k1"][0] = 0.01
    columns["Z", "r2", "k1"][3] = 0.9
    columns["V", "r2", "k1"][1] *= 0.8
    want, _ = split_by_hand(a, quantity, columns)
    labels = GOODS + [("r1", "Sector", "k1"), ("r1", "Sector", "k2"), ("r2", "Sector", "k1")]
    z, y, v = array(out, out.resolve("Z"), labels, labels), array(out, out.resolve("Y"), labels, FINAL), array(out, out.resolve("V"), FACTOR_ROWS, labels)
    assert np.allclose(z, want["Z"]) and np.allclose(y, want["Y"]) and np.allclose(v, want["V"])
    assert np.isclose(z.sum(), a["Z"].sum()) and np.allclose(v.sum(1), a["V"].sum(1)) and np.allclose(y.sum(0), a["Y"].sum(0))
    got = array(out, out.resolve("X"), labels)
    assert np.allclose(got[6:], [quantity["r1"]["k1"], quantity["r1"]["k2"], quantity["r2"]["k1"]]) and np.isclose(got.sum(), x.sum()) and (z > -1e-12).all()
    named = splits.split_sectors(table, {"k1": "s2"}, outputs.filter("sector = 'k1'"), rename={"s2": "rest"})
    assert {r.item for r in named.index("Sector").collect()} == {"s1", "s3", "rest", "k1"}


@pytest.mark.parametrize(("parents", "rows"), [({"k": "s9"}, [("k", "r1", 1.0)]), ({"s1": "s2"}, [("s1", "r1", 1.0)]), ({"k": "s2"}, [("k", "r1", -1.0)]), ({"k": "s2"}, [("k", "r1", 1e9)]), ({"k": "s2"}, [("l", "r1", 1.0)]), ({"k": "s2", "l": "s1"}, [("k", "r1", 1.0)])])
def test_wrong_splits(spark, table, parents, rows):
    with pytest.raises(WrongInput):
        splits.split_sectors(table, parents, spark.createDataFrame(rows, splits.OUTPUTS))


def test_outputs_in_other_units(spark, table):
    rows = lambda q, u: spark.createDataFrame([("k", "r1", q, u)], splits.OUTPUTS + ", unit string")
    made = [splits.split_sectors(table, {"k": "s2"}, rows(*r)) for r in ((2.0, None), (0.002, "kEUR"))]
    one, two = (array(m, m.resolve("X"), [("r1", "Sector", "k")]) for m in made)
    assert np.allclose(one, 2.0) and np.allclose(two, 2.0)
    with pytest.raises(WrongInput):
        splits.split_sectors(table, {"k": "s2"}, rows(1.0, "kg"))
