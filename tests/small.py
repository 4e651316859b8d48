"""Small random tables as numpy arrays and as models, so that results can be held against plain linear algebra."""

import numpy as np

from sectora.model import Model
from sectora.schema import LABELLED, UNITS

REGIONS, SECTORS, FACTORS, ACCOUNTS, CATEGORIES = ("r1", "r2"), ("s1", "s2", "s3"), ("taxes", "wages"), ("CO2", "CH4"), ("hh", "inv")
GOODS = [(r, "Sector", s) for r in REGIONS for s in SECTORS]
FINAL = [(r, "Consumption category", c) for r in REGIONS for c in CATEGORIES]
ACT = [(r, "Activity", f"a{k}") for r in REGIONS for k in (1, 2)]
COM = [(r, "Commodity", f"c{k}") for r in REGIONS for k in (1, 2)]
FACTOR_ROWS = [(None, "Factor of production", f) for f in FACTORS]
ACCOUNT_ROWS = [(None, "Satellite account", k) for k in ACCOUNTS]


def cells(matrix, values, rows, columns, scenario="baseline"):
    return [(scenario, matrix, *rows[a], *columns[b], float(values[a, b])) for a in range(len(rows)) for b in range(len(columns)) if values[a, b]]


def iot_arrays(seed=0):
    r = np.random.default_rng(seed)
    z = r.uniform(1, 10, (6, 6))
    y = r.uniform(5, 30, (6, 4))
    return {"Z": z, "Y": y, "V": r.uniform(1, 9, (2, 6)), "E": r.uniform(0, 5, (2, 6)), "EY": r.uniform(0, 2, (2, 4)), "X": z.sum(1) + y.sum(1)}


def units(spark, levels):
    rows = [(level, item, "EUR") for level, items in levels.items() for item in items] + [("Factor of production", f, "EUR") for f in FACTORS] + [("Satellite account", k, "kg") for k in ACCOUNTS]
    return spark.createDataFrame(rows, UNITS)


def iot(spark, arrays=None):
    a = arrays or iot_arrays()
    rows = cells("Z", a["Z"], GOODS, GOODS) + cells("Y", a["Y"], GOODS, FINAL) + cells("V", a["V"], FACTOR_ROWS, GOODS) + cells("E", a["E"], ACCOUNT_ROWS, GOODS) + cells("EY", a["EY"], ACCOUNT_ROWS, FINAL)
    return Model.from_labelled(spark.createDataFrame(rows, LABELLED), "IOT", units(spark, {"Sector": SECTORS}))


def sut_arrays(seed=1):
    r = np.random.default_rng(seed)
    s = np.kron(np.eye(2), r.uniform(1, 4, (2, 2)) + np.diag([20, 30]))  # makers of the own region
    yc = r.uniform(3, 6, (4, 4))
    u = r.uniform(0.5, 2, (4, 4))
    u *= ((s.sum(0) - yc.sum(1)) / u.sum(1))[:, None]  # a balanced table: what is made is used
    return {"S": s, "U": u, "Yc": yc, "Va": r.uniform(1, 3, (2, 4)), "Vc": r.uniform(0.1, 0.3, (2, 4)), "Ea": r.uniform(0, 3, (2, 4)), "Ec": r.uniform(0, 1, (2, 4)), "EY": r.uniform(0, 1, (2, 4))}


def sut(spark, arrays=None, tech="industry"):
    a = arrays or sut_arrays()
    rows = cells("S", a["S"], ACT, COM) + cells("U", a["U"], COM, ACT) + cells("Yc", a["Yc"], COM, FINAL)
    for m, k, columns in (("Va", FACTOR_ROWS, ACT), ("Vc", FACTOR_ROWS, COM), ("Ea", ACCOUNT_ROWS, ACT), ("Ec", ACCOUNT_ROWS, COM), ("EY", ACCOUNT_ROWS, FINAL)):
        rows += cells(m, a[m], k, columns)
    names = {"Activity": ("a1", "a2"), "Commodity": ("c1", "c2")}
    return Model.from_labelled(spark.createDataFrame(rows, LABELLED), "SUT", units(spark, names), tech)


def array(model, block, rows, columns=None):
    """A block as a numpy array; without columns the vector."""
    got = {}
    label = {r["id"]: (r["region"], r["level"], r["item"]) for r in model.axis.collect()}
    for c in block.collect():
        got[(label[c["i"]], label.get(c["j"]))] = c["value"]
    if columns is None:
        return np.array([got.get((r, None), 0.0) for r in rows])
    return np.array([[got.get((r, c), 0.0) for c in columns] for r in rows])
