import numpy as np
import pandas as pd
import pytest
from small import ACCOUNT_ROWS, ACT, COM, FACTOR_ROWS, FINAL, GOODS, array, iot, iot_arrays, sut, sut_arrays

from sectora.plans import blocks as B
from sectora.plans import kernels, tiles
from sectora.schema import NotComputable

inv = np.linalg.inv


@pytest.fixture(scope="module")
def table(spark):
    return iot(spark)


@pytest.fixture(scope="module")
def supply_use(spark):
    return sut(spark)


def expected_iot():
    a = iot_arrays()
    x = a["X"]
    z, b, v, e, yt = a["Z"] / x, a["Z"] / x[:, None], a["V"] / x, a["E"] / x, a["Y"].sum(1)
    w, g = inv(np.eye(6) - z), inv(np.eye(6) - b)
    return {"X": x, "z": z, "b": b, "v": v, "e": e, "w": w, "g": g, "m": v @ w, "f": e @ w, "M": v @ w * yt, "F": e @ w * yt, "p": (v @ w).sum(0)}


SHAPES = {"z": (GOODS, GOODS), "b": (GOODS, GOODS), "w": (GOODS, GOODS), "g": (GOODS, GOODS), "v": (FACTOR_ROWS, GOODS), "m": (FACTOR_ROWS, GOODS), "M": (FACTOR_ROWS, GOODS), "e": (ACCOUNT_ROWS, GOODS), "f": (ACCOUNT_ROWS, GOODS), "F": (ACCOUNT_ROWS, GOODS)}


@pytest.mark.parametrize("method", ["inverse", "solve"])
def test_input_output_matrices_like_numpy(table, method):
    planner = table.planner(method=method)
    for name, want in expected_iot().items():
        got = array(table, planner.resolve(name), *SHAPES.get(name, (GOODS,)))
        assert np.allclose(got, want), name


def expected_sut(product=False):
    a = sut_arrays()
    s, u, yc = a["S"], a["U"], a["Yc"]
    xa, xc = s.sum(1), u.sum(1) + yc.sum(1)
    us, ms = u / xa, inv(s.T / xa) if product else s / xc
    wcc, waa = inv(np.eye(4) - us @ ms), inv(np.eye(4) - ms @ us)
    va, vc, ea, ec = a["Va"] / xa, a["Vc"] / xc, a["Ea"] / xa, a["Ec"] / xc
    bu, bs = u / xc[:, None], s / xa[:, None]
    gcc, gaa = inv(np.eye(4) - bu @ bs), inv(np.eye(4) - bs @ bu)
    out = {
        "Xa": (xa, ACT, None), "Xc": (xc, COM, None), "u": (us, COM, ACT), "s": (ms, ACT, COM), "wcc": (wcc, COM, COM), "waa": (waa, ACT, ACT), "wca": (wcc @ us, COM, ACT), "wac": (waa @ ms, ACT, COM),
        "bu": (bu, COM, ACT), "bs": (bs, ACT, COM), "gcc": (gcc, COM, COM), "gaa": (gaa, ACT, ACT), "gca": (gcc @ bu, COM, ACT), "gac": (gaa @ bs, ACT, COM),
    }
    for rows, a_, c_, m, big in ((FACTOR_ROWS, va, vc, "m", "M"), (ACCOUNT_ROWS, ea, ec, "f", "F")):
        ma, mc = (a_ + c_ @ us) @ waa, (a_ @ ms + c_) @ wcc
        out |= {f"{m}a": (ma, rows, ACT), f"{m}c": (mc, rows, COM), f"{big}a": (ma * (ms @ yc.sum(1)), rows, ACT), f"{big}c": (mc * yc.sum(1), rows, COM)}
    out |= {"pa": (out["ma"][0].sum(0), ACT, None), "pc": (out["mc"][0].sum(0), COM, None)}
    return out


@pytest.mark.parametrize("method", ["inverse", "solve"])
def test_supply_use_matrices_like_numpy(supply_use, method):
    planner = supply_use.planner(method=method)
    for name, (want, rows, columns) in expected_sut().items():
        assert np.allclose(array(supply_use, planner.resolve(name), rows, columns), want), name


def test_product_technology(spark):
    m = sut(spark, tech="product")
    want = expected_sut(product=True)
    assert np.allclose(array(m, m.resolve("s"), ACT, COM), want["s"][0])
    a = sut_arrays()
    assert np.allclose(array(m, m.resolve("c"), COM, ACT), a["S"].T / a["S"].sum(1))
    with pytest.raises(NotComputable):
        sut(spark).resolve("c")


def test_unified_views_hold_their_parts(supply_use):
    planner = supply_use.planner()
    whole = planner.resolve("w")
    for rows, columns, part in ((COM, COM, "wcc"), (ACT, COM, "wac"), (COM, ACT, "wca"), (ACT, ACT, "waa")):
        assert np.allclose(array(supply_use, whole, rows, columns), array(supply_use, planner.resolve(part), rows, columns))
    stored = supply_use.calc_all(["p"])
    assert "part of p" in stored.explain("pa") and np.allclose(array(stored, stored.resolve("pa"), ACT), expected_sut()["pa"][0])


def test_plans(table, supply_use):
    assert table.planner().plan("w").order() == ["X", "z", "w"]
    assert table.explain("F").splitlines()[0] == "F: f @ diag(Y.sum)"
    assert "solve" in table.explain("p", method="solve") and "solve" not in table.explain("p")
    kept = table.calc_all(["w"])
    assert kept.has("w") and not kept.has("z") and kept.explain("w") == "w: stored"
    assert "inverse" not in kept.explain("f")
    with pytest.raises(NotComputable):
        table.resolve("nothing")
    with pytest.raises(NotComputable):
        supply_use.resolve("Ya")


def test_large_tables_take_tiles(table, monkeypatch):
    monkeypatch.setattr(kernels, "DENSE_LABELS", 3)
    want = expected_iot()
    assert table.planner(method="auto").method == "solve"
    assert np.allclose(array(table, table.resolve("w"), GOODS, GOODS), want["w"])
    assert np.allclose(array(table, table.resolve("p", method="auto"), GOODS), want["p"], rtol=1e-6)


def test_singular_squares_get_the_pseudo_inverse(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (2, 2, 0.5)], "i long, j long, value double")
    got = {(r.i, r.j): r.value for r in kernels.inverse(a, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert got == {(2, 2): 2.0}


def test_guarded_reciprocal_and_differences(spark):
    x = spark.createDataFrame([(1, 0, 4.0), (2, 0, 0.0)], "i long, j long, value double")
    assert [(r.i, r.value) for r in B.inverse_vector(x).collect()] == [(1, 0.25)]
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "i long, j long, value double")
    b = spark.createDataFrame([(1, 1, 2.0)], "i long, j long, value double")
    assert sorted((r.j, r.value) for r in B.difference(a, b, True).collect()) == [(1, 0.5), (2, None)]
    assert sorted((r.j, r.value) for r in B.subtract(a, b).collect()) == [(1, 1.0), (2, 1.0)]


def test_final_demand_stays(table):
    assert np.allclose(array(table, table.resolve("Y"), GOODS, FINAL), iot_arrays()["Y"])
    assert table.resolve("VY").count() == 0


def test_tiles_like_numpy(spark):
    r = np.random.default_rng(3)
    n, size = 37, 8
    a, b = r.random((n, n)) * (r.random((n, n)) < 0.4), r.random((n, n))
    ids = np.sort(r.choice(10_000, n, replace=False)) - 5000
    frame = lambda x: spark.createDataFrame([(int(ids[i]), int(ids[j]), float(x[i, j])) for i in range(n) for j in range(n) if x[i, j]], "i long, j long, value double")
    numbers = tiles.numbered(spark.createDataFrame([(int(k),) for k in ids], "id long"))
    assert [x["id"] for x in numbers.orderBy("n").collect()] == ids.tolist()
    of = lambda x: tiles.from_cells(frame(x), numbers, numbers, size)
    at = {int(k): i for i, k in enumerate(ids)}
    got = np.zeros((n, n))
    for x in tiles.to_cells(tiles.add(tiles.matmul(of(a), of(b), size), of(a)), numbers, numbers, size).collect():
        got[at[x["i"]], at[x["j"]]] = x["value"]
    assert np.allclose(got, a @ b + a)
    assert np.isclose(tiles.largest(of(a)), a.max())
