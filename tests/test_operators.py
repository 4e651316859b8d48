import numpy as np
import pytest
from pyspark.sql import functions as F
from small import ACCOUNT_ROWS, ACT, CATEGORIES, COM, FACTOR_ROWS, FINAL, GOODS, REGIONS, SECTORS, array, iot, iot_arrays, sut, sut_arrays

from sectora.model import Model
from sectora.operators import balance, custom, indicators, scenarios, sectors, structure, trade, views
from sectora.plans import blocks as B
from sectora.schema import LABELLED, NotComputable, WrongInput, set_name

inv = np.linalg.inv


@pytest.fixture(scope="module")
def table(spark):
    return iot(spark)


@pytest.fixture(scope="module")
def supply_use(spark):
    return sut(spark)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_input_is_checked(spark):
    bad = spark.createDataFrame([("baseline", "Z", "r", "Sector", "s", "r", "Sector", "s", float("nan"))], LABELLED)
    with pytest.raises(WrongInput):
        Model.from_labelled(bad, "IOT")
    with pytest.raises(WrongInput):
        Model.from_labelled(bad, "XXX")
    assert set_name("countries") == set_name("r") == "Region" and set_name("Value added") == "Factor of production"
    assert (set_name("Industries"), set_name("industry", "IOT")) == ("Activity", "Sector")


def test_duplicates_add_up_and_unified_tables_are_split(spark):
    rows = [("baseline", "Z", "r", "Commodity", "c", "r", "Activity", "a", 2.0)] * 2 + [("baseline", "Z", "r", "Activity", "a", "r", "Commodity", "c", 5.0), ("baseline", "X", "r", "Activity", "a", None, None, "production", 9.0)]
    m = Model.from_labelled(spark.createDataFrame(rows, LABELLED), "SUT")
    assert m.names == {"baseline": ("S", "U")} and m.resolve("U").collect()[0]["value"] == 4.0


def test_labels_and_units(table):
    assert {r["item"] for r in table.index("regions").collect()} == set(REGIONS) and table.is_multi_region and not table.is_hybrid
    assert {(r["level"], r["item"]) for r in table.search("^S[12]$").collect()} == {("Sector", "s1"), ("Sector", "s2")}
    assert table.search("^S1$", "s", ignore_case=False).isEmpty()
    assert table.rename_units("k", "kg", "t").units.filter("unit = 't'").count() == 2
    assert table.same_sets(table) and not table.same_sets(table.without(["Y"], "baseline").__class__.from_labelled(table.labelled_cells().filter("region_to = 'r1'"), "IOT"))


def test_scenarios(table):
    m = table.clone_scenario("baseline", "other").rename_scenario("other", "new")
    assert m.scenarios == ("baseline", "new")
    assert m.build_new("new").names == table.names and m.drop_scenarios().scenarios == ("baseline",)
    assert m.rename_scenario("baseline", "base").baseline == "base"
    twice = m.update_scenario("new", Y=table.resolve("Y").withColumn("value", 2 * table.resolve("Y")["value"]))
    diff = twice.query(["X"], ["new"], base="baseline", relative=True)["new"]["X"]
    assert np.allclose([r["value"] for r in diff.collect()], 1.0)
    with pytest.raises(WrongInput):
        m.clone_scenario("baseline", "new")
    assert table.add_scenario(table, "again").names["again"] == table.names["baseline"]


def test_coefficients_and_flows_stand_for_each_other(table):
    coefficients = table.reset(to="coefficients")
    assert coefficients.names["baseline"] == ("EY", "VY", "Y", "e", "v", "z")
    assert np.allclose(array(coefficients, coefficients.resolve("Z"), GOODS, GOODS), iot_arrays()["Z"])
    assert "Z" in coefficients.reset(to="flows").names["baseline"]


def test_gdp_mix_and_balance(table):
    a = iot_arrays()
    got = values(indicators.gdp(table), "region")
    assert np.isclose(got[("r1",)]["gdp"], a["V"][:, :3].sum())
    got = values(indicators.gdp(table, exclude=["taxes"], total=False, share=True), "region", "item")
    assert np.isclose(got[("r2", "s1")]["gdp"], a["V"][1, 3]) and np.isclose(got[("r2", "s1")]["share"], 100 * a["V"][1, 3] / a["V"][1, 3:].sum())
    got = values(indicators.mix(table, ["s1", "s3"]), "region", "item")
    assert np.isclose(got[("r1", "s3")]["share"], a["X"][2] / (a["X"][0] + a["X"][2]))
    assert not indicators.is_balanced(table) and indicators.is_balanced(table, margin=1e9)
    gap = values(indicators.balance(table), "region", "item")
    assert np.isclose(gap[("r1", "s2")]["imbalance"], (a["Z"].sum(0) + a["V"].sum(0) - a["X"])[1])
    assert indicators.balance(table, "prices").count() == 6


def test_linkages(table):
    a = iot_arrays()
    z, b = a["Z"] / a["X"], a["Z"] / a["X"][:, None]
    w, g = inv(np.eye(6) - z), inv(np.eye(6) - b)
    cut = lambda x: x - np.diag(np.diag(x))
    got = values(indicators.linkages(table, normalized=False), "region", "item")
    assert np.allclose([got[(r, s)]["total_backward"] for r, _, s in GOODS], cut(w).sum(0)) and np.allclose([got[(r, s)]["total_forward"] for r, _, s in GOODS], cut(g).sum(1))
    assert np.allclose([got[(r, s)]["amplification_backward"] for r, _, s in GOODS], cut(w).sum(0) / cut(z).sum(0))
    got = values(indicators.linkages(table, cut_diag=False), "region", "item")
    assert np.allclose([got[(r, s)]["direct_forward"] for r, _, s in GOODS], b.sum(1) / b.sum(1).mean())
    got = values(indicators.linkages(table, multi=True), "region", "item")
    assert np.isclose(got[("r1", "s1")]["total_backward_foreign"], w[3:, 0].sum())


def test_paths_are_the_truncated_series(table):
    a = iot_arrays()
    z, e = a["Z"] / a["X"], (a["E"] / a["X"])[0]
    got = indicators.paths(table, "CO2", max_depth=2, top=100_000).collect()
    assert np.isclose(sum(r["contribution"] for r in got), (e @ (np.eye(6) + z + z @ z) @ a["Y"]).sum())
    assert got == sorted(got, key=lambda r: (-abs(r["contribution"]), r["depth"], r["path"])) and np.isclose(got[-1]["cumulative"], sum(r["share"] for r in got))
    assert indicators.paths(table, "CO2", max_depth=2, cutoff=1e9).isEmpty()


def test_paths_of_some_demand(table):
    a = iot_arrays()
    z, e = a["Z"] / a["X"], (a["E"] / a["X"])[0]
    y = np.zeros_like(a["Y"])
    y[[1, 4], 2] = a["Y"][[1, 4], 2]  # s2 for hh of r2
    got = indicators.paths(table, "CO2", max_depth=2, top=100_000, goods=["s2"], regions=["r2"], categories=["hh"]).collect()
    whole = (e @ np.linalg.inv(np.eye(6) - z) @ y).sum()
    assert np.isclose(sum(r["contribution"] for r in got), (e @ (np.eye(6) + z + z @ z) @ y).sum()) and np.isclose(got[0]["share"], got[0]["contribution"] / whole)
    assert all(r["path"].endswith("FD: r2|hh") for r in got)
    with pytest.raises(WrongInput):
        indicators.paths(table, "CO2", regions=["nowhere"])


def test_profiles_of_gases(table):
    own = indicators.GasProfile(("small", "made up"), {"CO2": "CO2", "CH": "CH4"}, prefix=True)
    told = table.describe(source="A small table, made up")
    assert indicators.gas_profile_of(told) is None and indicators.gas_profile_of(table.describe(name="EXIOBASE 3 monetary")) == "exiobase_monetary"
    with pytest.raises(WrongInput):
        indicators.ghg_of_profile(told)
    indicators.register_gas_profile("small", own)
    indicators.register_gas_profile("smaller", indicators.GasProfile(("small",), {"CO2": 2.0}))
    try:
        assert indicators.gas_profile_of(told) == "small"
        a, m = iot_arrays(), indicators.ghg_of_profile(told, report="AR4")
        assert np.allclose(array(m, m.resolve("E"), [(None, "Satellite account", "GHG AR4 GWP-100")], GOODS), a["E"][0] + 25 * a["E"][1])
        m = indicators.ghg_of_profile(told, "smaller", label="twice")
        assert np.allclose(array(m, m.resolve("EY"), [(None, "Satellite account", "twice")], FINAL), 2 * a["EY"][0])
    finally:
        for name in ("small", "smaller"):
            indicators.GAS_PROFILES.pop(name)


def test_label_checks(table):
    z, y = table.resolve("Z"), table.resolve("Y")
    B.require_square(z)
    B.require_square(z, table.ids("Sector"))
    B.require_same_labels(z, "j", y, "i")
    short = z.filter(F.col("i") != z.first()["i"])
    assert B.labels_apart(short, "i", z, "i").count() == 1
    for wrong in (lambda: B.require_square(y), lambda: B.require_square(short), lambda: B.require_square(y, table.ids("Sector")), lambda: B.require_same_labels(z, "j", y, "j")):
        with pytest.raises(WrongInput):
            wrong()


def test_greenhouse_gases(table):
    a = iot_arrays()
    m = indicators.ghg(table, {"CO2": "CO2", "CH4": "CH4", "none": "N2O"})
    row = [(None, "Satellite account", "GHG AR6 GWP-100")]
    assert np.allclose(array(m, m.resolve("E"), row, GOODS), a["E"][0] + 29.8 * a["E"][1]) and np.allclose(array(m, m.resolve("EY"), row, FINAL), a["EY"][0] + 29.8 * a["EY"][1])
    with pytest.raises(WrongInput):
        indicators.ghg(table, {"none": "CO2"})
    assert m.units.filter("item = 'GHG AR6 GWP-100'").collect()[0]["unit"] == "kg"


def test_exploded_matrices_add_up(table, supply_use):
    f = array(table, table.resolve("f"), ACCOUNT_ROWS, GOODS)
    assert np.allclose(array(table, indicators.exploded(table, "CO2"), GOODS, GOODS).sum(0), f[0])
    assert np.allclose(array(table, indicators.exploded_prices(table), GOODS, GOODS).sum(0), array(table, table.resolve("p"), GOODS))
    for name, columns in (("fa", ACT), ("fc", COM)):
        whole = array(supply_use, supply_use.resolve(name), ACCOUNT_ROWS, columns)[1]
        assert np.allclose(array(supply_use, indicators.exploded(supply_use, "CH4", name), ACT + COM, columns).sum(0), whole)
    prices = array(supply_use, indicators.exploded_prices(supply_use), ACT + COM, ACT + COM).sum(0)
    assert np.allclose(prices, np.concatenate([array(supply_use, supply_use.resolve("pa"), ACT), array(supply_use, supply_use.resolve("pc"), COM)]))


def test_trade(table):
    a = iot_arrays()
    use = np.concatenate([a["Z"], a["Y"]], 1)
    to = np.array([0, 0, 0, 1, 1, 1, 0, 0, 1, 1])
    got = values(trade.trades(table, "s2"), "region_from", "region_to")
    assert np.isclose(got[("r1", "r2")]["value"], use[1, to == 1].sum())
    got = values(trade.trades(table, total=True, final=False), "region_from", "region_to")
    assert np.isclose(got[("Total", "Total")]["value"], a["Z"].sum()) and np.isclose(got[("r2", "Total")]["value"], a["Z"][3:].sum())
    got = values(trade.trades(table, clusters={"all": REGIONS}, direction="origin"), "region_from", "region_to")
    assert set(got) == {("all", "r1"), ("all", "r2")}
    f = (a["E"] / a["X"]) @ inv(np.eye(6) - a["Z"] / a["X"])
    flows = trade.content(table, "satellite", "CO2")
    got = values(flows, "region_from", "region_to")
    assert np.isclose(got[("r2", "r1")]["value"], (f[0][3:, None] * use[3:, to == 0]).sum())
    up = values(trade.content(table, "satellite", "CO2", method="upstream"), "region_from", "region_to")
    assert np.isclose(up[("r1", "r1")]["value"], ((f[0] - a["E"][0] / a["X"])[:3, None] * use[:3, to == 0]).sum())
    net = values(trade.embodied_net_imports(flows), "region")
    assert np.isclose(net[("r1",)]["net_imports"], got[("r2", "r1")]["value"] - got[("r1", "r2")]["value"]) and np.isclose(net[("r1",)]["net_imports"], -net[("r2",)]["net_imports"])
    parts = trade.content_breakdown(table, "satellite", "CO2")
    sums = {}
    for r in parts.collect():
        sums[(r["region_from"], r["region_to"])] = sums.get((r["region_from"], r["region_to"]), 0) + r["value"]
    assert all(np.isclose(v, got[k]["value"]) for k, v in sums.items())
    hhi = values(trade.concentration(parts), "region_from", "region_to")
    assert all(0.5 - 1e-9 <= r["hhi"] <= 1 for r in hhi.values())
    assert all(np.isclose(r["exposure"], 1) for r in trade.exposure(parts, REGIONS).collect())


def test_aggregation(spark, table):
    pairs = lambda **k: spark.createDataFrame([*k.items()], "source string, target string")
    a = iot_arrays()
    m = structure.aggregate(table, {"s": pairs(s1="big", s2="big"), "Region": pairs(r1="world", r2="world")}, drop=["CH4"])
    goods = [("world", "Sector", "big"), ("world", "Sector", "s3")]
    z = a["Z"].reshape(2, 3, 2, 3).sum((0, 2))
    want = np.array([[z[:2, :2].sum(), z[:2, 2].sum()], [z[2, :2].sum(), z[2, 2]]])
    assert np.allclose(array(m, m.resolve("Z"), goods, goods), want) and m.size("Satellite account") == 1
    assert np.isclose(array(m, m.resolve("X"), goods).sum(), a["X"].sum())
    with pytest.raises(WrongInput):
        structure.aggregate(table, {"s": pairs(nothing="big")})
    with pytest.raises(WrongInput):
        structure.aggregate(table, {"s": pairs(s1="big")}, ignore_missing=False)
    mixed = table.__class__(**{**{f: getattr(table, f) for f in table.__dataclass_fields__}, "units": spark.createDataFrame([("Sector", "s1", "EUR"), ("Sector", "s2", "t")], "level string, item string, unit string")})
    with pytest.raises(WrongInput):
        structure.aggregate(mixed, {"s": pairs(s1="big", s2="big")})


@pytest.mark.parametrize("method", "ABCD")
def test_to_iot(supply_use, method):
    a = sut_arrays()
    s, u, yc = a["S"], a["U"], a["Yc"]
    g, q = s.sum(1), u.sum(1) + yc.sum(1)
    t = {"A": inv(s.T) @ np.diag(q), "B": np.diag(1 / g) @ s, "C": np.diag(g) @ inv(s.T), "D": s @ np.diag(1 / q)}[method]
    m = structure.to_iot(supply_use, method)
    goods = [(r, "Sector", x) for r, _, x in (COM if method in "AB" else ACT)]
    z, y, v = (u @ t, yc, a["Va"] @ t) if method in "AB" else (t @ u, t @ yc, a["Va"])
    assert np.allclose(array(m, m.resolve("Z"), goods, goods), z) and np.allclose(array(m, m.resolve("Y"), goods, FINAL), y) and np.allclose(array(m, m.resolve("V"), FACTOR_ROWS, goods), v)
    assert m.kind == "IOT" and np.allclose(array(m, m.resolve("X"), goods), z.sum(1) + y.sum(1))


def test_trade_moves_to_the_supply_side(supply_use):
    assert indicators.is_isard(supply_use) and not indicators.is_chenery_moses(supply_use)
    m = structure.to_chenery_moses(supply_use)
    assert indicators.is_chenery_moses(m) and not indicators.is_isard(m)
    a = sut_arrays()
    used = np.concatenate([a["U"], a["Yc"]], 1)
    to = np.array([0, 0, 1, 1, 0, 0, 1, 1])
    shares = a["S"] / (a["U"].sum(1) + a["Yc"].sum(1))
    got = array(m, m.resolve("S"), ACT, COM)
    assert np.allclose(got[:2, 2:], shares[:2, :2] @ np.diag(used[:2][:, to == 1].sum(1)))
    assert np.allclose(got.sum(), a["S"].sum()) and np.allclose(array(m, m.resolve("U"), COM, ACT).sum(0), a["U"].sum(0))
    with pytest.raises(NotComputable):
        structure.to_chenery_moses(m)
    assert values(trade.trades(m, "c1"), "region_from", "region_to")[("r1", "r2")]["value"] > 0


def test_pooled_trade_keeps_totals(supply_use):
    a = sut_arrays()
    m = structure.pool_trade(supply_use, ["c1"])
    used = np.concatenate([a["U"], a["Yc"]], 1)
    need, sent = [(r, "Commodity", "c1 - need") for r in REGIONS], [(r, "Activity", "c1 - supply") for r in REGIONS]
    to = np.array([0, 0, 1, 1, 0, 0, 1, 1])
    assert np.allclose(array(m, m.resolve("U"), need, ACT)[0, :2], a["U"][[0, 2], :2].sum(0))
    assert np.isclose(array(m, m.resolve("S"), sent, need)[0, 1], used[0, to == 1].sum())
    assert np.isclose(array(m, m.resolve("U"), COM, sent)[0, 0], used[0].sum()) and m.meta["pooled_trade"] == {"c1": ("c1 - supply", "c1 - need")}
    with pytest.raises(WrongInput):
        structure.pool_trade(m, ["c1"])
    with pytest.raises(WrongInput):
        structure.pool_trade(supply_use, ["no such"])


def test_region_subsets(table):
    a = iot_arrays()
    m = structure.region_subset(table, ["r1"])
    home = [g for g in GOODS if g[0] == "r1"]
    assert np.allclose(array(m, m.resolve("X"), home), a["X"][:3])
    assert np.allclose(array(m, m.resolve("V"), [(None, "Factor of production", "imports")], home)[0], a["Z"][3:, :3].sum(0))
    exports = [("r1", "Consumption category", c) for c in ("Intermediate exports", "Final Demand exports")]
    assert np.allclose(array(m, m.resolve("Y"), home, exports), np.stack([a["Z"][:3, 3:].sum(1), a["Y"][:3, 2:].sum(1)], 1))
    by = structure.region_subset(table, "r1", "by_region_and_sector")
    assert np.allclose(array(by, by.resolve("V"), [(None, "Factor of production", "imports r2 s2")], home)[0], a["Z"][4, :3])
    for wrong in ([], ["r1", "r2"], ["r1", "r1"], ["r9"]):
        with pytest.raises(WrongInput):
            structure.region_subset(table, wrong)


def test_new_extensions(spark, table):
    cells = spark.createDataFrame([("noise", "r1", "Sector", "s1", 4.0)], "item_from string, region_to string, level_to string, item_to string, value double")
    m = structure.add_extensions(table, cells, "E", spark.createDataFrame([("noise", "dB")], "item string, unit string"))
    assert m.size("Satellite account") == 3 and np.isclose(array(m, m.resolve("e"), [(None, "Satellite account", "noise")], GOODS)[0, 0], 4 / iot_arrays()["X"][0])
    with pytest.raises(WrongInput):
        structure.add_extensions(table, cells.replace("noise", "CO2"), "E", spark.createDataFrame([("CO2", "dB")], "item string, unit string"))
    with pytest.raises(WrongInput):
        structure.add_extensions(table, cells.replace("s1", "s9"), "E", spark.createDataFrame([("noise", "dB")], "item string, unit string"))


def test_shocks_act_in_order(spark, table):
    a = iot_arrays()
    m = table.with_clusters(sector={"all": SECTORS}, region={"home": ["r1"]})
    rows = [(2, "z", "r1", "s1", "r1", "s2", "Percentage", 1.0), (1, "z", "r1", "s1", "r1", "s2", "Update", 0.1), (3, "z", "home", "all", "r2", "s3", "Absolute", 5.0), (4, "z", "r1", "s1", "r2", "s3", "Percentage", -0.5), (5, "v", None, "taxes", "r1", "s1", "Percentage", 0.2), (6, "Y", "r2", "s2", "r1", "hh", "Absolute", 7.0)]
    out = scenarios.shock(m, spark.createDataFrame(rows, scenarios.SHOCKS), "s")
    z, v, y = a["Z"] / a["X"], a["V"] / a["X"], a["Y"].copy()
    z[0, 1] = 0.2
    z[:3, 5] = (a["Z"][:3, 5] + 5) / a["X"][5]
    z[0, 5] *= 0.5
    v[0, 0] *= 1.2
    y[4, 0] += 7
    x = np.linalg.solve(np.eye(6) - z, y.sum(1))
    assert np.allclose(array(out, out.resolve("z", "s"), GOODS, GOODS), z) and np.allclose(array(out, out.resolve("X", "s"), GOODS), x)
    assert np.allclose(array(out, out.resolve("V", "s"), FACTOR_ROWS, GOODS), v * x)
    with pytest.raises(WrongInput):
        scenarios.shock(m, spark.createDataFrame([(1, "z", "r1", "s1", "r1", "s2", "Wrong", 1.0)], scenarios.SHOCKS), "s")


def test_mixes_keep_column_totals(spark, table, supply_use):
    a = iot_arrays()
    z = a["Z"] / a["X"]
    m = scenarios.supply_mix(table, spark.createDataFrame([("r1", "s1", 0.25), ("r1", "s3", 0.75)], "region string, item string, share double"), "m")
    got = array(m, m.resolve("z", "m"), GOODS, GOODS)
    assert np.allclose(got[0], 0.25 * (z[0] + z[2])) and np.allclose(got[1], z[1]) and np.allclose(got.sum(0), z.sum(0))
    m = scenarios.trade_mix(table, spark.createDataFrame([("s2", "r1", "r1", 0.1), ("s2", "r1", "r2", 0.9)], "item string, destination string, origin string, share double"), "t")
    got = array(m, m.resolve("z", "t"), GOODS, GOODS)
    assert np.allclose(got[4, :3], 0.9 * (z[1, :3] + z[4, :3])) and np.allclose(got[:, 3:], z[:, 3:])
    half = spark.createDataFrame([("r1", "a1", 0.2), ("r1", "a2", 0.3)], "region string, item string, share double")
    with pytest.raises(WrongInput):
        scenarios.supply_mix(supply_use, half, "m")
    m = scenarios.supply_mix(supply_use, half, "m", rescale=True)
    got = array(m, m.resolve("s", "m"), ACT, COM)
    assert np.isclose(got[0, 0] / got[1, 0], 0.2 / 0.3)


def test_ras(spark):
    block = spark.createDataFrame([(1, 11, 5.0), (1, 12, 1.0), (2, 11, 2.0), (2, 12, 4.0)], "i long, j long, value double")
    vector = lambda *v: spark.createDataFrame([(k, 0, x) for k, x in v], "i long, j long, value double")
    rows, columns = vector((2, 10.0), (1, 8.0)), vector((12, 11.0), (11, 7.0))
    for fitted in (balance.ras(block, rows, columns), balance.on_tiles(block, rows, columns, 1e-6, 100, size=2)):
        x = {(r.i, r.j): r.value for r in fitted.collect()}
        assert np.isclose(x[1, 11] + x[1, 12], 8, atol=1e-4) and np.isclose(x[1, 12] + x[2, 12], 11, atol=1e-4)
        assert np.isclose(x[1, 11] * x[2, 12] / (x[1, 12] * x[2, 11]), 5 * 4 / (1 * 2), rtol=1e-4)
    for wrong in ((vector((1, 8.0), (2, 11.0)), columns), (vector((1, -8.0), (2, 26.0)), columns), (vector((1, 8.0), (3, 10.0)), columns)):
        with pytest.raises(WrongInput):
            balance.ras(block, *wrong)


def test_ras_of_a_model(spark, table):
    a = iot_arrays()
    totals = lambda x: spark.createDataFrame([(r, s, float(v)) for (r, _, s), v in zip(GOODS, x, strict=True)], "region string, item string, value double")
    m = balance.ras_model(table, totals(2 * a["Z"].sum(1)), totals(2 * a["Z"].sum(0)), "fit")
    assert np.allclose(array(m, m.resolve("Z", "fit"), GOODS, GOODS), 2 * a["Z"], rtol=1e-6)


def test_operators_of_ones_own(table):
    a = iot_arrays()
    m = custom.ratio_operator(custom.product_operator(custom.sum_operator(table, "total_Z", "Z"), "ez", "e", "z"), "per_x", "V", "X")
    m = custom.zeros_operator(m, "nothing", "V", "Y")
    assert np.allclose(array(m, m.resolve("total_Z"), GOODS, [(None, "Total", "Total")])[:, 0], a["Z"].sum(1))
    assert np.allclose(array(m, m.resolve("ez"), ACCOUNT_ROWS, GOODS), (a["E"] / a["X"]) @ (a["Z"] / a["X"])) and np.allclose(array(m, m.resolve("per_x"), FACTOR_ROWS, GOODS), a["V"] / a["X"])
    assert m.resolve("nothing").isEmpty() and m.explain("ez").startswith("ez: e @ z")
    with pytest.raises(WrongInput):
        custom.register(m, "w", ("z",), lambda z: z)
    own = custom.register(table, "z", ("Z",), B.negate, override=True)
    assert array(own, own.resolve("z"), GOODS, GOODS).max() < 0
    around = custom.register(custom.register(table, "one", ("two",), lambda x: x), "two", ("one",), lambda x: x)
    with pytest.raises(NotComputable):
        around.resolve("one")


def test_eora_gases_without_totals(spark):
    good = ("r1", "Sector", "s1")
    rows = [("baseline", "Z", *good, *good, 1.0), ("baseline", "Y", *good, "r1", "Consumption category", "hh", 9.0)]
    amounts = {"CO2 emissions (Gg) - Cement production": 5.0, "CH4 emissions (Gg) - Rice cultivation": 2.0, "CO2 emissions (Gg) - Total": 100.0, "CO2b emissions (Gg) - Forest fires": 7.0}
    rows += [("baseline", "E", None, "Satellite account", f"I-GHG-{k}", *good, v) for k, v in amounts.items()]
    m = indicators.ghg_of_profile(Model.from_labelled(spark.createDataFrame(rows, LABELLED), "IOT").describe(source="Eora 26"))
    made = m.table("E").filter("item_from like 'GHG %'").collect()
    assert [r["value"] for r in made] == [pytest.approx(5.0 + 2.0 * 29.8)]
    assert m.units.filter("item like 'GHG %'").first()["unit"] == "Gg CO2eq"


def test_new_sectors(spark, table):
    a = iot_arrays()
    z, v = a["Z"] / a["X"], a["V"] / a["X"]
    m = table.with_clusters(region={"all": REGIONS})
    rows = [("new", "r1", "input", "all", "s1", "Update", 0.2), ("new", "r1", "input", None, "s2", "Percentage", 0.5), ("new", "r1", "factor", None, "wages", "Update", 0.3), ("new", "r1", "satellite", None, "CO2", "Update", 0.1)]
    demand = spark.createDataFrame([("new", "r1", CATEGORIES[0], 2.0)], "sector string, region string, category string, value double")
    out = sectors.add_sectors(m, spark.createDataFrame(rows, sectors.INVENTORY), "EUR", {"new": "s3"}, demand)
    fresh = [("r1", "Sector", "new")]
    got = array(out, out.resolve("z"), GOODS, fresh)[:, 0]
    bought = a["Z"][[0, 3], 2]
    assert np.allclose(got[[0, 3]], 0.2 * bought / bought.sum()) and np.isclose(got[1], 1.5 * z[1, 2]) and np.allclose(got[[2, 4, 5]], z[[2, 4, 5], 2])
    assert np.allclose(array(out, out.resolve("v"), FACTOR_ROWS, fresh)[:, 0], [v[0, 2], 0.3])
    assert np.isclose(array(out, out.resolve("X"), fresh)[0], 2.0)
    with pytest.raises(WrongInput):
        sectors.add_sectors(m, spark.createDataFrame([("s1", "r1", "factor", None, "wages", "Update", 1.0)], sectors.INVENTORY), "EUR")


def test_views(spark, table):
    got = views.plot_data(table.table("X"), ["item_from"], {"region_from": "r1"}, top=2).collect()
    x = iot_arrays()["X"][:3]
    assert sorted(r["value"] for r in got) == pytest.approx(sorted(x)[1:])
    assert sum(r["share"] for r in views.composition(table.table("X"), ["region_from"], "item_from").collect()) == pytest.approx(2)
    assert views.one_sheet(table).count() == table.labelled_cells().count()
    known = spark.createDataFrame([("x", 2000, 1.0), ("x", 2004, 2.0)], "region string, year int, share double")
    got = views.nearest_year(spark.createDataFrame([("x", 2002), ("x", 2003), ("y", 2000)], "region string, year int"), known).collect()
    assert sorted((r["year"], r["year_found"]) for r in got) == [(2002, 2000), (2003, 2004)]


def test_slices_wide_tables_and_path_frames(table):
    a = iot_arrays()
    assert views.sliced(table, "Z", region_from="r1", item_to=["s1", "s2"]).count() == 12
    rows = {(r["region_from"], r["item_from"]): r for r in views.wide(table, "Y").collect()}
    assert np.isclose(rows[("r1", "s2")]["r2|inv"], a["Y"][1, 3])
    found = indicators.paths(table, "CO2", max_depth=1, top=1000)
    links = views.path_links(found).collect()
    into_demand = sum(r["value"] for r in links if r["target"].startswith("FD: "))
    assert np.isclose(into_demand, sum(r["contribution"] for r in found.collect()))
    assert [r["depth"] for r in views.paths_by_depth(found).orderBy("depth").collect()] == [0, 1]


def test_settings_and_notes(table, tmp_path):
    from sectora import settings

    try:
        settings.set_method("solve")
        settings.set_names({"A": "z", "L": "w"})
        assert "solve" in table.explain("p") and np.allclose(array(table, table.resolve("A"), GOODS, GOODS), iot_arrays()["Z"] / iot_arrays()["X"])
        settings.set_dense_labels(3)
        assert table.planner(method="auto").method == "solve"
    finally:
        settings.reset()
    assert "solve" not in table.explain("p")
    for wrong in (lambda: settings.set_method("guess"), lambda: settings.set_names({"A": "z", "B": "z"}), lambda: settings.set_dense_labels(0)):
        with pytest.raises(WrongInput):
            wrong()
    m = table.describe(year=2020).note("made up")
    m.save_meta(str(tmp_path / "meta"))
    assert '"year": 2020' in m.spark.read.text(str(tmp_path / "meta")).collect()[0]["value"] and m.meta["history"][0].endswith("made up") and "history" not in table.meta
