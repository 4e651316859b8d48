import zipfile

import numpy as np
import pytest
from small import ACCOUNT_ROWS, ACT, COM, FACTOR_ROWS, FINAL, GOODS, REGIONS, SECTORS, array, iot, iot_arrays, sut_arrays

from sectora.functions import primitives as P
from sectora.operators import presets, scenarios
from sectora.schema import WrongInput
from sectora.sources import matrices, registry, vendors  # noqa: F401  registers the readers


def check(m):
    a = iot_arrays()
    assert np.allclose(array(m, m.resolve("Z"), GOODS, GOODS), a["Z"]) and np.allclose(array(m, m.resolve("Y"), GOODS, FINAL), a["Y"])


def lines(*rows, sep="\t"):
    return "\n".join(sep.join(map(str, r)) for r in rows) + "\n"


def test_exiobase_folder(spark, tmp_path):
    a = iot_arrays()
    (tmp_path / "satellite").mkdir()
    head = lambda columns, blank: [[*blank, *[c[0] for c in columns]], [*blank, *[c[2] for c in columns]], ["region", "sector"][: len(blank)] + [""] * len(columns)]
    for name, x, columns in (("Z", a["Z"], GOODS), ("Y", a["Y"], FINAL)):
        (tmp_path / f"{name}.txt").write_text(lines(*head(columns, ["", ""]), *[[g[0], g[2], *r] for g, r in zip(GOODS, x, strict=True)]))
    both = np.concatenate([a["V"], a["E"]])
    names = [f[2] for f in FACTOR_ROWS] + [k[2] for k in ACCOUNT_ROWS]
    (tmp_path / "satellite/F.txt").write_text(lines(*head(GOODS, [""]), *[[n, *r] for n, r in zip(names, both, strict=True)]))
    (tmp_path / "satellite/F_Y.txt").write_text(lines(*head(FINAL, [""]), *[[k[2], *r] for k, r in zip(ACCOUNT_ROWS, a["EY"], strict=True)]))
    m = registry.read("exiobase", spark, str(tmp_path), factors=("taxes", "wages"))
    check(m)
    assert np.allclose(array(m, m.resolve("V"), FACTOR_ROWS, GOODS), a["V"]) and np.allclose(array(m, m.resolve("E"), ACCOUNT_ROWS, GOODS), a["E"]) and np.allclose(array(m, m.resolve("EY"), ACCOUNT_ROWS, FINAL), a["EY"])


def test_exiobase_supply_and_use(spark, tmp_path):
    a = sut_arrays()
    iot_dir, root = tmp_path / "iot", tmp_path / "sut"
    (iot_dir / "satellite").mkdir(parents=True)
    root.mkdir()

    def write(path, x, columns, rows, wide):
        blank = ["", ""] if wide else [""]
        head = [[*blank, *[c[0] for c in columns]], [*blank, *[c[2] for c in columns]], [*["region", "sector"][: len(blank)], *[""] * len(columns)]]
        path.write_text(lines(*head, *[[*((r[0], r[2]) if wide else (r[2],)), *v] for r, v in zip(rows, x, strict=True)]))

    for name, x, columns in (("supply", a["S"].T, ACT), ("use", a["U"], ACT), ("final_demand", a["Yc"], FINAL)):
        write(root / f"{name}.csv", x, columns, COM, True)
    write(root / "value_added.csv", a["Va"], ACT, FACTOR_ROWS, False)
    bare = registry.read("exiobase_any", spark, str(root))
    assert bare.kind == "SUT" and np.allclose(array(bare, bare.resolve("S"), ACT, COM), a["S"]) and not bare.has("Ea") and bare.meta == {"source": "exiobase monetary"}

    (root / "meta.json").write_text('{\n "year": 2011, "price": "current"\n}')
    both = np.concatenate([a["Va"], a["Ea"]])
    write(iot_dir / "satellite/F.txt", both, ACT, FACTOR_ROWS + ACCOUNT_ROWS, False)
    write(iot_dir / "satellite/F_Y.txt", a["EY"], FINAL, ACCOUNT_ROWS, False)
    (iot_dir / "satellite/unit.txt").write_text(lines(["stressor", "unit"], *[[k[2], "kg"] for k in ACCOUNT_ROWS]))
    m = registry.read("exiobase_sut", spark, str(root), extensions=str(iot_dir), factors=("taxes", "wages"))
    for name, rows, columns in (("S", ACT, COM), ("U", COM, ACT), ("Yc", COM, FINAL), ("Va", FACTOR_ROWS, ACT), ("Ea", ACCOUNT_ROWS, ACT), ("EY", ACCOUNT_ROWS, FINAL)):
        assert np.allclose(array(m, m.resolve(name), rows, columns), a[name]), name
    assert m.meta["year"] == 2011 and {(r["level"], r["unit"]) for r in m.units.collect()} == {("Activity", "EUR"), ("Commodity", "EUR"), ("Factor of production", "EUR"), ("Satellite account", "kg")}


def test_eora_files(spark, tmp_path):
    a = iot_arrays()
    for file, x in (("T", a["Z"]), ("FD", a["Y"]), ("VA", a["V"]), ("Q", a["E"]), ("QY", a["EY"])):
        (tmp_path / f"Eora26_2015_bp_{file}.txt").write_text(lines(*x))
    (tmp_path / "labels_T.txt").write_text(lines(*[(r, "R", "Industries", s) for r, _, s in GOODS]))
    (tmp_path / "labels_FD.txt").write_text(lines(*[(r, "R", "Final", c) for r, _, c in FINAL]))
    (tmp_path / "labels_VA.txt").write_text(lines(*[("Primary", f[2]) for f in FACTOR_ROWS]))
    (tmp_path / "labels_Q.txt").write_text(lines(*[("Air", k[2]) for k in ACCOUNT_ROWS]))
    m = registry.read("eora26", spark, str(tmp_path), year=2015)
    check(m)
    assert np.allclose(array(m, m.resolve("E"), [(None, "Satellite account", "Air CO2")], GOODS)[0], a["E"][0])


def test_inter_country_table(spark, tmp_path):
    a = iot_arrays()
    final = [(r, "Consumption category", c) for r in REGIONS for c in ("HFCE", "GFCF")]
    columns = [f"{r}_{s}" for r, _, s in GOODS] + [f"{r}_{c}" for r, _, c in final] + ["OUT"]
    rows = [[f"{r}_{s}", *a["Z"][i], *a["Y"][i], a["X"][i]] for i, (r, _, s) in enumerate(GOODS)]
    rows += [["TLS", *a["V"][0], 1, 2, 3, 4, 0], ["VA", *a["V"][1], 0, 0, 0, 0, 0], ["OUT", *a["X"], 0, 0, 0, 0, 0]]
    (tmp_path / "t.csv").write_text(lines(["V1", *columns], *rows, sep=","))
    m = registry.read("icio", spark, str(tmp_path / "t.csv"))
    assert np.allclose(array(m, m.resolve("Z"), GOODS, GOODS), a["Z"]) and np.allclose(array(m, m.resolve("Y"), GOODS, final), a["Y"])
    assert np.allclose(array(m, m.resolve("V"), [(None, "Factor of production", x) for x in ("TLS", "VA")], GOODS), a["V"]) and m.has("VY")


def test_long_editions(spark, tmp_path):
    a = iot_arrays()
    rows = [(r, s, q, t, a["Z"][i, j]) for i, (r, _, s) in enumerate(GOODS) for j, (q, _, t) in enumerate(GOODS)]
    rows += [(r, s, q, c, a["Y"][i, j]) for i, (r, _, s) in enumerate(GOODS) for j, (q, _, c) in enumerate(FINAL)]
    rows += [("W2", f, q, t, a["V"][i, j]) for i, (_, _, f) in enumerate(FACTOR_ROWS) for j, (q, _, t) in enumerate(GOODS)]
    (tmp_path / "f.csv").write_text(lines(("refArea", "rowPi", "counterpartArea", "colPi", "obsValue"), *rows, sep=","))
    m = registry.read("figaro", spark, str(tmp_path / "f.csv"), final=("hh", "inv"), factors=("taxes", "wages"))
    check(m)
    assert np.allclose(array(m, m.resolve("v"), FACTOR_ROWS, GOODS), a["V"] / a["X"])


def test_matrix_folder_both_ways_and_zipped(spark, tmp_path):
    a, old = iot_arrays(), iot(spark)
    matrices.write_matrix_folder(old, str(tmp_path / "table"))
    with zipfile.ZipFile(tmp_path / "table.zip", "w") as z:
        for name in ("Z", "Y", "V", "E", "EY", "units"):
            z.write(next((tmp_path / "table" / f"{name}.csv").glob("part-*")), f"inside/{name}.csv")
    for path in ("table", "table.zip"):
        m = registry.read("matrices", spark, str(tmp_path / path), kind="IOT")
        check(m)
        assert np.allclose(array(m, m.resolve("V"), FACTOR_ROWS, GOODS), a["V"]) and np.allclose(array(m, m.resolve("EY"), ACCOUNT_ROWS, FINAL), a["EY"])
        assert sorted(map(tuple, m.units.collect())) == sorted(map(tuple, old.units.collect())) and not m.has("VY")
    with pytest.raises(WrongInput):
        matrices.write_matrix_folder(old, str(tmp_path / "none"), ["Z"], sep="s")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.csv", "x")
    with pytest.raises(WrongInput):
        registry.read("matrices", spark, str(tmp_path / "bad.zip"), kind="IOT")


def test_long_supply_and_use(spark, tmp_path):
    a = sut_arrays()
    head = ("refArea", "rowCode", "counterpartArea", "colCode", "obsValue")
    made = [(c[0], c[2], r[0], r[2], a["S"][i, j]) for i, r in enumerate(ACT) for j, c in enumerate(COM)]
    used = [(r[0], r[2], c[0], c[2], a["U"][i, j]) for i, r in enumerate(COM) for j, c in enumerate(ACT)]
    used += [(r[0], r[2], c[0], c[2], a["Yc"][i, j]) for i, r in enumerate(COM) for j, c in enumerate(FINAL)] + [("W2", f[2], c[0], c[2], a["Va"][i, j]) for i, f in enumerate(FACTOR_ROWS) for j, c in enumerate(ACT)]
    for name, rows in (("s", made), ("u", used)):
        (tmp_path / f"{name}.csv").write_text(lines(head, *rows, sep=","))
    columns = {"rowCode" if k == "rowPi" else "colCode" if k == "colPi" else k: v for k, v in vendors.FIGARO_COLUMNS.items()}
    m = registry.read("figaro_sut", spark, str(tmp_path / "s.csv"), use=str(tmp_path / "u.csv"), final=("hh", "inv"), factors=("taxes", "wages"), columns=columns)
    for name, rows, tops in (("S", ACT, COM), ("U", COM, ACT), ("Yc", COM, FINAL), ("Va", FACTOR_ROWS, ACT)):
        assert np.allclose(array(m, m.resolve(name), rows, tops), a[name]), name


def test_gloria_release(spark, tmp_path):
    r = np.random.default_rng(4)
    goods = [(q, level, s) for q in REGIONS for level in ("Activity", "Commodity") for s in ("x, y", "z")]
    act, com = ([k for k, g in enumerate(goods) if g[1] == level] for level in ("Activity", "Commodity"))
    t = np.zeros((8, 8))
    t[np.ix_(act, com)], t[np.ix_(com, act)] = r.uniform(1, 9, (4, 4)), r.uniform(1, 9, (4, 4))
    y = np.zeros((8, 4))
    y[com] = r.uniform(1, 9, (4, 4))
    v, tq, yq = r.uniform(1, 9, (4, 8)), r.uniform(1, 9, (3, 8)), r.uniform(1, 9, (3, 4))
    tables, satellites, notes = tmp_path / "GLORIA_MRIOs_60_2025", tmp_path / "GLORIA_SatelliteAccounts_060_2025", tmp_path / "notes"
    for folder in (tables, satellites, notes):
        folder.mkdir()
    put = lambda folder, letters, x, markup=1: (folder / f"20260121_120secMother_AllCountries_002_{letters}-Results_2025_060_Markup{markup:03d}(full).csv").write_text(lines(*x, sep=","))
    for letters, x in (("T", t), ("Y", y), ("V", v)):
        put(tables, letters, x)
    put(tables, "T", 10 * t, 2)
    put(tables, "Y", 10 * y, 2)
    (notes / "Regions.csv").write_text("Lfd_Nr,Region_acronyms\n2,r2\n1,r1\n")
    (notes / "Sectors.csv").write_text('Lfd_Nr,Sector_names\n1,"x, y"\n2,z\n')
    (notes / "Value added and final demand.csv").write_text("Lfd_Nr,Value_added_names,Final_demand_names\n1,taxes,hh\n2,wages,inv\n")
    (notes / "Satellites.csv").write_text("Lfd_Nr,Sat_head_indicator,Sat_indicator,Sat_unit\n1,Emissions,CO2,kg\n2,Work,Hours,h\n3,Emissions,CH4,kg\n")
    read = lambda **more: registry.read("gloria", spark, str(tmp_path), labels=str(notes), year=2025, **more)
    pick = lambda k: [goods[x] for x in k]
    bare = read(markup=2)
    assert not bare.has("Ea") and np.allclose(array(bare, bare.resolve("U"), pick(com), pick(act)), 10 * t[np.ix_(com, act)])
    assert np.allclose(array(bare, bare.resolve("Va"), FACTOR_ROWS, pick(act)), (v[:2] + v[2:])[:, act])
    put(satellites, "TQ", tq)
    put(satellites, "YQ", yq)
    m = read(groups=["Emissions"])
    accounts = [(None, "Satellite account", f"Emissions | {k}") for k in ("CO2", "CH4")]
    assert np.allclose(array(m, m.resolve("S"), pick(act), pick(com)), t[np.ix_(act, com)]) and np.allclose(array(m, m.resolve("Yc"), pick(com), FINAL), y[com])
    assert np.allclose(array(m, m.resolve("Ea"), accounts, pick(act)), tq[[0, 2]][:, act]) and np.allclose(array(m, m.resolve("Ec"), accounts, pick(com)), tq[[0, 2]][:, com])
    assert np.allclose(array(m, m.resolve("EY"), accounts, FINAL), yq[[0, 2]]) and m.index("Satellite account").count() == 2
    assert {u["unit"] for u in m.units.collect()} == {"kg", "current 000 US$"}


def test_record_bundle(spark, tmp_path):
    a = iot_arrays()
    half = lambda rows: [(*r[:-1], r[-1] / 2) for r in rows for _ in range(2)]  # noqa: E731  every cell in two records
    (tmp_path / "intermediate.csv").write_text(lines(("region_from", "sector_from", "region_to", "sector_to", "value"), *half([(r, s, q, t, a["Z"][i, j]) for i, (r, _, s) in enumerate(GOODS) for j, (q, _, t) in enumerate(GOODS)]), sep=","))
    (tmp_path / "final.csv").write_text(lines(("region_from", "sector_from", "region_to", "category_to", "value"), *[(r, s, q, c, a["Y"][i, j]) for i, (r, _, s) in enumerate(GOODS) for j, (q, _, c) in enumerate(FINAL)], sep=","))
    (tmp_path / "factors.csv").write_text(lines(("factor_from", "region_to", "sector_to", "value"), *[(f, q, t, a["V"][i, j]) for i, (_, _, f) in enumerate(FACTOR_ROWS) for j, (q, _, t) in enumerate(GOODS)], sep=","))
    (tmp_path / "accounts.csv").write_text(lines(("account_from", "region_to", "sector_to", "value"), *[(k, q, t, a["E"][i, j]) for i, (_, _, k) in enumerate(ACCOUNT_ROWS) for j, (q, _, t) in enumerate(GOODS)], sep=","))
    check(registry.read("record_bundle", spark, str(tmp_path)))


def test_gtap_bundle(spark, tmp_path):
    r = np.random.default_rng(3)
    regions, sectors, agents = ("R1", "R2"), ("A", "B"), ("A", "B", "HH")
    value = lambda: float(r.integers(1, 50))
    some = lambda n, *columns: [(*[str(r.choice(c)) for c in columns], value()) for _ in range(n)]  # noqa: E731  with cells that occur more than once
    everywhere = [("VFOB", c, a, s, d, value()) for c in sectors for a in agents for s in regions for d in regions]
    flows = everywhere + some(120, ("DOM", "VFOB", "MTAX", "ITTM", "OTHER"), sectors, agents, regions, regions)
    taxes = some(40, ("ETAX", "PTAX"), (*sectors, "gone"), regions, regions)
    added = some(60, ("VA", "VTAX", "IDTAX", "IMTAX"), ("A", "LAB"), (*agents, "gone"), (*regions, "R9"))
    emissions = some(80, ("DOM", "IMP"), ("CO2", "CH4"), ("coal", "A"), agents, (*regions, "TOT"), regions)
    energy = some(80, ("DOM", "IMP"), ("coal", "oil"), agents, (*regions, "TOT"), regions)
    head = {"SRCxDST": "VAR COMM AGENT SRC DST", "XTAX": "VAR COMM SRC DST", "": "VAR COMM AGENT REG", "EMI": "VAR EM COMM AGT SRC DST", "NRG": "VAR COMM AGT SRC DST"}
    for (name, columns), rows in zip(head.items(), (flows, taxes, added, emissions, energy), strict=True):
        (tmp_path / f"GSDF{name}.csv").write_text(lines((*columns.split(), "VALUE"), *rows, sep=","))

    want = {}

    def put(matrix, row, region, agent, x):
        if region not in regions or agent not in agents or agent == "HH" and matrix is None:
            return
        name = matrix or "V"
        key = (("Y" if name == "Z" else f"{name}Y") if agent == "HH" else name, *row, region, agent)
        want[key] = want.get(key, 0) + x

    for var, c, a, s, d, x in flows:
        if var in ("DOM", "VFOB"):
            put("Z", (s, c), s if var == "DOM" else d, a, x)
        elif var != "OTHER":
            put("V", (None, f"{var}_{s}_{c}"), d, a, x)
    for var, c, s, d, x in taxes:
        put(None, (None, "PTAX_REG" if var == "PTAX" else f"ETAX_{d}"), d if var == "PTAX" else s, c, x)
    for var, c, a, g, x in added:
        if var in ("VA", "VTAX"):
            put(None, (None, f"{'VAAD' if var == 'VA' else var}_REG_{c}"), g, a, x)
        elif c in sectors:
            put("V", (None, f"{'DTAX' if var == 'IDTAX' else 'ITAX'}_REG_{c}"), g, a, x)
    for mark, rows in (("EMI", emissions), ("ENE", [(v, None, *rest) for v, *rest in energy])):
        for var, gas, c, a, s, d, x in rows:
            first = f"{mark}_{gas}" if gas else mark
            if var == "DOM" and s in (d, "TOT"):
                put("E", (None, f"{first}_dms_{c}"), d, a, x)
            elif var == "IMP" and s in regions:
                put("E", (None, f"{first}_{s}_{c}"), d, a, x)
    m = registry.read("gtap", spark, str(tmp_path))
    got = {(c["matrix"], c["region_from"], c["item_from"], c["region_to"], c["item_to"]): c["value"] for c in m.labelled_cells().collect()}
    assert got == want and {k[0] for k in want} == {"Z", "Y", "V", "VY", "E", "EY"}
    unit = {c["item"]: c["unit"] for c in m.units.collect()}
    assert unit["A"] == unit["PTAX_REG"] == "M USD" and unit["EMI_CO2_dms_coal"] == "M ton" and unit["ENE_dms_oil"] == "M toe"


def test_bare_folder_of_a_unified_supply_use_table(spark, tmp_path):
    from small import ACT, COM, sut_arrays

    a = sut_arrays()
    goods = ACT + COM
    z = np.zeros((8, 8))
    z[:4, 4:], z[4:, :4] = a["S"], a["U"]
    y = np.zeros((8, 4))
    y[4:] = a["Yc"]
    (tmp_path / "T.csv").write_text(lines(*z, sep=","))
    (tmp_path / "Y.csv").write_text(lines(*y, sep=","))
    (tmp_path / "rows.csv").write_text(lines(("region", "level", "item"), *goods, sep=","))
    (tmp_path / "final.csv").write_text(lines(("region", "level", "item"), *FINAL, sep=","))
    m = registry.read("bare_folder", spark, str(tmp_path), kind="SUT", files={"Z": "T.csv", "Y": "Y.csv"}, labels={"rows": "rows.csv", "final": "final.csv"}, sides={"Z": ("rows", "rows"), "Y": ("rows", "final")})
    assert m.names == {"baseline": ("S", "U", "Yc")} and np.allclose(array(m, m.resolve("S"), ACT, COM), a["S"])


def test_primitives(spark):
    m, a = iot(spark), iot_arrays()
    Z, Y, V, E = (m.resolve(x) for x in ("Z", "Y", "V", "E"))
    X = P.calc_X(Z, Y)
    z, v, e = P.calc_z(Z, X), P.calc_v(V, X), P.calc_e(E, X)
    w = P.calc_w(z)
    want = np.linalg.inv(np.eye(6) - a["Z"] / a["X"])
    assert np.allclose(array(m, w, GOODS, GOODS), want) and np.allclose(array(m, P.calc_X_from_z(z, Y), GOODS), a["X"]) and np.allclose(array(m, P.calc_X_from_w(w, Y), GOODS), a["X"])
    f = (a["E"] / a["X"]) @ want
    assert np.allclose(array(m, P.calc_f(e, w), ACCOUNT_ROWS, GOODS), f) and np.allclose(array(m, P.calc_f_from_z(e, z), ACCOUNT_ROWS, GOODS), f)
    assert np.allclose(array(m, P.calc_F(P.calc_f(e, w), Y), ACCOUNT_ROWS, GOODS), f * a["Y"].sum(1))
    p = ((a["V"] / a["X"]) @ want).sum(0)
    assert np.allclose(array(m, P.calc_p(v, w), GOODS), p) and np.allclose(array(m, P.calc_p_from_z(v, z), GOODS), p)
    assert np.allclose(array(m, P.calc_all_shock(z, e, v, Y)["Z"], GOODS, GOODS), a["Z"]) and np.allclose(array(m, P.calc_b(X, Z), GOODS, GOODS), a["Z"] / a["X"][:, None])


def test_mixes_from_statistics(spark):
    m, x = iot(spark), iot_arrays()["X"]
    statistics = spark.createDataFrame([("r1", "fossil", 2010, 30.0), ("r1", "green", 2010, 10.0), ("r1", "green", 2020, 5.0), ("r1", "other", 2010, 60.0)], "region string, group string, year int, value double")
    shares = presets.supply_shares(m, statistics, {"s1": "fossil", "s2": "fossil", "s3": "green"}, 2014)
    got = {(r["region"], r["item"]): r["share"] for r in shares.collect()}
    assert np.allclose([got[("r1", s)] for s in SECTORS], [0.75 * x[0] / (x[0] + x[1]), 0.75 * x[1] / (x[0] + x[1]), 0.25])
    assert scenarios.supply_mix(m, shares, "mix").has("z", "mix")
    flows = spark.createDataFrame([("r1", "r2", 2010, 0.3), ("r1", "xx", 2010, 0.4), ("r1", "r1", 2010, 0.3)], "destination string, origin string, year int, share double")
    got = {(r["destination"], r["origin"]): r["share"] for r in presets.trade_shares(m, flows, "s1", 2010).collect()}
    assert got == {("r1", "r2"): 0.5, ("r1", "r1"): 0.5, ("r2", "r2"): 1.0}
