import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from small import ACCOUNT_ROWS, GOODS, array, iot, iot_arrays

from sectora.model import Model
from sectora.schema import LABELLED, WrongInput
from sectora.sources import flat, matrices, records, registry


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_flat_round_trip(spark, tmp_path, format):
    m = iot(spark)
    flat.write_flat(m, str(tmp_path / "t"), format)
    again = registry.read("flat", spark, str(tmp_path / "t"), kind="IOT", format=format)
    assert again.names == m.names and np.allclose(array(again, again.resolve("Z"), GOODS, GOODS), iot_arrays()["Z"])
    flat.write_units(m, str(tmp_path / "u"), format)


def test_flat_forms(spark):
    nine = spark.createDataFrame([("Z", "r", "Sector", "s", "r", "Sector", "t", "1.5"), ("E", "", "Satellite account", "CO2", "r", "Sector", "s", "2")], "Matrix string, Region_from string, Level_from string, Item_from string, Region_to string, Level_to string, Item_to string, Value string")
    m = Model.from_labelled(flat.from_flat(nine), "IOT")
    assert m.names == {"baseline": ("E", "Z")}
    columns = flat.to_flat(m.labelled_cells()).columns
    assert "Sector_from" in columns and "Activity_from" not in columns and "Satellite account_from" in columns
    with pytest.raises(WrongInput):
        flat.from_flat(spark.createDataFrame([(1,)], "a int"))


def test_rows_of_factors_may_name_a_good(spark, tmp_path):
    rows = [("V", "r1", "s1", "wages", "r1", "s1", 2.0), ("V", "r1", "s2", "wages", "r1", "s1", 3.0), ("V", None, None, "taxes", "r1", "s1", 4.0), ("Z", "r1", "s1", None, "r1", "s1", 1.0)]
    flat_rows = spark.createDataFrame(rows, "Matrix string, Region_from string, Sector_from string, `Factor of production_from` string, Region_to string, Sector_to string, Value double")
    m = Model.from_labelled(flat.from_flat(flat_rows), "IOT")
    assert {r["item"] for r in m.index("f").collect()} == {"wages @ s1", "wages @ s2", "taxes"}
    flat.write_flat(m, str(tmp_path / "t"))
    again = flat.read_flat(spark, str(tmp_path / "t"), "IOT")
    assert again.same_sets(m) and "s2" in {r["Sector_from"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}


def test_export(spark):
    got = flat.export(iot(spark), ["E", "e"], filters={"region_to": ["r1"], "item_from": ["CO2"]})
    assert {(r["matrix"], r["unit"]) for r in got.collect()} == {("E", "kg"), ("e", "kg/EUR")} and got.count() == 6


def test_matrix_files(spark, tmp_path):
    a = iot_arrays()
    lines = [",,," + ",".join(g[k] for g in GOODS) for k in range(3)] + [",".join(g) + "," + ",".join(map(str, a["Z"][i])) for i, g in enumerate(GOODS)]
    (tmp_path / "Z.csv").write_text("\n".join(lines) + "\n")
    lines = ["," + ",".join(g[k] for g in GOODS) for k in range(3)] + [k[2] + "," + ",".join(map(str, a["E"][i])) for i, k in enumerate(ACCOUNT_ROWS)]
    (tmp_path / "E.csv").write_text("\n".join(lines))
    wide = dict(header_rows=3, index_columns=3)
    m = registry.read("matrices", spark, str(tmp_path), kind="IOT", matrices_={"Z": wide, "E": dict(header_rows=3, index_columns=1, level="Satellite account")})
    assert np.allclose(array(m, m.resolve("Z"), GOODS, GOODS), a["Z"]) and np.allclose(array(m, m.resolve("E"), ACCOUNT_ROWS, GOODS), a["E"])


def test_bare_numbers(spark, tmp_path):
    a = iot_arrays()["Z"]
    (tmp_path / "z.txt").write_text("\n".join("\t".join(map(str, r)) for r in a))
    labels = spark.createDataFrame([(n, *g) for n, g in enumerate(GOODS)], "n long, region string, level string, item string")
    m = Model.from_labelled(matrices.read_bare(spark, str(tmp_path / "z.txt"), "Z", labels, labels), "IOT")
    assert np.allclose(array(m, m.resolve("Z"), GOODS, GOODS), a)


def test_wide_frames_and_pandas(spark):
    wide = spark.createDataFrame([("r1", "Sector", "s1", 1.0, 2.0)], "region string, level string, item string, a double, b double")
    cells = matrices.from_wide(wide, "Z", ["region", "level", "item"], {"a": GOODS[0], "b": GOODS[1]})
    assert sorted(r["value"] for r in cells.collect()) == [1.0, 2.0]
    names = pd.MultiIndex.from_tuples(GOODS)
    a = iot_arrays()
    m = matrices.from_pandas(spark, {"Z": pd.DataFrame(a["Z"], names, names), "E": pd.DataFrame(a["E"], ["CO2", "CH4"], names)}, "IOT")
    assert np.allclose(array(m, m.resolve("E"), ACCOUNT_ROWS, GOODS), a["E"])


def test_records_add_up(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", 1.0), ("A", "x", 2.0), ("B", "x", 4.0)], "c string, d string, value double")
    codes = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "code string, label string")
    got = records.scatter(records.decoded(rows, {"c": codes}), {"matrix": F.lit("Z"), "item_from": "c", "item_to": "d"})
    assert sorted((r["item_from"], r["value"]) for r in got.collect()) == [("Alpha", 3.0), ("Beta", 4.0)]
    with pytest.raises(WrongInput):
        records.decoded(rows, {"d": codes})
    with pytest.raises(WrongInput):
        records.scatter(rows, {"other": "c"})
    (tmp_path / "l.csv").write_text("geo,unit,obs\nIT,EUR,1.5 p\nIT,USD,9\nFR,EUR,:\n")
    got = records.read_long(spark, str(tmp_path / "l.csv"), {"geo": "region", "obs": "value"}, {"unit": "EUR"})
    assert [(r["region"], r["value"]) for r in got.collect()] == [("IT", 1.5)]


def test_templates_and_registry(spark):
    sets = {"Region": ["r"], "Sector": ["s", "t"], "Factor of production": ["f"], "Satellite account": ["k"], "Consumption category": ["n"]}
    assert matrices.template(spark, sets, ["Z", "Y", "V", "EY"], "IOT").groupBy("matrix").count().collect().__len__() == 4
    registry.register_reader("mine", lambda spark, path: path, replace=True)
    assert registry.read("mine", spark, "p") == "p"
    with pytest.raises(WrongInput):
        registry.register_reader("flat", None)
    with pytest.raises(WrongInput):
        registry.read("unknown", spark, "p")


def test_values_with_flags(spark, tmp_path):
    (tmp_path / "f.csv").write_text("geo,v\na,12.3 e\nb,1 234 567.5bp\nc,:\nd,: c\ne,-3e2\nf,.5 p\ng,\n")
    got = {r["r"]: r["value"] for r in records.read_long(spark, str(tmp_path / "f.csv"), {"geo": "r", "v": "value"}).collect()}
    assert got == {"a": 12.3, "b": 1234567.5, "e": -300.0, "f": 0.5}
    (tmp_path / "g.csv").write_text("geo,v\na,x12\n")
    with pytest.raises(WrongInput):
        records.read_long(spark, str(tmp_path / "g.csv"), {"geo": "r", "v": "value"})


def test_lines_are_numbered_in_one_file_only(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("1\n2\n")
    assert [r["n"] for r in matrices.numbered_lines(spark, str(tmp_path / "a.txt")).orderBy("n").collect()] == [0, 1]
    with pytest.raises(WrongInput):
        matrices.numbered_lines(spark, str(tmp_path))


def test_cells_that_cannot_be_read_are_refused(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\tx\n0\t2\n")
    labels = spark.createDataFrame([(k, "r", "Sector", f"s{k}") for k in (0, 1)], "n long, region string, level string, item string")
    cells = matrices.read_bare(spark, str(tmp_path / "t.txt"), "Z", labels, labels)
    assert sorted(r["value"] for r in cells.collect() if r["value"] is not None) == [1.0, 2.0] and cells.filter("value is null").count() == 1
    with pytest.raises(WrongInput):
        Model.from_labelled(cells, "IOT")
