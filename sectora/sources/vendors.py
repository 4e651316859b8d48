"""Readers for the text forms in which well-known multi-regional tables are published; each is a few lines over the generic readers.

Paths are folders or files in any store that Spark reads. Workbook editions aren't read.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..model import Model
from ..schema import WrongInput
from . import archives, matrices, records, registry

LABELS = ["region", "level", "item"]


def _lines(spark: SparkSession, path: str, n: int, sep: str) -> list[list[str]]:
    """The first lines of a file, split."""
    found = matrices.numbered_lines(spark, path).filter(F.col("n") < n).orderBy("n").collect()
    return [[x.strip().strip('"') for x in r["line"].split(sep)] for r in found]


def _two_level(spark: SparkSession, path: str, matrix: str, header_rows: int, index: tuple[str, ...], column_level: str, row_level: str, sep: str = "\t") -> DataFrame:
    """Cells of a rectangle whose columns are labelled by two lines (region, item) and whose rows by (region, item) or by (item)."""
    top = _lines(spark, path, 2, sep)
    width = len(index)
    header = [(r, column_level, x) for r, x in zip(top[0][width:], top[1][width:], strict=True)]
    cells = matrices.read_matrix(spark, path, matrix, header_rows, width, sep, level=row_level, header=header) if width == 1 else _two_index(spark, path, matrix, header_rows, header, row_level, sep)
    return cells


def _two_index(spark: SparkSession, path: str, matrix: str, header_rows: int, header: list[tuple], row_level: str, sep: str) -> DataFrame:
    names = spark.createDataFrame([(k, *c) for k, c in enumerate(header)], "k int, region_to string, level_to string, item_to string")
    rows = matrices.numbered_lines(spark, path).filter((F.col("n") >= header_rows) & (F.trim("line") != "")).select(F.split("line", sep).alias("f"))
    cells = rows.select(F.trim(F.get("f", F.lit(0))).alias("region_from"), F.lit(row_level).alias("level_from"), F.trim(F.get("f", F.lit(1))).alias("item_from"), F.posexplode(F.slice("f", 3, len(header))).alias("k", "x"))
    cells = cells.withColumn("value", F.expr("try_cast(trim(x) as double)")).filter("value <> 0 or value is null or isnan(value)").join(F.broadcast(names), "k")  # a row for each column of the file
    return cells.select(F.lit(schema.BASELINE).alias("scenario"), F.lit(matrix).alias("matrix"), "region_from", "level_from", "item_from", "region_to", "level_to", "item_to", "value")


def read_exiobase(spark: SparkSession, path: str, factors: tuple[str, ...] = (), header_rows: int = 3) -> Model:
    """Industry-by-industry or product-by-product folders with Z.txt, Y.txt and satellite/F.txt, F_Y.txt: tabs, two lines of column labels and one of names.
    factors: rows of the satellite file that are value added."""
    at = lambda name: posixpath.join(path, name)
    cells = _two_level(spark, at("Z.txt"), "Z", header_rows, LABELS[:2], "Sector", "Sector")
    cells = cells.unionByName(_two_level(spark, at("Y.txt"), "Y", header_rows, LABELS[:2], "Consumption category", "Sector"))
    for name, matrix, level in (("satellite/F.txt", "E", "Sector"), ("satellite/F_Y.txt", "EY", "Consumption category")):
        rows = _two_level(spark, at(name), matrix, header_rows, ("item",), level, "Satellite account")
        own = F.col("item_from").isin(*factors)
        rows = rows.withColumn("matrix", F.when(own, "V" if matrix == "E" else "VY").otherwise(F.col("matrix"))).withColumn("level_from", F.when(own, "Factor of production").otherwise(F.col("level_from")))
        cells = cells.unionByName(rows)
    return Model.from_labelled(cells, "IOT")


def read_exiobase_any(spark: SparkSession, path: str, **options) -> Model:
    """A supply-use folder where supply.csv is there, else an input-output one."""
    return (read_exiobase_sut if archives.exists(spark, posixpath.join(path, "supply.csv")) else read_exiobase)(spark, path, **options)


def read_exiobase_sut(spark: SparkSession, path: str, extensions: str | None = None, factors: tuple[str, ...] = (), currency: str = "EUR", header_rows: int = 3) -> Model:
    """Supply-use folders with supply.csv and use.csv (products by industries), final_demand.csv and value_added.csv: tabs, two lines of column labels and one
    of names. meta.json beside them, if there, goes to the metadata. extensions: the folder of the industry table of the same year, whose satellite rows
    but those in factors become accounts of the activities."""
    at = lambda name: posixpath.join(path, name)
    supply = _two_level(spark, at("supply.csv"), "S", header_rows, LABELS[:2], "Activity", "Commodity")
    turned = [F.col(f"{c}_{'to' if s == 'from' else 'from'}").alias(f"{c}_{s}") for s in ("from", "to") for c in LABELS]
    cells = supply.select("scenario", "matrix", *turned, "value")
    cells = cells.unionByName(_two_level(spark, at("use.csv"), "U", header_rows, LABELS[:2], "Activity", "Commodity"))
    cells = cells.unionByName(_two_level(spark, at("final_demand.csv"), "Yc", header_rows, LABELS[:2], "Consumption category", "Commodity"))
    cells = cells.unionByName(_two_level(spark, at("value_added.csv"), "Va", header_rows, ("item",), "Activity", "Factor of production"))
    if extensions:
        for name, matrix, level in (("F.txt", "Ea", "Activity"), ("F_Y.txt", "EY", "Consumption category")):
            rows = _two_level(spark, posixpath.join(extensions, "satellite", name), matrix, header_rows, ("item",), level, "Satellite account")
            cells = cells.unionByName(rows.filter(~F.col("item_from").isin(*factors)) if factors else rows)
    out = Model.from_labelled(cells, "SUT")
    money = out.axis.filter(F.col("level").isin("Activity", "Commodity", "Factor of production")).select("level", "item").distinct()
    units = money.withColumn("unit", F.lit(currency))
    if extensions:
        told = spark.read.option("header", True).option("sep", "\t").csv(posixpath.join(extensions, "satellite", "unit.txt"))
        accounts = out.axis.filter(F.col("level") == "Satellite account").select("level", "item")
        units = units.unionByName(accounts.join(told.select(F.col(told.columns[0]).alias("item"), F.trim("unit").alias("unit")), "item").select("level", "item", "unit"))
    return replace(out, units=units, meta={"source": "exiobase monetary", **_json_beside(spark, at("meta.json"))})


def _json_beside(spark: SparkSession, path: str) -> dict:
    """A small JSON file; nothing where it isn't there."""
    if not archives.exists(spark, path):
        return {}
    return json.loads("\n".join(r["line"] for r in matrices.numbered_lines(spark, path).orderBy("n").collect()))


def read_eora26(spark: SparkSession, path: str, year: int, price: str = "bp") -> Model:
    """Bare tab matrices T, FD, VA, Q with lists of labels (labels_T.txt, labels_FD.txt, labels_VA.txt, labels_Q.txt) whose columns are country, code,
    entity, item (accounts: account, item)."""
    at = lambda name: posixpath.join(path, name)
    level = {"T": "Sector", "FD": "Consumption category", "VA": "Factor of production", "Q": "Satellite account"}

    def side(name: str) -> DataFrame:
        rows = matrices.numbered_lines(spark, at(f"labels_{name}.txt")).filter(F.trim("line") != "").select("n", F.split("line", "\t").alias("f"))
        if name in ("T", "FD"):
            return rows.select("n", F.trim(F.get("f", F.lit(0))).alias("region"), F.lit(level[name]).alias("level"), F.trim(F.get("f", F.lit(3))).alias("item"))
        item = F.concat_ws(" ", *[F.trim(F.get("f", F.lit(k))) for k in (0, 1)])
        return rows.select("n", F.lit(None).cast("string").alias("region"), F.lit(level[name]).alias("level"), F.trim(item).alias("item"))

    out = None
    for file, matrix, rows, columns in (("T", "Z", "T", "T"), ("FD", "Y", "T", "FD"), ("VA", "V", "VA", "T"), ("Q", "E", "Q", "T"), ("QY", "EY", "Q", "FD")):
        cells = matrices.read_bare(spark, at(f"Eora26_{year}_{price}_{file}.txt"), matrix, side(rows), side(columns))
        out = cells if out is None else out.unionByName(cells)
    return Model.from_labelled(out, "IOT")


#: The rows below and the final-demand columns beside the square of the inter-country table.
ICIO_FACTORS, ICIO_FINAL = ("TLS", "VA"), ("HFCE", "NPISH", "GGFC", "GFCF", "INVNT", "DPABR", "NONRES")


def read_icio(spark: SparkSession, path: str) -> Model:
    """The inter-country table in comma-separated text: labels COUNTRY_CODE on both sides, factor rows TLS and VA, totals OUT."""
    top = _lines(spark, path, 1, ",")[0][1:]
    header = []
    for c in top:
        region, _, code = c.partition("_")
        header.append((region, "Consumption category" if code in ICIO_FINAL else "Sector" if code else "Total", code or c))
    cells = matrices.read_matrix(spark, path, "Z", 1, 1, ",", level="Sector", header=header).filter("level_to <> 'Total' and item_from <> 'OUT'")
    factor = F.col("item_from").isin(*ICIO_FACTORS)
    cells = cells.withColumn("region_from", F.when(~factor, F.substring_index("item_from", "_", 1))).withColumn("level_from", F.when(factor, "Factor of production").otherwise(F.col("level_from")))
    cells = cells.withColumn("item_from", F.when(factor, F.col("item_from")).otherwise(F.expr("substring(item_from, locate('_', item_from) + 1)")))
    final = F.col("level_to") == "Consumption category"
    matrix = F.when(factor & final, "VY").when(factor, "V").when(final, "Y").otherwise("Z")
    return Model.from_labelled(cells.withColumn("matrix", matrix).filter("value is not null"), "IOT")


def read_long_table(spark: SparkSession, path: str, kind: str, columns: Mapping[str, str], final: tuple[str, ...], factors: tuple[str, ...], filters: Mapping[str, str] | None = None) -> Model:
    """Long statistics of an input-output or use table, as statistical offices publish them: one line a cell. columns: file column -> region_from, item_from,
    region_to, item_to, value. final and factors: codes of demand columns and of factor rows; totals are left out by the filters or beforehand."""
    return Model.from_labelled(_long_cells(spark, path, kind, columns, final, factors, filters), kind)


def _long_cells(spark: SparkSession, path: str, kind: str, columns: Mapping[str, str], final: tuple[str, ...], factors: tuple[str, ...], filters: Mapping[str, str] | None = None) -> DataFrame:
    need = {"item_from", "item_to", "value"}
    if need - set(columns.values()):
        raise WrongInput(f"columns must give {sorted(need)}")
    rows = records.read_long(spark, path, columns, filters)
    for c in ("region_from", "region_to"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit("all"))
    goods = ("Sector", "Sector") if kind == "IOT" else ("Commodity", "Activity")
    factor, demand = F.col("item_from").isin(*factors), F.col("item_to").isin(*final)
    use, take, own = ("Z", "Y", "V") if kind == "IOT" else ("U", "Yc", "Va")
    keys = {
        "matrix": F.when(factor & demand, "VY").when(factor, own).when(demand, take).otherwise(use), "region_from": F.when(~factor, F.col("region_from")), "level_from": F.when(factor, "Factor of production").otherwise(goods[0]),
        "item_from": "item_from", "region_to": "region_to", "level_to": F.when(demand, "Consumption category").otherwise(goods[1]), "item_to": "item_to",
    }
    return records.scatter(rows, keys)


#: Columns, demand codes and factor codes of the long European inter-country editions.
FIGARO_COLUMNS = {"refArea": "region_from", "rowPi": "item_from", "counterpartArea": "region_to", "colPi": "item_to", "obsValue": "value"}
FIGARO_FINAL = ("P3_S13", "P3_S14", "P3_S15", "P51G", "P5M")
FIGARO_FACTORS = ("B2A3G", "D1", "D21X31", "D29X39", "OP_NRES", "OP_RES")


def read_figaro(spark: SparkSession, path: str, final: tuple[str, ...] = FIGARO_FINAL, factors: tuple[str, ...] = FIGARO_FACTORS, columns: Mapping[str, str] | None = None) -> Model:
    """The long comma-separated edition: refArea, rowPi, counterpartArea, colPi, obsValue, or as columns says."""
    return read_long_table(spark, path, "IOT", columns or FIGARO_COLUMNS, final, factors)


def read_figaro_sut(spark: SparkSession, supply: str, use: str, final: tuple[str, ...] = FIGARO_FINAL, factors: tuple[str, ...] = FIGARO_FACTORS, columns: Mapping[str, str] | None = None) -> Model:
    """The long supply and use editions, products by industries in both: a supply record's row is the product, its column the industry that makes it."""
    columns = columns or FIGARO_COLUMNS
    made = records.read_long(spark, supply, columns)
    keys = {"matrix": F.lit("S"), "region_from": "region_to", "level_from": F.lit("Activity"), "item_from": "item_to", "region_to": "region_from", "level_to": F.lit("Commodity"), "item_to": "item_from"}
    return Model.from_labelled(records.scatter(made, keys).unionByName(_long_cells(spark, use, "SUT", columns, final, factors)), "SUT")


#: Files of the power edition's bundle, its marks of flows, taxes and accounts, and the units of its rows.
GTAP_FILES = {"flows": "GSDFSRCxDST.csv", "taxes": "GSDFXTAX.csv", "added": "GSDF.csv", "emissions": "GSDFEMI.csv", "energy": "GSDFNRG.csv"}
GTAP_ADDED = {"VA": "VAAD", "VTAX": "VTAX", "IDTAX": "DTAX", "IMTAX": "ITAX"}
GTAP_UNITS = {"money": "M USD", "EMI": "M ton", "ENE": "M toe"}


def read_gtap(spark: SparkSession, path: str) -> Model:
    """The bundle of record files of the power edition, each with a header; records of one cell add up, in one aggregation over all files.

    Sectors are the commodities of the flows, final demand is every other agent there, regions are their sources and destinations; these labels, some
    hundreds, come to the driver. A record counts where the labels it needs are among them. Domestic accounts stand where source and destination agree, or
    where the source is TOT; the rows of those imported name their source."""
    rows = {k: spark.read.option("header", True).csv(posixpath.join(path, f)) for k, f in GTAP_FILES.items()}
    rows = {k: r.toDF(*[c.strip().upper() for c in r.columns]) for k, r in rows.items()}
    flows = rows["flows"]
    found = flows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in ("COMM", "AGENT", "SRC", "DST")])).alias("l")).select("l.*").distinct().collect()
    label = lambda *columns: {r["x"] for r in found if r["c"] in columns and r["x"] is not None}
    sectors, regions = sorted(label("COMM")), sorted(label("SRC", "DST"))
    final = sorted(label("AGENT") - set(sectors))
    among = lambda c, labels: F.col(c).isin(*labels) if labels else F.lit(False)
    named = lambda *parts: F.concat_ws("_", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    var, comm, src, dst = (F.col(c) for c in ("VAR", "COMM", "SRC", "DST"))

    def cells(df: DataFrame, letter: str, item: Column, agent: str, region_to: Column, level: Column, region_from: Column | None = None) -> DataFrame:
        """Cells in columns of sectors or of final demand, by what the agent is."""
        demand = among(agent, final)
        matrix = F.when(demand, "Y" if letter == "Z" else f"{letter}Y").otherwise(letter)
        df = df.withColumn("_to", region_to).filter((among(agent, sectors) | demand) & among("_to", regions))
        nowhere = F.lit(None).cast("string")
        return df.select(
            F.lit(schema.BASELINE).alias("scenario"), matrix.alias("matrix"), (nowhere if region_from is None else region_from).alias("region_from"), level.alias("level_from"), item.alias("item_from"), F.col("_to").alias("region_to"),
            F.when(demand, "Consumption category").otherwise("Sector").alias("level_to"), F.col(agent).alias("item_to"), F.col("VALUE").cast("double").alias("value"),
        )

    sector, factor, account = (F.lit(x) for x in ("Sector", "Factor of production", "Satellite account"))
    own = var.isin("IDTAX", "IMTAX")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in GTAP_ADDED.items() for x in kv]), var)
    added = rows["added"].filter(var.isin(*GTAP_ADDED) & F.when(own, among("COMM", sectors)).otherwise(among("AGENT", sectors)))
    taxes = rows["taxes"].filter((var == "PTAX") | ((var == "ETAX") & among("DST", regions))).filter(among("COMM", sectors))
    out = [
        cells(flows.filter(var.isin("DOM", "VFOB")), "Z", comm, "AGENT", F.when(var == "DOM", src).otherwise(dst), sector, src),
        cells(flows.filter(var.isin("MTAX", "ITTM")), "V", named(var, src, comm), "AGENT", dst, factor),
        cells(taxes, "V", F.when(var == "PTAX", "PTAX_REG").otherwise(named("ETAX", dst)), "COMM", F.when(var == "PTAX", dst).otherwise(src), factor),
        cells(added, "V", named(kind, "REG", comm), "AGENT", F.col("REG"), factor),
    ]
    for name, mark, gas in (("emissions", "EMI", [F.col("EM")] if "EM" in rows["emissions"].columns else []), ("energy", "ENE", [])):
        home = (var == "DOM") & ((src == dst) | (src == "TOT"))
        some = rows[name].filter(home | ((var == "IMP") & among("SRC", regions)))
        out.append(cells(some, "E", named(mark, *gas, F.when(var == "DOM", "dms").otherwise(src), comm), "AGT", dst, account))
    whole = Model.from_labelled(reduce(DataFrame.unionByName, out), "IOT")
    unit = F.lit(GTAP_UNITS["money"])
    for mark in ("EMI", "ENE"):
        unit = F.when((F.col("level") == "Satellite account") & F.col("item").startswith(mark), GTAP_UNITS[mark]).otherwise(unit)
    return replace(whole, units=whole.axis.select("level", "item").distinct().withColumn("unit", unit), meta={"source": "gtap"})


def read_record_bundle(spark: SparkSession, path: str, regions: DataFrame | None = None) -> Model:
    """A folder of record files, each with a header: intermediate.csv (region_from, sector_from, region_to, sector_to, value), final.csv (region_from,
    sector_from, region_to, category_to, value), factors.csv (factor_from, region_to, sector_to, value), accounts.csv (account_from, region_to, sector_to, value).
    Records of one cell add up. regions: code, label."""
    out = None
    level = {"sector": "Sector", "category": "Consumption category", "factor": "Factor of production", "account": "Satellite account"}
    for name, matrix, row, column in (("intermediate", "Z", "sector", "sector"), ("final", "Y", "sector", "category"), ("factors", "V", "factor", "sector"), ("accounts", "E", "account", "sector")):
        rows = spark.read.option("header", True).csv(posixpath.join(path, f"{name}.csv"))
        if regions is not None:
            rows = records.decoded(rows, {c: regions for c in ("region_from", "region_to") if c in rows.columns})
        keys = {"matrix": F.lit(matrix), "level_from": F.lit(level[row]), "item_from": f"{row}_from", "region_to": "region_to", "level_to": F.lit(level[column]), "item_to": f"{column}_to"}
        if row == "sector":
            keys["region_from"] = "region_from"
        cells = records.scatter(rows, keys)
        out = cells if out is None else out.unionByName(cells)
    return Model.from_labelled(out, "IOT")


def read_bare_folder(spark: SparkSession, path: str, kind: str, files: Mapping[str, str], labels: Mapping[str, str], sides: Mapping[str, tuple[str, str]], sep: str = ",", units: DataFrame | None = None) -> Model:
    """A folder of headerless number files, as the largest tables are published. files: matrix -> file; labels: list -> file with a header and the columns
    region, level, item, in order of the rows; sides: matrix -> (list of the rows, list of the columns). Unified supply-use matrices are split by level."""
    lists = {}
    for name, file in labels.items():
        rows = matrices.numbered_lines(spark, posixpath.join(path, file)).filter((F.col("n") > 0) & (F.trim("line") != "")).select((F.col("n") - 1).alias("n"), F.split("line", sep).alias("f"))
        blank = lambda k: F.when(F.trim(F.get("f", F.lit(k))) != "", F.trim(F.get("f", F.lit(k))))
        lists[name] = rows.select("n", *[blank(k).alias(c) for k, c in enumerate(LABELS)])
    out = None
    for matrix, file in files.items():
        rows, columns = sides[matrix]
        cells = matrices.read_bare(spark, posixpath.join(path, file), matrix, lists[rows], lists[columns], sep)
        out = cells if out is None else out.unionByName(cells)
    return Model.from_labelled(out, kind, units)


def read_gloria(spark: SparkSession, path: str, labels: str, year: int, markup: int = 1, groups: Iterable[str] | None = None) -> Model:
    """The headerless supply-use release below path, a folder for the tables and one for the satellite accounts of the year: T, V, Y and, if there, TQ and YQ.
    Value added that has no file of its own markup is that of markup 1. Each region has its activities before its commodities; value added adds up over
    the regions that give it.

    labels: a folder with the sheets of the release's notes as Regions.csv, Sectors.csv, Value added and final demand.csv, Satellites.csv, each with its
    header; these lists come to the driver. groups: only satellite accounts of these heads."""

    def sheet(name: str) -> list:
        return sorted(spark.read.option("header", True).csv(posixpath.join(labels, f"{name}.csv")).collect(), key=lambda r: int(r["Lfd_Nr"]))

    regions, sectors = [r["Region_acronyms"] for r in sheet("Regions")], [r["Sector_names"] for r in sheet("Sectors")]
    both, accounts = sheet("Value added and final demand"), sheet("Satellites")
    column = lambda c: [r[c] for r in both if r[c]]
    heads = None if groups is None else set(groups)
    if heads is not None and (wrong := heads - {r["Sat_head_indicator"] for r in accounts}):
        raise WrongInput(f"no accounts have the head {sorted(wrong)}")
    name = lambda r: f"{r['Sat_head_indicator']} | {r['Sat_indicator']}"
    rows = {
        "goods": [(r, level, s) for r in regions for level in ("Activity", "Commodity") for s in sectors],
        "final": [(r, "Consumption category", c) for r in regions for c in column("Final_demand_names")],
        "factors": [(None, "Factor of production", f) for _ in regions for f in column("Value_added_names")],
    }
    lists = {k: spark.createDataFrame([(n, *x) for n, x in enumerate(v)], "n long, region string, level string, item string") for k, v in rows.items()}
    kept = [(n, None, "Satellite account", name(r)) for n, r in enumerate(accounts) if heads is None or r["Sat_head_indicator"] in heads]
    lists["accounts"] = spark.createDataFrame(kept, "n long, region string, level string, item string")

    def file(letters: str, markup: int) -> str | None:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, f"*_{year}", f"*_{letters}-Results_{year}_*_Markup{markup:03d}(full).csv"))
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        if found is not None and len(found) > 1:
            raise WrongInput(f"{letters} of {year} has several files")
        return found[0].getPath().toString() if found else None

    out = None
    for letters, matrix, side, top in (("T", "Z", "goods", "goods"), ("Y", "Y", "goods", "final"), ("V", "V", "factors", "goods"), ("TQ", "E", "accounts", "goods"), ("YQ", "EY", "accounts", "final")):
        at = file(letters, 1 if letters in ("TQ", "YQ") else markup) or (file(letters, 1) if letters == "V" else None)
        if at is None:
            if letters in ("TQ", "YQ"):
                continue
            raise WrongInput(f"no file of {letters} for {year}, markup {markup}")
        cells = matrices.read_bare(spark, at, matrix, lists[side], lists[top], ",")
        out = cells if out is None else out.unionByName(cells)
    units = [(level, s, "current 000 US$") for level in ("Activity", "Commodity") for s in sectors] + [("Factor of production", f, "current 000 US$") for f in column("Value_added_names")]
    units += [("Satellite account", name(r), r["Sat_unit"]) for r in accounts if heads is None or r["Sat_head_indicator"] in heads]
    return replace(Model.from_labelled(out, "SUT", spark.createDataFrame(units, schema.UNITS)), meta={"source": "gloria", "year": year})


for _name, _reader in (("bare_folder", read_bare_folder), ("exiobase", read_exiobase), ("exiobase_sut", read_exiobase_sut), ("exiobase_any", read_exiobase_any), ("eora26", read_eora26), ("icio", read_icio), ("long_table", read_long_table), ("figaro", read_figaro), ("figaro_sut", read_figaro_sut), ("gloria", read_gloria), ("gtap", read_gtap), ("record_bundle", read_record_bundle)):
    registry.register_reader(_name, _reader, replace=True)
