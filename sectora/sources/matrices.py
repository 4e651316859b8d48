"""Matrices laid out as rectangles in text: label rows above, label columns to the left, or bare numbers with lists of labels beside."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..model import Model
from ..schema import WrongInput


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0, in file order), line of one text file. Counts of lines by partition come to the driver, one number each."""
    text = spark.read.text(path)
    if len(text.inputFiles()) > 1:
        raise WrongInput(f"lines are numbered in one file; {path} has several")
    lines = text.withColumn("_id", F.monotonically_increasing_id())
    split = lines.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_part"], r["count"]) for r in split.groupBy("_part").count().collect())
    first, total = {}, 0
    for part, size in sizes:
        first[part], total = total, total + size
    if not first:
        return split.select(F.lit(0).cast("long").alias("n"), F.col("value").alias("line")).limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("_part"))
    return split.select((start + F.col("_at")).alias("n"), F.col("value").alias("line"))


def read_matrix(spark: SparkSession, path: str, matrix: str, header_rows: int, index_columns: int, sep: str = ",", scenario: str = schema.BASELINE, level: str | None = None, header: Sequence[tuple] | None = None) -> DataFrame:
    """Labelled cells of a rectangle: `header_rows` lines of column labels (region, level, item; or one line of items), `index_columns` columns of row
    labels (three, or one whose level is `level`). The label lines come to the driver, the numbers stay in Spark."""
    lines = numbered_lines(spark, path)
    split = lambda text: [x.strip().strip('"') for x in text.split(sep)]
    if header is None:
        top = [split(r["line"]) for r in lines.filter(F.col("n") < header_rows).orderBy("n").collect()]  # the lines of labels only
        header = [tuple(t[k] for t in top) for k in range(index_columns, max(map(len, top)))]
    if not header:
        raise WrongInput("no column labels")
    names = spark.createDataFrame([(k, *(c if len(c) == 3 else (None, None, c[0]))) for k, c in enumerate(header)], "k int, region_to string, level_to string, item_to string")
    fields = F.transform(F.split("line", sep if sep != "|" else r"\|"), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    rows = lines.filter((F.col("n") >= header_rows) & (F.trim("line") != "")).select(fields.alias("f"))
    own = [F.get("f", F.lit(k)) for k in range(index_columns)]
    blank = lambda c: F.when(c != "", c)
    labels = [blank(c) for c in own] if index_columns == 3 else [F.lit(None).cast("string"), F.lit(level), blank(own[0])]
    cells = rows.select(*[c.alias(n) for c, n in zip(labels, ("region_from", "level_from", "item_from"), strict=True)], F.posexplode(F.slice("f", index_columns + 1, len(header))).alias("k", "x"))
    cells = cells.withColumn("value", F.expr("try_cast(nullif(x, '') as double)")).join(F.broadcast(names), "k")  # a row for each column of the file
    return cells.select(F.lit(scenario).alias("scenario"), F.lit(matrix).alias("matrix"), "region_from", "level_from", "item_from", "region_to", "level_to", "item_to", "value").filter("value <> 0 or value is null or isnan(value)")


def read_bare(spark: SparkSession, path: str, matrix: str, rows: DataFrame, columns: DataFrame, sep: str = "\t", scenario: str = schema.BASELINE) -> DataFrame:
    """Labelled cells of a file of numbers only; rows and columns list the labels (n, region, level, item) by place, from 0."""
    side = lambda t, s, k: t.select(F.col("n").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("region", "level", "item")])
    cells = numbered_lines(spark, path).select(F.col("n").alias("i"), F.posexplode(F.split("line", sep)).alias("j", "x"))
    cells = cells.withColumn("value", F.expr("try_cast(trim(x) as double)")).filter("value <> 0 or value is null or isnan(value)").join(side(rows, "from", "i"), "i").join(side(columns, "to", "j"), "j")
    return cells.select(F.lit(scenario).alias("scenario"), F.lit(matrix).alias("matrix"), "region_from", "level_from", "item_from", "region_to", "level_to", "item_to", "value")


def write_matrix_folder(model: Model, path: str, matrices: Iterable[str] | None = None, scenario: str | None = None, sep: str = ",") -> None:
    """One text file a matrix, as the reader "matrices" takes them, and units.csv: three lines of column labels, then a line a row with its labels (only
    the item for factors and accounts) and a number for each column. Such a file is written by one task, as its lines have an order. Labels come to the driver."""
    for name in matrices or [m for m in model.names[scenario or model.baseline] if m in schema.FLOWS[model.kind] or m in ("Z", "Y", "V", "E")]:
        block = model.resolve(name, scenario)
        sides = []
        for side in "ij":
            levels = [r["level"] for r in block.select(F.col(side).alias("id")).distinct().join(model.axis, "id").select("level").distinct().collect()]
            sides.append(model.axis.filter(F.col("level").isin(*levels)).orderBy("level", "region", "item").collect())
        rows, columns = sides
        if not columns:
            raise WrongInput(f"{name} has no cells, or is a vector")
        if any(sep in (x or "") or "\n" in (x or "") for r in (*rows, *columns) for x in r[1:]):
            raise WrongInput(f"a label of {name} has the separator in it")
        bare = all(r["region"] is None for r in rows)
        own = lambda r: [r["item"]] if bare else [r["region"] or "", r["level"], r["item"]]
        spark, width = model.spark, 1 if bare else 3
        top = spark.createDataFrame([(k - 3, sep.join([""] * width + [c[("region", "level", "item")[k]] or "" for c in columns])) for k in range(3)], "n long, line string")
        place = lambda side, labels: spark.createDataFrame([(r["id"], k) for k, r in enumerate(labels)], f"{side} long, {'n' if side == 'i' else 'k'} long")
        grid = place("i", rows).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(columns) - 1).cast("long"))).alias("k")).withColumn("value", F.lit(0.0))
        cells = block.join(place("i", rows), "i").join(place("j", columns), "j").select("n", "k", "value").unionByName(grid).groupBy("n", "k").agg(F.sum("value").alias("value"))
        numbers = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"].cast("string")), sep)
        names = spark.createDataFrame([(k, sep.join(own(r))) for k, r in enumerate(rows)], "n long, label string")
        lines = cells.groupBy("n").agg(numbers.alias("numbers")).join(names, "n").select("n", F.concat_ws(sep, "label", "numbers").alias("line"))
        top.unionByName(lines).repartition(1).sortWithinPartitions("n").select("line").write.text(f"{path}/{name}.csv")
    model.units.coalesce(1).write.option("header", True).option("sep", sep).csv(f"{path}/units.csv")


def from_wide(frame: DataFrame, matrix: str, index: Sequence[str], columns: dict[str, tuple[str | None, str, str]], level: str | None = None, scenario: str = schema.BASELINE) -> DataFrame:
    """Labelled cells of a wide DataFrame: index names its label columns (region, level, item; or item with a level), columns maps the others to labels."""
    spark = frame.sparkSession
    long = frame.unpivot(list(index), list(columns), "_column", "value")
    names = spark.createDataFrame([(c, *label) for c, label in columns.items()], "_column string, region_to string, level_to string, item_to string")
    own = dict(zip(("region_from", "level_from", "item_from"), index, strict=True)) if len(index) == 3 else {"item_from": index[0]}
    null = F.lit(None).cast("string")
    labels = [(F.col(own[c]) if c in own else F.lit(level) if c == "level_from" else null).alias(c) for c in ("region_from", "level_from", "item_from")]
    out = long.join(F.broadcast(names), "_column")  # a row for each column of the frame
    return out.select(F.lit(scenario).alias("scenario"), F.lit(matrix).alias("matrix"), *labels, "region_to", "level_to", "item_to", F.col("value").cast("double").alias("value"))


def from_pandas(spark: SparkSession, frames: dict, kind: str, units: DataFrame | None = None) -> Model:
    """A model of pandas blocks: matrix -> frame, whose index and columns have three levels (region, level, item), or one for factors and accounts."""
    levels = {"V": "Factor of production", "E": "Satellite account"}
    out = None
    for matrix, frame in frames.items():
        rows = [(*(i if isinstance(i, tuple) else (None, levels[matrix[0].upper()], i)), *j, float(frame.at[i, j])) for i in frame.index for j in frame.columns]
        cells = spark.createDataFrame(rows, "region_from string, level_from string, item_from string, region_to string, level_to string, item_to string, value double")
        cells = cells.select(F.lit(schema.BASELINE).alias("scenario"), F.lit(matrix).alias("matrix"), "*")
        out = cells if out is None else out.unionByName(cells)
    return Model.from_labelled(out, kind, units)


def template(spark: SparkSession, sets: dict[str, Iterable[str]], matrices: Iterable[str], kind: str) -> DataFrame:
    """Labelled cells of value zero for every pair of labels of the matrices: what a user fills in."""
    regions = list(sets["Region"])
    goods = [(r, level, x) for level in schema.LEVELS[kind] for r in regions for x in sets[level]]
    final = [(r, "Consumption category", x) for r in regions for x in sets["Consumption category"]]
    rows = {"V": [(None, "Factor of production", x) for x in sets["Factor of production"]], "E": [(None, "Satellite account", x) for x in sets["Satellite account"]]}
    out = None
    for m in matrices:
        left = rows.get(m[0].upper(), goods)
        right = final if m[0] == "Y" or m.endswith("Y") else goods
        side = lambda labels, s: spark.createDataFrame(labels, f"region_{s} string, level_{s} string, item_{s} string")
        cells = side(left, "from").crossJoin(side(right, "to")).select(F.lit(schema.BASELINE).alias("scenario"), F.lit(m).alias("matrix"), "*", F.lit(0.0).alias("value"))
        out = cells if out is None else out.unionByName(cells)
    return out
