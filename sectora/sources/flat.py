"""Flat files: one row for each cell, in the engine's labelled form, in set columns, or in the nine-column form; Parquet or delimited text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..model import Model
from ..schema import FLAT_SETS, WrongInput

#: The sets that name an item; a region alone is none.
ITEM_SETS = FLAT_SETS[1:]
#: A row of factors or accounts that also names a good (say, wages of a sector) is the item "factor @ good".
OWNERS, GOODS, AT = ("Factor of production", "Satellite account"), ("Sector", "Activity", "Commodity"), " @ "


def flat_schema() -> str:
    sides = [f"`{s}_{side}` string" for side in ("from", "to") for s in FLAT_SETS]
    return ", ".join(["Scenario string", "Matrix string", *sides, "Value double"])


def from_flat(rows: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Labelled cells of rows in set columns (Scenario, Matrix, Region_from, Sector_from, ..., Value) or in nine columns (Region_from, Level_from, Item_from,
    Region_to, Level_to, Item_to beside Scenario, Matrix, Value). Columns may be missing; blanks are null. keep: further columns to take along."""
    have = {c.lower(): c for c in rows.columns}
    clean = lambda c: F.when(F.trim(rows[have[c.lower()]].cast("string")) != "", F.trim(rows[have[c.lower()]].cast("string"))) if c.lower() in have else F.lit(None).cast("string")
    if "value" not in have or "matrix" not in have:
        raise WrongInput("flat files have columns Matrix and Value")
    nine = "level_from" in have or "level_to" in have

    def side(s: str) -> list[Column]:
        if nine:
            return [clean(f"Region_{s}"), clean(f"Level_{s}"), clean(f"Item_{s}")]
        level, item = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in (*GOODS, "Consumption category", *OWNERS):
            c = clean(f"{name}_{s}")
            label = F.concat_ws(AT, c, *[clean(f"{g}_{s}") for g in GOODS]) if name in OWNERS else c
            level, item = F.when(c.isNotNull(), F.lit(name)).otherwise(level), F.when(c.isNotNull(), label).otherwise(item)
        return [clean(f"Region_{s}"), level, item]

    labels = [c.alias(f"{n}_{s}") for s in ("from", "to") for n, c in zip(("region", "level", "item"), side(s), strict=True)]
    return rows.select(F.coalesce(clean("Scenario"), F.lit(schema.BASELINE)).alias("scenario"), clean("Matrix").alias("matrix"), *labels, rows[have["value"]].cast("double").alias("value"), *keep)


def to_flat(cells: DataFrame, trim: bool = True, goods: str = "Sector") -> DataFrame:
    """Rows in set columns; sets that no cell has are left out if trimmed. goods: the set of the goods that rows of factors may name."""
    columns = []
    for s in ("from", "to"):
        columns.append(F.col(f"region_{s}").alias(f"Region_{s}"))
        level, item = F.col(f"level_{s}"), F.col(f"item_{s}")
        owner, at = level.isin(*OWNERS), F.instr(item, AT) > 0
        for name in ITEM_SETS:
            own = F.when(level == name, F.when(owner, F.substring_index(item, AT, 1)).otherwise(item))
            # the good of a factor's row goes to the column of the table's goods
            columns.append((F.coalesce(own, F.when(owner & at, F.substring_index(item, AT, -1))) if name == goods else own).alias(f"{name}_{s}"))
    out = cells.select(F.col("scenario").alias("Scenario"), F.col("matrix").alias("Matrix"), *columns, F.col("value").alias("Value"))
    if trim:
        sets = out.columns[2:-1]
        filled = out.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(sets)]).first()  # one count a column
        out = out.drop(*[c for k, c in enumerate(sets) if not filled[str(k)]])
    return out


def read_flat(spark: SparkSession, path: str, kind: str, format: str = "parquet", sep: str = ",", units: DataFrame | None = None, tech: str = "industry") -> Model:
    """A model of a flat file or folder. Delimited text is read with a header; Spark prunes columns and pushes filters to Parquet by itself."""
    rows = spark.read.parquet(path) if format == "parquet" else spark.read.option("header", True).option("sep", sep).csv(path)
    return Model.from_labelled(from_flat(rows), kind, units, tech)


def write_flat(model: Model, path: str, format: str = "parquet", sep: str = ",", scenarios: Iterable[str] | None = None, trim: bool = True) -> None:
    """All stored cells; Parquet is parted by scenario and matrix, so that reading one matrix reads no other."""
    rows = to_flat(model.labelled_cells(scenarios), trim, model.levels[0])
    if format == "parquet":
        # matrix names differ by case alone; folders keep case on every store that Spark writes to
        rows.withColumn("scenario_part", F.col("Scenario")).withColumn("matrix_part", F.hex("Matrix")).write.partitionBy("scenario_part", "matrix_part").parquet(path)
    else:
        rows.write.option("header", True).option("sep", sep).csv(path)


def write_units(model: Model, path: str, format: str = "parquet") -> None:
    if format == "parquet":
        model.units.write.parquet(path)
    else:
        model.units.write.option("header", True).csv(path)


#: Which side's unit a coefficient or flow takes first.
UNIT_LEVELS = ("Satellite account", "Factor of production", "Commodity", "Activity", "Sector")


def with_units(cells: DataFrame, units: DataFrame) -> DataFrame:
    """cells with a column unit: of the row for flows, row over column for coefficients."""
    by = lambda s: units.select(F.col("level").alias(f"level_{s}"), F.col("item").alias(f"item_{s}"), F.col("unit").alias(f"unit_{s}"))
    out = cells.join(by("from"), ["level_from", "item_from"], "left").join(by("to"), ["level_to", "item_to"], "left")
    first = F.substring("matrix", 1, 1)
    per = F.concat(F.coalesce("unit_from", F.lit("")), F.lit("/"), F.coalesce("unit_to", F.lit("")))
    return out.withColumn("unit", F.when(first == F.upper(first), F.coalesce("unit_from", F.lit(""))).otherwise(per)).drop("unit_from", "unit_to")


def export(model: Model, matrices: Iterable[str], scenarios: Iterable[str] | None = None, filters: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Labelled cells of matrices, made if need be, with units. filters: column -> labels; a filter binds only rows that have that label."""
    out = None
    for s in scenarios or (model.baseline,):
        for m in matrices:
            rows = model.table(m, s).select(F.lit(s).alias("scenario"), F.lit(m).alias("matrix"), "*")
            out = rows if out is None else out.unionByName(rows)
    for column, allowed in (filters or {}).items():
        out = out.filter(F.col(column).isNull() | F.col(column).isin(*list(allowed)))
    return with_units(out, model.units)
