"""Scenarios: shocks to coefficients and demand, and new mixes of suppliers or origins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..model import Model
from ..plans import blocks as B
from ..schema import NotComputable, WrongInput

#: Rows of a shock table; labels may be names of clusters. Rows act in the order of `step`.
SHOCKS = "step int, matrix string, region_from string, item_from string, region_to string, item_to string, type string, value double"
TYPES = ("Percentage", "Absolute", "Update")
#: Where the flow of a coefficient is, and the output its columns are divided by.
FLOW_OF = {"z": ("Z", "X"), "v": ("V", "X"), "e": ("E", "X"), "u": ("U", "Xa"), "s": ("S", "Xc"), "va": ("Va", "Xa"), "vc": ("Vc", "Xc"), "ea": ("Ea", "Xa"), "ec": ("Ec", "Xc")}
#: The levels of rows and columns of what can be shocked; None: either level of goods.
SIDES = {
    "z": ("Sector", "Sector"), "v": ("Factor of production", "Sector"), "e": ("Satellite account", "Sector"), "Y": ("Sector", "Consumption category"),
    "u": ("Commodity", "Activity"), "s": ("Activity", "Commodity"), "va": ("Factor of production", "Activity"), "vc": ("Factor of production", "Commodity"),
    "ea": ("Satellite account", "Activity"), "ec": ("Satellite account", "Commodity"), "Ya": ("Activity", "Consumption category"), "Yc": ("Commodity", "Consumption category"),
}


def _members(model: Model, level: str) -> DataFrame:
    """name, member: every label of a set stands for itself, a cluster for its members; a label wins over a cluster of its name."""
    own = model.index(level).select(F.col("item").alias("name"), F.col("item").alias("member"))
    groups = model.clusters.get(level)
    if not groups:
        return own
    rows = model.spark.createDataFrame([(c, m) for c, members in groups.items() for m in members], "name string, member string")
    return own.unionByName(rows.join(own.select("name"), "name", "left_anti"))


def targets(model: Model, shocks: DataFrame, matrix: str) -> DataFrame:
    """i, j, step, type, value: every cell that a row of the shock table is about."""
    rows_level, columns_level = SIDES[matrix]
    out = shocks.filter(F.col("matrix") == matrix)
    for side, level, ident in (("from", rows_level, "i"), ("to", columns_level, "j")):
        axis = model.axis.filter(F.col("level") == level).select(F.col("id").alias(ident), F.col("region").alias("_region"), F.col("item").alias("_item"))
        items = _members(model, level).select(F.col("name").alias(f"item_{side}"), F.col("member").alias("_item"))
        regions = _members(model, "Region").select(F.col("name").alias(f"region_{side}"), F.col("member").alias("_region"))
        place = axis.join(items, "_item").join(regions, "_region", "left")  # factors have no region
        on = (out[f"item_{side}"] == place[f"item_{side}"]) & (place["_region"].isNull() | (out[f"region_{side}"] == place[f"region_{side}"]))
        out = out.join(place, on).select(*[out[c] for c in out.columns], ident)
    return out.select("i", "j", "step", "type", "value")


def shocked(block: DataFrame, hits: DataFrame, flow: DataFrame | None = None, output: DataFrame | None = None) -> DataFrame:
    """The block after its shocks, each cell's in order. Percentage: times 1 + value. Update: the value. Absolute: demand plus the value; a coefficient
    starts again from its original flow, (flow + value) / output."""
    rows = hits.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("step", "type", "value"))).alias("steps"))  # as many as the shock table has rows
    both = block.select("i", "j", F.col("value").alias("old")).join(rows, ["i", "j"], "full")
    if flow is not None:
        both = both.join(flow.select("i", "j", F.col("value").alias("flow")), ["i", "j"], "left").join(output.select(F.col("i").alias("j"), F.col("value").alias("output")), "j", "left")
    else:
        both = both.withColumn("flow", F.lit(0.0)).withColumn("output", F.lit(1.0))
    start = F.coalesce("old", F.lit(0.0))

    def act(now, s):
        added = now + s["value"] if flow is None else F.when(F.col("output") != 0, (F.coalesce("flow", F.lit(0.0)) + s["value"]) / F.col("output"))
        return F.when(s["type"] == "Percentage", now * (1 + s["value"])).when(s["type"] == "Absolute", added).otherwise(s["value"])

    new = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, act))
    return both.select("i", "j", new.alias("value")).filter("value <> 0")


def shock(model: Model, shocks: DataFrame, name: str, base: str | None = None) -> Model:
    """The model with a scenario in which the shocks (SHOCKS) have happened to the base scenario; its flows follow from the new coefficients and demand."""
    base = base or model.baseline
    if name in (model.baseline, base):
        raise WrongInput("the baseline and the base scenario can't be overwritten")
    if not shocks.filter(F.col("value").isNull() | F.isnan("value") | ~F.col("type").isin(*TYPES) | ~F.col("matrix").isin(*[m for m in SIDES if m in schema.COEFFICIENTS[model.kind]])).isEmpty():
        raise WrongInput("a shock without value, type or matrix")
    planner = model.planner(base)
    touched = {r["matrix"] for r in shocks.select("matrix").distinct().collect()}
    blocks = {}
    for m in schema.COEFFICIENTS[model.kind]:
        try:
            block = planner.resolve(m)
        except NotComputable:
            continue
        if m in touched:
            hits = targets(model, shocks, m)
            block = shocked(block, hits, *[planner.resolve(x) for x in FLOW_OF.get(m, ())])
        blocks[m] = block
    return model.with_blocks(name, blocks)


def _shares(model: Model, rows: DataFrame, group: list[str], rescale: bool) -> DataFrame:
    """rows with their weights brought to a sum of one in each group; sums away from one by over 0.01 are refused unless rescaled."""
    whole = F.sum("share").over(Window.partitionBy(*group))
    rows = rows.withColumn("whole", whole)
    if not rescale and not rows.filter(F.abs(F.col("whole") - 1) > 0.01).isEmpty():
        raise WrongInput("shares don't sum to one")
    return rows.withColumn("share", F.col("share") / F.col("whole")).drop("whole")


def redistribute(block: DataFrame, bundle: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells of a bundle's rows shared out anew, each column keeping its total. bundle: i, g, share; columns: j, g, the columns that a bundle is shared in."""
    cells = block.join(bundle, "i").join(columns, ["j", "g"])
    sums = cells.groupBy("g", "j").agg(F.sum("value").alias("total"))
    new = sums.join(bundle, "g").select("i", "j", (F.col("share") * F.col("total")).alias("value"))
    moved = cells.select("i", "j")
    return block.join(moved, ["i", "j"], "left_anti").select("i", "j", "value").unionByName(new.filter("value <> 0"))


def supply_mix(model: Model, shares: DataFrame, name: str, base: str | None = None, rescale: bool = False, columns: Iterable[str] | None = None) -> Model:
    """A scenario in which each region's bundle of suppliers has a new mix. shares: region, item, share. columns: labels of using sectors; all if None.

    Input-output tables share out rows of z and Y, supply-use tables the market shares s of activities."""
    return _mixed(model, shares, ["region"], name, base, rescale, columns, "Sector" if model.kind == "IOT" else "Activity", ("z", "Y") if model.kind == "IOT" else ("s",), False)


def trade_mix(model: Model, shares: DataFrame, name: str, base: str | None = None, rescale: bool = False) -> Model:
    """A scenario in which destinations buy an item from other origins. shares: item, destination, origin, share; origins that aren't listed keep theirs."""
    rows = shares.select("item", F.col("destination").alias("to"), F.col("origin").alias("region"), "share")
    return _mixed(model, rows, ["item", "to"], name, base, rescale, None, "Sector" if model.kind == "IOT" else "Commodity", ("z", "Y") if model.kind == "IOT" else ("u", "Yc"), True)


def _mixed(model: Model, shares: DataFrame, group: list[str], name: str, base: str | None, rescale: bool, columns: Iterable[str] | None, level: str, matrices: tuple[str, ...], by_destination: bool) -> Model:
    base = base or model.baseline
    rows = _shares(model, shares, group, rescale).withColumn("g", F.concat_ws("\1", *group))
    axis = model.axis.filter(F.col("level") == level).select(F.col("id").alias("i"), "region", "item")
    bundle = rows.join(axis, ["region", "item"]).select("i", "g", "share")
    if not rows.join(axis, ["region", "item"], "left_anti").isEmpty():
        raise WrongInput("shares of labels that the table hasn't")
    to = model.axis.filter("region is not null").select(F.col("id").alias("j"), F.col("region").alias("to"), "item", "level")
    if columns is not None:
        to = to.filter(F.col("item").isin(*list(columns)))
    groups = rows.select("g", *(["to"] if by_destination else [])).distinct()
    wide = groups.join(to, "to") if by_destination else to.crossJoin(groups)  # every region's bundle is bought in every column
    planner = model.planner(base)
    blocks = {}
    for m in schema.COEFFICIENTS[model.kind]:
        try:
            blocks[m] = planner.resolve(m)
        except NotComputable:
            continue
        if m in matrices:
            blocks[m] = redistribute(blocks[m], bundle, wide.select("j", "g"))
    return model.with_blocks(name, blocks)


def scenario_table(model: Model, matrix: str, scenarios: Mapping[str, str] | Iterable[str]) -> DataFrame:
    """scenario and labelled cells of a matrix in several scenarios."""
    out = None
    for s in scenarios:
        rows = model.table(matrix, s).select(F.lit(s).alias("scenario"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def scenario_difference(model: Model, matrix: str, scenario: str, base: str | None = None, relative: bool = False) -> DataFrame:
    return B.difference(model.resolve(matrix, scenario), model.resolve(matrix, base), relative)
