"""Sectors split off others: part of a parent's output becomes a sector of its own, with inputs of its own, and every total of the table stays.

The columns of a parent are divided first. A child takes what its coefficients ask for at its output; where that is more than the parent has on any row
of a block, the parent's inputs there are divided by the median, over the regions where they suffice, of the child's share on each row. What is left stays
with the parent. Then the parent's sales are divided by output. So column totals, sales by buyer and the demand for factors are those of the table before,
whatever the inventory says.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..model import Model, label_id
from ..plans import blocks as B
from ..plans.kernels import stored
from ..schema import NotComputable, WrongInput
from .sectors import INVENTORY, add_sectors
from .structure import aggregate

#: quantity: the child's output in a region; a column unit may follow (null: the parent's).
OUTPUTS = "sector string, region string, quantity double"
COLUMNS = {"Z": "z", "V": "v", "E": "e"}
#: Shares beyond one by less than this are roundings.
SLACK = 1e-9


def checked_outputs(model: Model, outputs: DataFrame, parents: Mapping[str, str], scenario: str, conversions: DataFrame | None = None) -> DataFrame:
    """sector, region, parent, new, old (ids), quantity, whole (the parent's output): outputs in the parent's unit, those of a sector and region summed."""
    spark = model.spark
    table = spark.createDataFrame([*parents.items()], "sector string, parent string")
    known = model.index("Sector").select("item")
    if not table.join(known, table["parent"] == known["item"], "left_anti").isEmpty():
        raise WrongInput("a parent that the table hasn't")
    if not table.join(known.select(F.col("item").alias("sector")), "sector", "left_semi").isEmpty():
        raise WrongInput("a new sector stands already")
    if not outputs.join(table, "sector", "left_anti").isEmpty():
        raise WrongInput("an output of a sector without a parent")
    if not table.join(outputs, "sector", "left_anti").isEmpty():
        raise WrongInput("a sector to split off without any output")
    if not outputs.filter("quantity is null or isnan(quantity) or quantity < 0").isEmpty():
        raise WrongInput("outputs below zero or without a value")
    rows = outputs.join(table, "sector")
    if "unit" in outputs.columns:
        own = model.units.filter("level = 'Sector'").select(F.col("item").alias("parent"), F.col("unit").alias("unit_to"))
        rows = rows.withColumnRenamed("unit", "unit_from").join(own, "parent", "left")
        asked = rows.filter("unit_from <> unit_to").select("unit_from", "unit_to")
        found = units.factors(asked, conversions if conversions is not None else spark.createDataFrame([], units.CONVERSIONS))
        if not found.filter("factor is null").isEmpty():
            raise WrongInput("an output has a unit that doesn't convert into its parent's")
        rows = rows.join(found, ["unit_from", "unit_to"], "left").withColumn("quantity", F.col("quantity") * F.coalesce("factor", F.lit(1.0)))
    rows = rows.groupBy("sector", "region", "parent").agg(F.sum("quantity").alias("quantity")).filter("quantity > 0")
    label = lambda name: label_id(F.col("region"), F.lit("Sector"), F.col(name))
    x = model.resolve("X", scenario).select(F.col("i").alias("old"), F.col("value").alias("whole"))
    rows = stored(rows.withColumn("new", label("sector")).withColumn("old", label("parent")).join(x, "old", "left"))
    too_much = rows.groupBy("old").agg(F.sum("quantity").alias("asked"), F.coalesce(F.first("whole"), F.lit(0.0)).alias("whole")).filter(F.col("asked") > F.col("whole") * (1 + SLACK))
    if not too_much.isEmpty():
        raise WrongInput("more output is split off than the parent has")
    return rows


def _asked(flows: DataFrame, coefficients: DataFrame, children: DataFrame) -> DataFrame:
    """i, old, new, sector, has (the parent's cell), asked (the child's cell at its output): rows where either isn't zero."""
    pairs = children.select("old", "new", "sector", "quantity")
    has = flows.select("i", F.col("j").alias("old"), F.col("value").alias("has")).join(pairs, "old")
    wanted = coefficients.select("i", F.col("j").alias("new"), F.col("value").alias("per_unit")).join(pairs, "new")
    wanted = wanted.groupBy("i", "old", "new", "sector").agg(F.sum(F.col("per_unit") * F.col("quantity")).alias("asked"))
    both = has.select("i", "old", "new", "sector", "has").join(wanted, ["i", "old", "new", "sector"], "full")
    return both.withColumn("has", F.coalesce("has", F.lit(0.0))).withColumn("asked", F.coalesce("asked", F.lit(0.0)))


def divided_columns(flows: DataFrame, coefficients: DataFrame, children: DataFrame) -> DataFrame:
    """The parents' columns of a flow block divided among children and parent; other columns as they are. children: `checked_outputs`."""
    asked = stored(_asked(flows, coefficients, children))
    share = F.when(F.col("has") != 0, F.col("asked") / F.col("has"))
    beyond = asked.groupBy("old", "i").agg(F.sum("asked").alias("asked"), F.first("has").alias("has"))
    beyond = beyond.filter(((F.col("has") == 0) & (F.col("asked") != 0)) | (share > 1 + SLACK)).select("old")
    below = asked.filter(((F.col("has") == 0) & (F.col("asked") != 0)) | (share < -SLACK)).select("old")
    short = beyond.union(below).distinct().withColumn("short", F.lit(True))
    rows = asked.join(short, "old", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    usual = rows.filter("not short and has <> 0").groupBy("i", "sector").agg(F.percentile(share, 0.5).alias("usual"))
    rows = rows.filter("has <> 0").join(usual, ["i", "sector"], "left").withColumn("part", F.when(F.col("short"), F.coalesce("usual", F.lit(0.0))).otherwise(share))
    whole = rows.groupBy("i", "old").agg(F.greatest(F.sum("part"), F.lit(1.0)).alias("parts"))
    rows = rows.join(whole, ["i", "old"]).withColumn("value", F.col("has") * F.col("part") / F.col("parts"))
    taken = rows.groupBy("i", F.col("old").alias("j")).agg((-F.sum("value")).alias("value"))
    return B.add(flows, taken, rows.select("i", F.col("new").alias("j"), "value"))


def split_rows(block: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows of parents parted among their children: shares (old, new, share) say how, and what they leave stays. Every column keeps its total."""
    moved = block.join(shares, block["i"] == shares["old"]).select("i", "new", "j", (F.col("value") * F.col("share")).alias("value"))
    left = moved.select("i", "j", (-F.col("value")).alias("value"))
    return B.add(block, left, moved.select(F.col("new").alias("i"), "j", "value"))


def split_sectors(
    model: Model,
    parents: Mapping[str, str],
    outputs: DataFrame,
    inventory: DataFrame | None = None,
    scenario: str | None = None,
    conversions: DataFrame | None = None,
    rename: Mapping[str, str] | None = None,
) -> Model:
    """An input-output model in which each key of `parents` is a sector of its own, split off its parent, in the regions that `outputs` (OUTPUTS) names.

    inventory (sectors.INVENTORY): how a child's column differs from its parent's; without one the child is its parent in small. What a child takes from
    another child counts as the latter's parent's, as sales are divided by output. rename: other names for what is left of parents.
    The result has one scenario of flows; it isn't fitted to trade known from elsewhere."""
    if model.kind != "IOT":
        raise NotComputable("sectors are split in input-output tables")
    scenario = scenario or model.baseline
    children = checked_outputs(model, outputs, parents, scenario, conversions)
    empty = model.spark.createDataFrame([], INVENTORY)
    made = children.select("sector", "region")
    if inventory is not None and not inventory.join(made, ["sector", "region"], "left_anti").isEmpty():
        raise WrongInput("an inventory of a sector and region without output")
    # a child that has no inventory somewhere is its parent there: a change of nothing brings it into the table
    parent_of = model.spark.createDataFrame([*parents.items()], "sector string, parent string")
    rows = empty if inventory is None else inventory
    own = rows.select("sector", "region").distinct()
    factor = model.axis.filter("level = 'Factor of production'").select(F.col("id").alias("i"), F.col("item"))
    any_factor = model.resolve("V", scenario).join(factor, "i").groupBy(F.col("j").alias("old")).agg(F.min("item").alias("item"))
    idle = children.join(own, ["sector", "region"], "left_anti").join(any_factor, "old", "left").join(parent_of, ["sector", "parent"])
    if not idle.filter("item is null").isEmpty():
        raise NotComputable("a parent without factors needs an inventory for its children")
    nothing = idle.select("sector", "region", F.lit("factor").alias("kind"), F.lit(None).cast("string").alias("region_from"), "item", F.lit("Percentage").alias("type"), F.lit(0.0).alias("quantity"))
    grown = add_sectors(model, rows.unionByName(nothing, allowMissingColumns=True), "", parents, scenario=scenario, conversions=conversions)
    planner, after = model.planner(scenario), grown.planner(scenario)
    to_parent = children.select(F.col("new").alias("i"), "old")
    out = {}
    for flow, coefficient in COLUMNS.items():
        if not grown.has(coefficient):
            continue
        wanted = B.keep(after.resolve(coefficient), None, children.select(F.col("new").alias("id")))
        if flow == "Z":
            wanted = wanted.join(to_parent, "i", "left").select(F.coalesce("old", "i").alias("i"), "j", "value")
        out[flow] = divided_columns(planner.resolve(flow), wanted, children)
    shares = children.select("old", "new", (F.col("quantity") / F.col("whole")).alias("share"))
    out["Z"], out["Y"] = split_rows(out["Z"], shares), split_rows(planner.resolve("Y"), shares)
    out = {m: b.filter("value <> 0") for m, b in out.items()}
    for m in ("EY", "VY"):
        if model.has(m, scenario):
            out[m] = model.stored_block(m, scenario)
    unit = model.units.filter("level = 'Sector'").join(parent_of, F.col("item") == F.col("parent")).select("level", F.col("sector").alias("item"), "unit")
    base = replace(model.drop_scenarios((scenario,)), axis=grown.axis, units=model.units.unionByName(unit))
    whole = replace(base.with_blocks(scenario, out), names={scenario: tuple(sorted(out))}, baseline=scenario)
    if rename:
        whole = aggregate(whole, {"Sector": model.spark.createDataFrame([*rename.items()], "source string, target string")})
    return whole
