"""New sectors from inventories: what one unit of a new sector takes, allotted over regions and items, added to the coefficients."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import units
from ..model import Model, label_id
from ..plans import blocks as B
from ..plans.kernels import stored
from ..schema import NotComputable, WrongInput

#: sector: the new sector or activity; kind: input, factor or satellite; region_from: a region, a cluster of them or null for the target's own; item: a label
#: or a cluster of them; type: Update or Percentage.
INVENTORY = "sector string, region string, kind string, region_from string, item string, type string, quantity double"
SHARES = "sector string, region string, commodity string, share double"
DEMAND = "sector string, region string, category string, value double"

#: What a new column is called, what it takes from and what its output is sold as, by kind of table.
MAKER = {"IOT": "Sector", "SUT": "Activity"}
GOOD = {"IOT": "Sector", "SUT": "Commodity"}
FLOW = {"IOT": {"input": "Z", "factor": "V", "satellite": "E"}, "SUT": {"input": "U", "factor": "Va", "satellite": "Ea"}}
COEFFICIENT = {"IOT": {"input": "z", "factor": "v", "satellite": "e"}, "SUT": {"input": "u", "factor": "va", "satellite": "ea"}}
#: Blocks that new columns leave as they are.
UNCHANGED = {"IOT": (), "SUT": ("vc", "ec", "Ya")}
KEYS = ("j", "region", "region_from", "item", "type")


def level_of(kind: str, model: Model) -> str:
    return {"input": GOOD[model.kind], "factor": "Factor of production", "satellite": "Satellite account"}[kind]


def convert_units(inventory: DataFrame, model: Model, conversions: DataFrame | None = None) -> DataFrame:
    """Quantities in the units of the table's labels; inventory has a column unit, null where the quantity is in them already. Units convert by prefix and
    power, and by `conversions` (units.CONVERSIONS) and whatever follows from these; units that don't are refused. Percentages have no unit."""
    if conversions is None:
        conversions = model.spark.createDataFrame([], units.CONVERSIONS)
    levels = F.create_map(*[F.lit(x) for k in FLOW[model.kind] for x in (k, level_of(k, model))])
    own = model.units.select(F.col("level").alias("_level"), "item", F.col("unit").alias("unit_to")).distinct()
    rows = inventory.withColumn("_level", levels[F.col("kind")]).join(own, ["_level", "item"], "left").drop("_level")
    asked = (F.col("type") == "Update") & F.col("unit").isNotNull() & F.col("unit_to").isNotNull() & (F.col("unit") != F.col("unit_to"))
    found = units.factors(rows.filter(asked).select(F.col("unit").alias("unit_from"), "unit_to"), conversions)
    if not found.filter("factor is null").isEmpty():
        raise WrongInput("an inventory has a unit that doesn't convert into its label's")
    out = rows.withColumnRenamed("unit", "unit_from").join(found, ["unit_from", "unit_to"], "left")
    return out.withColumn("quantity", F.col("quantity") * F.when(F.col("type") == "Update", F.coalesce("factor", F.lit(1.0))).otherwise(1.0)).drop("factor", "unit_from", "unit_to")


def _members(model: Model, level: str, cluster: str, member: str) -> DataFrame:
    """The members of a set's clusters; a label wins over a cluster of its name."""
    pairs = [(c, m) for c, members in model.clusters.get(level, {}).items() for m in members]
    table = model.spark.createDataFrame(pairs, f"{cluster} string, {member} string")
    return table.join(model.index(level).select(F.col("item").alias(cluster)), cluster, "left_anti")


def _goods(model: Model, fresh: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """i, supplier, good, like: all goods, and the one whose purchases tell where a good comes from (its own, a new good's parent's)."""
    table = model.spark.createDataFrame([*patterns.items()], "good string, parent string")
    names = (F.col("id").alias("i"), F.col("region").alias("supplier"), F.col("item").alias("good"))
    old = model.axis.filter(F.col("level") == GOOD[model.kind]).select(*names).withColumn("like", F.col("i"))
    new = fresh.select(*names).join(table, "good", "left").withColumn("like", label_id(F.col("supplier"), F.lit(GOOD[model.kind]), F.col("parent")))
    return old.unionByName(new.withColumn("like", F.when(F.col("parent").isNotNull(), F.col("like"))).drop("parent"))


def _sources(model: Model, rows: DataFrame, flows: DataFrame, heirs: DataFrame, fresh: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Input rows with every good (i) they may come from, and what is bought of it: by the parent, where a row names a cluster of regions and its sector
    has one, else by all buyers of the target region."""
    spread = rows.join(_members(model, "Region", "region_from", "member"), "region_from", "left").join(_members(model, GOOD[model.kind], "item", "part"), "item", "left")
    spread = spread.withColumn("wide", F.col("member").isNotNull()).withColumn("supplier", F.coalesce("member", "region_from")).withColumn("good", F.coalesce("part", "item"))
    spread = spread.join(_goods(model, fresh, patterns), ["supplier", "good"])
    place = model.axis.select(F.col("id").alias("j"), "region")
    bought = flows.join(place, "j").groupBy(F.col("i").alias("like"), "region").agg(F.sum("value").alias("all_buyers"))
    own = flows.join(heirs, flows["j"] == heirs["old"]).groupBy(F.col("i").alias("like"), F.col("new").alias("j")).agg(F.sum("value").alias("parent_buys"))
    spread = spread.join(bought, ["like", "region"], "left").join(own, ["like", "j"], "left").join(heirs.select(F.col("new").alias("j"), "old"), "j", "left")
    basis = F.when(F.col("wide") & F.col("old").isNotNull(), F.col("parent_buys")).otherwise(F.col("all_buyers"))
    return spread.withColumn("basis", F.coalesce(basis, F.lit(0.0)))


def _accounts(model: Model, kind: str, rows: DataFrame, flows: DataFrame, heirs: DataFrame) -> DataFrame:
    """Rows of factors or accounts with every label (i) of that name or cluster: weighted by the parent's column, in clusters by all columns."""
    level = level_of(kind, model)
    known = model.axis.filter(F.col("level") == level).select(F.col("id").alias("i"), F.col("item").alias("account"))
    spread = rows.join(_members(model, level, "item", "part"), "item", "left").withColumn("account", F.coalesce("part", "item")).join(known, "account")
    whole = flows.groupBy("i").agg(F.sum("value").alias("all_columns"))
    own = flows.join(heirs, flows["j"] == heirs["old"]).select("i", F.col("new").alias("j"), F.col("value").alias("parent_has"))
    spread = spread.join(whole, "i", "left").join(own, ["i", "j"], "left")
    spread = spread.withColumn("basis", F.coalesce(F.when(F.col("part").isNotNull(), F.col("all_columns")).otherwise(F.col("parent_has")), F.lit(0.0)))
    one = Window.partitionBy(*KEYS)
    return spread.withColumn("basis", F.when(F.sum("basis").over(one) > 0, F.col("basis")).otherwise(1.0))


def _allotted(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """i, j, type, quantity: Update rows divided over their labels by basis, Percentage rows at each of them."""
    one = Window.partitionBy(*KEYS)
    spread = stored(spread.withColumn("many", F.count(F.lit(1)).over(one) > 1).withColumn("whole", F.sum("basis").over(one)))
    if not rows.join(spread.select(*KEYS), [*KEYS], "left_anti").isEmpty():
        raise WrongInput("an inventory names an item that the table hasn't")
    if not spread.filter("many and whole = 0 and type = 'Update'").isEmpty():
        raise WrongInput("an input is split over regions none of which sells it there")
    part = F.when(F.col("many") & (F.col("type") == "Update"), F.col("quantity") * F.col("basis") / F.col("whole")).otherwise(F.col("quantity"))
    return spread.groupBy("i", "j", "type").agg(F.sum(part).alias("quantity"))


def _columns(named: DataFrame, base: DataFrame) -> DataFrame:
    """New columns: the parent's (base), with what Update rows name replaced and what Percentage rows name changed by that share."""
    updates = named.filter("type = 'Update'").select("i", "j", F.col("quantity").alias("value"))
    changed = named.filter("type = 'Percentage'")
    if not changed.join(base, ["i", "j"], "left_anti").isEmpty():
        raise WrongInput("a percentage of an input that no parent has")
    scaled = base.join(changed, ["i", "j"]).select("i", "j", (F.col("value") * (1 + F.col("quantity"))).alias("value"))
    rest = base.join(named.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", "value")
    return B.add(rest, scaled, updates).filter("value <> 0")


def add_sectors(
    model: Model,
    inventory: DataFrame,
    unit: str,
    parents: Mapping[str, str] | None = None,
    demand: DataFrame | None = None,
    scenario: str | None = None,
    conversions: DataFrame | None = None,
    shares: DataFrame | None = None,
    goods: Mapping[str, str] | None = None,
) -> Model:
    """A model with new sectors, or new activities and commodities, in its coefficients. inventory: INVENTORY, and optionally a column unit (`convert_units`).

    A sector with a parent starts from the parent's column; its inventory's Update rows replace what they name, Percentage rows change the parent's
    coefficient by that share. An input from a cluster of regions is divided by what the sector's parent buys there (all buyers of the region if it has no
    parent), one from a cluster of items by what all buyers buy, one of a new good like its parent good; a pattern without any purchase is an error. Factors and accounts that
    stand on several rows are divided by the parent's column, else evenly, clusters of them by their totals. Sums over sheets add up.
    demand (DEMAND): final demand for the sector, in supply-use tables for the commodity, in the same region; a null category is the first by name.
    Supply-use tables: shares (SHARES) are the new activities' shares in commodities of their region, which replace what stands there and leave other
    makers' as they are; commodities that the table hasn't become new ones, and `goods` names their parents. Other kinds of table ignore both."""
    sut = model.kind == "SUT"
    if "unit" in inventory.columns:
        inventory = convert_units(inventory, model, conversions)
    parents, goods = dict(parents or {}), dict(goods or {})
    scenario = scenario or model.baseline
    planner = model.planner(scenario)
    maker, good = MAKER[model.kind], GOOD[model.kind]
    new = inventory.select("sector", "region").distinct()
    if sut and shares is not None:
        new = new.unionByName(shares.select("sector", "region")).distinct()
    if not new.join(model.index(maker).select(F.col("item").alias("sector")), "sector", "left_semi").isEmpty():
        raise WrongInput("a new sector stands already")
    if not new.join(model.index("Region").select(F.col("item").alias("region")), "region", "left_anti").isEmpty():
        raise WrongInput("a new sector of a region that the table hasn't")
    label = lambda level, name: label_id(F.col("region"), F.lit(level), F.col(name))
    axis = new.select(label(maker, "sector").alias("id"), "region", F.lit(maker).alias("level"), F.col("sector").alias("item"))
    fresh = axis
    if sut:
        made = model.spark.createDataFrame([], SHARES) if shares is None else shares.withColumn("j", label(good, "commodity"))
        known = model.axis.select(F.col("id").alias("j"))
        fresh = axis.limit(0)
        if shares is not None:
            fresh = made.join(known, "j", "left_anti").select(F.col("j").alias("id"), "region", F.lit(good).alias("level"), F.col("commodity").alias("item")).distinct()
        axis = axis.unionByName(fresh)
    table = model.spark.createDataFrame([*parents.items()], "sector string, parent string")
    heirs = new.join(table, "sector").select(label(maker, "sector").alias("new"), label(maker, "parent").alias("old"))
    keyed = inventory.withColumn("j", label(maker, "sector")).withColumn("region_from", F.coalesce("region_from", "region"))
    out = {}
    for kind, m in COEFFICIENT[model.kind].items():
        rows = keyed.filter(F.col("kind") == kind).groupBy(*KEYS).agg(F.sum("quantity").alias("quantity"))
        try:
            before, flows = planner.resolve(m), planner.resolve(FLOW[model.kind][kind])
        except NotComputable:
            if kind == "input" or not rows.isEmpty():
                raise
            continue  # a table without accounts gets none
        spread = _sources(model, rows, flows, heirs, fresh, goods if sut else parents) if kind == "input" else _accounts(model, kind, rows, flows, heirs)
        base = before.join(heirs, before["j"] == heirs["old"]).select("i", F.col("new").alias("j"), "value")
        out[m] = B.concat(before, _columns(_allotted(rows, spread), base))
    if sut:
        out["s"] = planner.resolve("s")
        if shares is not None:
            set_to = made.groupBy(label(maker, "sector").alias("i"), "j").agg(F.sum("share").alias("value"))
            out["s"] = B.concat(out["s"].join(set_to, ["i", "j"], "left_anti"), set_to.filter("value <> 0"))
        for m in UNCHANGED[model.kind]:
            try:
                out[m] = planner.resolve(m)
            except NotComputable:
                continue
    final = "Yc" if sut else "Y"
    out[final] = planner.resolve(final)
    if demand is not None:
        first = model.index("Consumption category").agg(F.min("item")).first()[0]
        to = label_id(F.col("region"), F.lit("Consumption category"), F.coalesce("category", F.lit(first)))
        cells = demand.select(label(good, "sector").alias("i"), to.alias("j"), "value")
        places = model.axis.select(F.col("id").alias("i")).unionByName(axis.select(F.col("id").alias("i")))
        if not cells.join(places, "i", "left_anti").isEmpty():
            raise WrongInput("final demand for a good that the table hasn't")
        out[final] = B.add(out[final], cells)
    for m in ("EY", "VY"):
        if model.has(m, scenario):
            out[m] = model.stored_block(m, scenario)
    all_units = model.units.unionByName(axis.select("level", "item", F.lit(unit).alias("unit")).distinct()).distinct()
    base = replace(model.drop_scenarios((scenario,)), axis=model.axis.unionByName(axis), units=all_units)
    return replace(base.with_blocks(scenario, out), names={scenario: tuple(sorted(out))}, baseline=scenario)
