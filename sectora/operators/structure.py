"""Operators that change the structure of a model: aggregation, conversion to input-output form, trade layouts, subsets of regions, new extensions.

All work on labelled cells: labels are rewritten by expressions and joins, and cells that come to stand at the same labels add up in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..model import Model, label_id
from ..plans import blocks as B
from ..plans import kernels as K
from ..plans.kernels import stored
from ..schema import BASELINE, NotComputable, WrongInput, set_name
from .indicators import is_chenery_moses

LABELS = [f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")]


def flows_only(model: Model) -> Model:
    """The model with every scenario brought back to its flows."""
    for s in model.names:
        if set(model.names[s]) - set(schema.FLOWS[model.kind]) or not set(model.names[s]) & set(schema.FLOWS[model.kind][:2]):
            model = model.reset(s, "flows")
    return model


def checked_map(model: Model, level: str, pairs: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """source, target of a set: unknown sources are refused, so are labels without a target unless those keep their name."""
    known = model.index(level).select(F.col("item").alias("source"))
    pairs = pairs.select("source", "target").dropna().distinct()
    if not pairs.join(known, "source", "left_anti").isEmpty():
        raise WrongInput(f"the map of {level} has labels that the table hasn't")
    if not pairs.groupBy("source").count().filter("count > 1").isEmpty():
        raise WrongInput(f"the map of {level} sends a label to several targets")
    if not ignore_missing and not known.join(pairs, "source", "left_anti").isEmpty():
        raise WrongInput(f"the map of {level} leaves labels out")
    return pairs


def mixed_units(model: Model, maps: dict[str, DataFrame]) -> DataFrame:
    """level, target of groups whose members differ in unit."""
    out = model.spark.createDataFrame([], "level string, target string")
    for level, pairs in maps.items():
        units = model.units.filter(F.col("level") == level).join(pairs, F.col("item") == F.col("source"))
        out = out.unionByName(units.groupBy("level", "target").agg(F.countDistinct("unit").alias("n")).filter("n > 1").select("level", "target"))
    return out


#: Coefficients and the output that their columns are shares of.
COLUMN_SHARES = {"IOT": {"z": "X", "v": "X", "e": "X"}, "SUT": {"u": "Xa", "va": "Xa", "ea": "Xa", "s": "Xc", "vc": "Xc", "ec": "Xc"}}


def aggregate(model: Model, maps: dict[str, DataFrame], drop: Iterable[str] = (), ignore_missing: bool = True, check: bool = True, keep_empty: bool = True) -> Model:
    """Labels replaced by the groups that `maps` (set -> source, target) puts them in, flows summed, in every scenario; what is derived is made anew.

    drop: target labels of satellite accounts that are left out. Groups of unlike units are refused. Without check the maps are trusted.
    keep_empty: coefficients of columns without output, which no flow can carry, outlive the aggregation where a whole group has no output, as if each of
    its columns had the same tiny output."""
    whole, model = model, flows_only(model)
    maps = {set_name(k, model.kind): v for k, v in maps.items()}
    if check:
        maps = {k: checked_map(model, k, v, ignore_missing) for k, v in maps.items()}
        if not mixed_units(model, maps).isEmpty():
            raise WrongInput("a group has members of unlike units")
    axis, units, drop = model.axis, model.units, list(drop)
    cells = _mapped_cells(model.labelled_cells(), maps, drop)
    for level in maps:
        if level == "Region":
            axis = _mapped(axis, maps[level], "region", F.lit(True))
        else:
            axis = _mapped(axis, maps[level], "item", F.col("level") == level)
            units = _mapped(units, maps[level], "item", F.col("level") == level).distinct()
    if drop:
        gone = (F.col("level") == "Satellite account") & F.col("item").isin(*drop)
        axis, units = axis.filter(~gone), units.filter(~gone)
    out = Model.from_labelled(cells, model.kind, units, model.tech, check=False, names=model.names, labels=axis, meta=model.meta, baseline=model.baseline)
    for scenario in whole.names if keep_empty else ():
        out = _with_empty_columns(whole, out, scenario, maps, drop)
    return out


def _mapped(df: DataFrame, pairs: DataFrame, column: str, on: Column) -> DataFrame:
    pairs = pairs.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    return df.join(pairs, (F.col(column) == F.col("_source")) & on, "left").withColumn(column, F.coalesce("_target", column)).drop("_source", "_target")


def _mapped_cells(cells: DataFrame, maps: dict[str, DataFrame], drop: list[str]) -> DataFrame:
    """Labelled cells under the names of their groups."""
    for level, pairs in maps.items():
        for side in ("from", "to"):
            where = F.lit(True) if level == "Region" else F.col(f"level_{side}") == level
            cells = _mapped(cells, pairs, f"region_{side}" if level == "Region" else f"item_{side}", where)
    if drop:
        cells = cells.filter(~((F.col("level_from") == "Satellite account") & F.col("item_from").isin(*drop)))
    return cells


def _with_empty_columns(before: Model, after: Model, scenario: str, maps: dict[str, DataFrame], drop: list[str]) -> Model:
    """`after` with the coefficients, in a scenario, of groups of columns without output: the mean over the columns that have any. Only stored coefficients
    can be there without an output, so that other scenarios stay as they are."""
    shares = COLUMN_SHARES[before.kind]
    if not set(before.names[scenario]) & {*schema.COEFFICIENTS[before.kind]} - {*schema.FLOWS[before.kind]}:
        return after
    planner, found, coefficients = before.planner(scenario), [], {}
    for matrix, output in shares.items():
        try:
            block, made = planner.resolve(matrix), planner.resolve(output)
        except NotComputable:
            continue
        some = block.filter("value <> 0").join(made.filter("value <> 0").select(F.col("i").alias("j")), "j", "left_anti")
        side = lambda s, k: before.axis.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("region", "level", "item")])
        labelled = some.join(side("from", "i"), "i").join(side("to", "j"), "j").withColumn("matrix", F.lit(matrix))
        found.append(labelled.withColumn("member", F.col("j")).drop("i", "j"))
    if not found:
        return after
    cells = _mapped_cells(reduce(DataFrame.unionByName, found), maps, drop)
    cells = stored(cells.select("matrix", "member", label_id("region_from", "level_from", "item_from").alias("i"), label_id("region_to", "level_to", "item_to").alias("j"), "value"))
    if cells.isEmpty():
        return after
    members = cells.groupBy("j").agg(F.countDistinct("member").alias("n"))
    means = cells.groupBy("matrix", "i", "j").agg(F.sum("value").alias("value")).join(members, "j").withColumn("value", F.col("value") / F.col("n"))
    new = after.planner(scenario)
    for matrix, output in shares.items():
        try:
            block, made = new.resolve(matrix), new.resolve(output)
        except NotComputable:
            continue
        own = means.filter(F.col("matrix") == matrix).join(made.filter("value <> 0").select(F.col("i").alias("j")), "j", "left_anti")
        coefficients[matrix] = B.add(block, own)
    return after.with_blocks(scenario, coefficients, keep=after.names[scenario])


def to_iot(model: Model, method: str = "B", scenario: str | None = None) -> Model:
    """An input-output table of a supply-use table. A and B give products by products, C and D industries by industries; A and C assume that a product
    (industry) is made in one way and need as many activities as commodities, B and D work by market shares and are joins alone. Other scenarios go."""
    if model.kind != "SUT":
        raise NotComputable("it is an input-output table already")
    if method not in "ABCD" or len(method) != 1:
        raise WrongInput(f"no method is called {method!r}")
    planner = model.planner(scenario)
    u, s, yc, v, e = (planner.resolve(x) for x in ("U", "S", "Yc", "Va", "Ea"))
    xa, xc = planner.resolve("Xa"), planner.resolve("Xc")
    if method in "AC":
        if model.size("Activity") != model.size("Commodity"):
            raise NotComputable(f"method {method} needs as many activities as commodities")
        back = K.rectangular_inverse(B.transpose(s), model.ids("Commodity"), model.ids("Activity"))
    if method in "AB":
        t = B.scale_columns(back, xc) if method == "A" else B.scale_rows(B.inverse_vector(xa), s)
        level, z, y, v, e = "Commodity", B.matmul(u, t), yc, B.matmul(v, t), B.matmul(e, t)
    else:
        t = B.scale_rows(xa, back) if method == "C" else B.scale_columns(s, B.inverse_vector(xc))
        level, z, y = "Activity", B.matmul(t, u), B.matmul(t, yc)
    blocks = {"Z": z, "Y": y, "V": v, "E": e}
    for m in ("EY", "VY"):
        if model.has(m, scenario):
            blocks[m] = model.stored_block(m, scenario)
    renamed = model.axis.filter(F.col("level") == level).select(F.col("id").alias("old"), "region", F.lit("Sector").alias("level"), "item")
    ids = renamed.select("old", label_id("region", "level", "item").alias("new"))

    def moved(b: DataFrame) -> DataFrame:
        for side in "ij":
            b = b.join(ids, b[side] == ids["old"], "left").withColumn(side, F.coalesce("new", side)).drop("old", "new")
        return b.select("i", "j", "value")

    other = model.axis.filter(~F.col("level").isin("Activity", "Commodity"))
    axis = other.unionByName(renamed.select(label_id("region", "level", "item").alias("id"), "region", "level", "item"))
    cells = None
    for name, b in blocks.items():
        rows = moved(b).select(F.lit(BASELINE).alias("scenario"), F.lit(name).alias("matrix"), "i", "j", "value")
        cells = rows if cells is None else cells.unionByName(rows)
    units = model.units.filter(~F.col("level").isin("Activity", "Commodity")).unionByName(model.units.filter(F.col("level") == level).withColumn("level", F.lit("Sector")))
    return Model("IOT", cells, axis, units, {BASELINE: tuple(sorted(blocks))}, meta=model.meta)


def to_chenery_moses(model: Model, scenario: str | None = None) -> Model:
    """Trade moved from the use side to the supply side: uses are summed over origins into the destination's own commodity; each region supplies what
    its goods are used for elsewhere by its own market shares."""
    scenario = scenario or model.baseline
    if is_chenery_moses(model, scenario):
        raise NotComputable("trade is on the supply side already")
    planner = model.planner(scenario)
    u, yc, s = planner.resolve("U"), planner.resolve("Yc"), planner.resolve("s")
    place = lambda k, *more: model.axis.select(F.col("id").alias(k), F.col("region").alias(f"r_{k}"), F.col("item").alias(f"n_{k}"))
    own = label_id(F.col("r_j"), F.lit("Commodity"), F.col("n_i"))  # the same commodity, of the user's region
    local = lambda b: b.join(place("i"), "i").join(place("j"), "j").select(own.alias("i"), "j", "value").groupBy("i", "j").agg(F.sum("value").alias("value"))
    used = B.concat(u, yc).join(place("i"), "i").join(place("j"), "j").groupBy("i", "r_i", own.alias("j")).agg(F.sum("value").alias("x"))
    shares = s.join(place("i").drop("n_i"), "i").join(place("j").select(F.col("j"), "r_j"), "j").filter("r_i = r_j").select(F.col("i").alias("maker"), F.col("j").alias("i"), F.col("value").alias("share"))
    supply = used.join(shares, "i").groupBy(F.col("maker").alias("i"), "j").agg(F.sum(F.col("share") * F.col("x")).alias("value"))
    base = model.reset(scenario, "flows")
    return base.with_blocks(scenario, {"U": local(u), "Yc": local(yc), "S": supply}, base.names[scenario])


def pool_trade(model: Model, commodities: Iterable[str], supply: str = " - supply", need: str = " - need") -> Model:
    """For each commodity a pass-through activity and a domestic need in every region: buyers buy the need, keeping their totals; the supply block of
    the need holds who sends how much; the pass-through uses up the region's own output. Other scenarios go."""
    if model.kind != "SUT":
        raise NotComputable("only for supply-use tables")
    wanted = [commodities] if isinstance(commodities, str) else list(dict.fromkeys(commodities))
    known = {r["item"] for r in model.index("Commodity").filter(F.col("item").isin(*wanted, *[c + need for c in wanted])).collect()}
    made = {r["item"] for r in model.index("Activity").filter(F.col("item").isin(*[c + supply for c in wanted])).collect()}
    if not wanted or set(wanted) - known:
        raise WrongInput("unknown commodities")
    if made or known - set(wanted):
        raise WrongInput("the new labels stand already")
    base = flows_only(model.drop_scenarios())
    cells = base.labelled_cells()
    bought = F.col("matrix").isin("U", "Yc") & F.col("item_from").isin(*wanted)
    trade = cells.filter(bought)
    cells = cells.filter(~bought)
    onto = trade.withColumn("region_from", F.col("region_to")).withColumn("item_from", F.concat("item_from", F.lit(need)))
    passes = F.concat("item_from", F.lit(supply))
    columns = lambda m, **c: trade.select("scenario", F.lit(m).alias("matrix"), *[c.get(x, F.col(x)).alias(x) for x in LABELS], "value")
    routed = columns("S", level_from=F.lit("Activity"), item_from=passes, level_to=F.lit("Commodity"), item_to=F.concat("item_from", F.lit(need)))
    consumed = columns("U", region_to=F.col("region_from"), level_to=F.lit("Activity"), item_to=passes)
    regions = model.index("Region").select(F.col("item").alias("region"))
    new = model.spark.createDataFrame([("Activity", c + supply, c) for c in wanted] + [("Commodity", c + need, c) for c in wanted], "level string, item string, of string")
    labels = base.axis.select("region", "level", "item").unionByName(regions.crossJoin(F.broadcast(new)).select("region", "level", "item"))  # two labels a region and commodity
    unit = model.units.filter(F.col("level") == "Commodity").select(F.col("item").alias("of"), "unit")
    units = model.units.unionByName(new.join(unit, "of").select("level", "item", "unit"))
    names = {model.baseline: tuple(sorted({*base.names[model.baseline], "S", "U"}))}
    out = Model.from_labelled(cells.unionByName(onto).unionByName(routed).unionByName(consumed), "SUT", units, model.tech, check=False, names=names, labels=labels, baseline=model.baseline)
    return replace(out, meta={**model.meta, "pooled_trade": {c: (c + supply, c + need) for c in wanted}})


def region_subset(model: Model, regions: Iterable[str], trade_mode: str = "aggregate", sectorized: bool = False) -> Model:
    """The system of some regions: what they buy elsewhere becomes factor rows, what they sell there final demand, in one lump or by region.

    sectorized (input-output tables): imports are told by sector, exports are one category a region."""
    trade_mode, sectorized = {"by_sector": ("aggregate", True), "by_region_and_sector": ("by_region", True)}.get(trade_mode, (trade_mode, sectorized))
    chosen = [regions] if isinstance(regions, str) else list(regions)
    known = {r["item"] for r in model.index("Region").collect()}  # regions are few hundred
    if trade_mode not in ("aggregate", "by_region") or not chosen or len(set(chosen)) < len(chosen) or set(chosen) - known or set(chosen) == known:
        raise WrongInput("regions must be some, not all, of the table's, each once; trade goes in aggregate or by region")
    if model.is_hybrid or (model.kind == "SUT" and (trade_mode != "aggregate" or sectorized)):
        raise NotComputable("not for tables in several units; supply-use tables take aggregate trade in rows only")
    base = flows_only(model)
    inside = lambda c: F.col(c).isin(*chosen)
    use, final = ("Z", "Y") if model.kind == "IOT" else ("U", "Yc")
    by = F.lit("") if trade_mode == "aggregate" else F.concat(F.lit(" "), F.col("region_from"))
    to = F.lit("") if trade_mode == "aggregate" else F.concat(F.lit(" "), F.col("region_to"))
    cells = base.labelled_cells()
    null = F.lit(None).cast("string")
    within = cells.filter(F.when(F.col("region_from").isNotNull(), inside("region_from")).otherwise(True) & F.when(F.col("region_to").isNotNull(), inside("region_to")).otherwise(True))
    take = lambda rows, m, **c: rows.select("scenario", F.lit(m).alias("matrix"), *[c.get(x, F.col(x)).alias(x) for x in LABELS], "value")
    label = F.concat(F.lit("imports"), by) if not sectorized else F.concat(F.lit("imports"), by, F.lit(" "), F.col("item_from"))
    bought = cells.filter((F.col("matrix") == use) & ~inside("region_from") & inside("region_to"))
    imports = take(bought, "V" if model.kind == "IOT" else "Va", region_from=null, level_from=F.lit("Factor of production"), item_from=label)
    bought = cells.filter((F.col("matrix") == final) & ~inside("region_from") & inside("region_to"))
    demanded = take(bought, "VY", region_from=null, level_from=F.lit("Factor of production"), item_from=label)
    sold = cells.filter(F.col("matrix").isin(use, final) & inside("region_from") & ~inside("region_to"))
    kind = F.when(F.col("matrix") == use, "Intermediate exports").otherwise("Final Demand exports")
    category = F.lit("Export") if sectorized else F.concat(kind, to)
    exports = take(sold, final, region_to=F.col("region_from"), level_to=F.lit("Consumption category"), item_to=category)
    units = model.units
    names = {s: tuple(sorted({*n, "V" if model.kind == "IOT" else "Va", "VY"})) for s, n in base.names.items()}
    out = within.unionByName(imports).unionByName(demanded).unionByName(exports)
    labels = base.axis.filter(F.col("region").isNull() | F.col("region").isin(*chosen))
    return Model.from_labelled(out, model.kind, units, model.tech, check=False, names=names, labels=labels, meta=model.meta, baseline=model.baseline)


def add_extensions(model: Model, cells: DataFrame, matrix: str, units: DataFrame) -> Model:
    """New rows of E or V (Ea, Ec, Va, Vc) from labelled cells (item_from, region_to, level_to, item_to, value). Rows that stand already and columns that
    the table hasn't are refused; final demand of the new rows is zero. Other scenarios go."""
    level = {"E": "Satellite account", "V": "Factor of production"}.get(matrix[0])
    if level is None or matrix not in schema.FLOWS[model.kind]:
        raise WrongInput("extensions are rows of E or V")
    base = flows_only(model.drop_scenarios())
    new = cells.select(F.lit(model.baseline).alias("scenario"), F.lit(matrix).alias("matrix"), F.lit(None).cast("string").alias("region_from"), F.lit(level).alias("level_from"), "item_from", "region_to", "level_to", "item_to", "value")
    if not new.select(F.col("item_from").alias("item")).distinct().join(model.index(level), "item", "left_semi").isEmpty():
        raise WrongInput("an extension stands already")
    if not new.select(label_id("region_to", "level_to", "item_to").alias("id")).distinct().join(model.axis, "id", "left_anti").isEmpty():
        raise WrongInput("an extension has columns that the table hasn't")
    names = {model.baseline: tuple(sorted({*base.names[model.baseline], matrix}))}
    all_units = model.units.unionByName(units.select(F.lit(level).alias("level"), "item", "unit"))
    return Model.from_labelled(base.labelled_cells().unionByName(new), model.kind, all_units, model.tech, check=False, names=names, labels=base.axis, meta=model.meta, baseline=model.baseline)
