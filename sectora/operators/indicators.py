"""Indicators over a model: GDP, balance tests, linkages, mixes, greenhouse gases and contributions by origin. All return lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Model
from ..plans import blocks as B
from ..plans.kernels import stored
from ..schema import NotComputable, WrongInput


def ratio(over: Column, under: Column) -> Column:
    """over / under, and null where under is 0."""
    return F.when(under != 0, over / under)


def outer_level(model: Model) -> str:
    """The level whose columns count for GDP and the like: sectors, or activities."""
    return "Sector" if model.kind == "IOT" else "Activity"


def gdp(model: Model, scenario: str | None = None, exclude: Iterable[str] = (), total: bool = True, share: bool = False) -> DataFrame:
    """region, (item,) gdp (, share in %): the factors' sum, without `exclude`, by region or by region and sector. Supply-use tables count activities."""
    v = model.resolve("V" if model.kind == "IOT" else "Va", scenario)
    names = model.axis.select(F.col("id").alias("i"), F.col("item").alias("factor"))
    columns = model.axis.filter(F.col("level") == outer_level(model)).select(F.col("id").alias("j"), "region", "item")
    rows = v.join(names, "i").filter(~F.col("factor").isin(*exclude) if (exclude := list(exclude)) else F.lit(True)).join(columns, "j")
    keys = ["region"] if total else ["region", "item"]
    out = rows.groupBy(*keys).agg(F.sum("value").alias("gdp"))
    if share:
        out = out.withColumn("share", 100 * ratio(F.col("gdp"), F.sum("gdp").over(Window.partitionBy("region"))))
    return out


def balance(model: Model, method: str = "flows", margin: float = 0.05, scenario: str | None = None) -> DataFrame:
    """region, level, item, imbalance of columns out of balance. flows: inputs and factors less output, over the margin; coefficients: their sum away from
    1 by more than the margin (empty columns are left alone); prices: price indices away from 1."""
    if model.is_hybrid:
        raise NotComputable("a table in several units has no balance")
    planner = model.planner(scenario)
    if method == "flows":
        inputs = B.sum_columns(B.concat(planner.resolve("Z"), planner.resolve("V")))
        gap = B.subtract(inputs, planner.resolve("X")).withColumnRenamed("value", "imbalance").filter(F.abs("imbalance") >= margin)
    elif method == "coefficients":
        gap = B.sum_columns(B.concat(planner.resolve("z"), planner.resolve("v"))).filter((F.abs(F.col("value") - 1) > margin) & (F.col("value") != 0)).withColumn("imbalance", F.col("value") - 1)
    elif method == "prices":
        gap = planner.resolve("p").filter((F.abs(F.col("value") - 1) > margin) & (F.col("value") != 0)).withColumn("imbalance", F.col("value") - 1)
    else:
        raise WrongInput(f"no balance method is called {method!r}")
    return gap.join(model.axis.select(F.col("id").alias("i"), "region", "level", "item"), "i").select("region", "level", "item", "imbalance")


def is_balanced(model: Model, method: str = "flows", margin: float = 0.05, scenario: str | None = None) -> bool:
    return balance(model, method, margin, scenario).isEmpty()


def _crosses(model: Model, matrix: str, scenario: str | None) -> bool:
    """Whether a block has a cell other than 0 between different regions."""
    if model.kind != "SUT" or not model.is_multi_region:
        raise NotComputable("only for supply-use tables of several regions")
    return not by_regions(model, model.resolve(matrix, scenario)).filter("region_from <> region_to and value <> 0").isEmpty()


def is_isard(model: Model, scenario: str | None = None) -> bool:
    """Whether the use side holds the trade between regions."""
    return _crosses(model, "U", scenario)


def is_chenery_moses(model: Model, scenario: str | None = None) -> bool:
    """Whether the supply side holds the trade between regions."""
    return _crosses(model, "S", scenario)


def by_regions(model: Model, block: DataFrame) -> DataFrame:
    """region_from, region_to, value: a block summed by region."""
    side = lambda k, n: model.axis.select(F.col("id").alias(k), F.col("region").alias(n))
    return block.join(side("i", "region_from"), "i").join(side("j", "region_to"), "j").groupBy("region_from", "region_to").agg(F.sum("value").alias("value"))


def linkages(model: Model, scenario: str | None = None, normalized: bool = True, cut_diag: bool = True, multi: bool = False) -> DataFrame:
    """region, item and the linkages of each sector: total_forward (rows of g), total_backward (columns of w), direct_forward (b), direct_backward (z).

    cut_diag leaves out the diagonals. Single mode adds amplification (total over direct) and, if normalized, divides the four by their means; multi mode
    gives the part inside the region (local), the rest (foreign) and the local share instead."""
    planner, cut = model.planner(scenario), (F.col("i") != F.col("j") if cut_diag else F.lit(True))
    places = model.axis.filter(F.col("level").isin(*model.levels)).select("id", "region", "item")
    parts = {"total_forward": ("g", "i"), "total_backward": ("w", "j"), "direct_forward": ("b", "i"), "direct_backward": ("z", "j")}
    out = places
    for name, (matrix, side) in parts.items():
        block = planner.resolve(matrix).filter(cut)
        if multi:
            at = lambda k, n: places.select(F.col("id").alias(k), F.col("region").alias(n))
            block = block.join(at("i", "ri"), "i").join(at("j", "rj"), "j").withColumn("same", F.col("ri") == F.col("rj"))
            sums = block.groupBy(F.col(side).alias("id")).agg(F.sum(F.when(F.col("same"), F.col("value")).otherwise(0.0)).alias(f"{name}_local"), F.sum(F.when(F.col("same"), 0.0).otherwise(F.col("value"))).alias(f"{name}_foreign"))
        else:
            sums = block.groupBy(F.col(side).alias("id")).agg(F.sum("value").alias(name))
        out = out.join(sums, "id", "left")
    if multi:
        for name in parts:
            local, foreign = (F.coalesce(F.col(f"{name}_{x}"), F.lit(0.0)) for x in ("local", "foreign"))
            out = out.withColumn(f"{name}_local", local).withColumn(f"{name}_foreign", foreign).withColumn(f"{name}_local_share", ratio(F.col(f"{name}_local"), F.col(f"{name}_local") + F.col(f"{name}_foreign")))
        return out.drop("id")
    out = out.select("region", "item", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in parts])
    for way in ("forward", "backward"):
        out = out.withColumn(f"amplification_{way}", ratio(F.col(f"total_{way}"), F.col(f"direct_{way}")))
    if normalized:
        means = out.agg(*[F.avg(n).alias(n) for n in parts]).first()  # four numbers
        for n in parts:
            out = out.withColumn(n, F.col(n) / F.lit(means[n])) if means[n] else out
    return out


def mix(model: Model, sectors: Iterable[str], scenario: str | None = None) -> DataFrame:
    """region, item, share of each of the sectors in the region's output of them; 0 where that isn't positive."""
    x = model.resolve("X" if model.kind == "IOT" else "Xa", scenario)
    rows = x.join(model.axis.select(F.col("id").alias("i"), "region", "item", "level"), "i").filter(F.col("item").isin(*list(sectors)) & (F.col("level") == outer_level(model)))
    total = F.sum("value").over(Window.partitionBy("region"))
    return rows.select("region", "item", F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("share"))


#: 100-year global warming potentials by assessment report.
GWP100 = {"AR4": {"CO2": 1.0, "CH4": 25.0, "N2O": 298.0}, "AR5": {"CO2": 1.0, "CH4": 30.0, "N2O": 265.0}, "AR6": {"CO2": 1.0, "CH4": 29.8, "N2O": 273.0}}


def weighted_account(model: Model, weights: Mapping[str, float], label: str, unit: str | None = None, prefix: bool = False, scenario: str | None = None) -> Model:
    """The model with a satellite account that is the weighted sum of others, in production and final demand. Accounts that are missing count for nothing;
    it is an error if all are, or if those found differ in unit. prefix: weights hold for accounts whose names begin so."""
    scenario = scenario or model.baseline
    spark = model.spark
    table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "account string, weight double")
    rows = model.axis.filter(F.col("level") == "Satellite account").select(F.col("id").alias("i"), "item")
    on = F.col("item").startswith(F.col("account")) if prefix else F.col("item") == F.col("account")
    found = rows.join(F.broadcast(table), on).select("i", "item", "weight")  # as many weights as the caller lists
    units = [r["unit"] for r in model.units.filter(F.col("level") == "Satellite account").join(found.select("item").distinct(), "item", "left_semi").select("unit").distinct().limit(2).collect()]
    if found.isEmpty():
        raise WrongInput("none of the accounts is in the table")
    if len(units) > 1 and unit is None:
        raise WrongInput("the accounts differ in unit")
    from ..model import label_id

    new = spark.createDataFrame([(None, "Satellite account", label)], "region string, level string, item string").select(label_id("region", "level", "item").alias("id"), "region", "level", "item")
    ident = new.select(F.col("id").alias("new"))
    blocks = {}
    for m in [x for x in ("E", "Ea", "Ec", "e", "ea", "ec", "EY") if model.has(x, scenario)]:
        old = model.stored_block(m, scenario)
        some = old.join(found, "i").groupBy("j").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
        blocks[m] = B.concat(old, some.join(F.broadcast(ident)).select(F.col("new").alias("i"), "j", "value"))  # one row
    out = model.with_blocks(scenario, blocks, [x for x in model.names[scenario] if x[0] not in "fF"], model.axis.unionByName(new))
    added = spark.createDataFrame([("Satellite account", label, unit or (units[0] if units else ""))], "level string, item string, unit string")
    from dataclasses import replace

    return replace(out, units=model.units.unionByName(added))


def ghg(model: Model, accounts: Mapping[str, str], report: str = "AR6", label: str | None = None, unit: str | None = None, prefix: bool = False, scenario: str | None = None) -> Model:
    """Greenhouse gases as CO2 equivalents: accounts maps satellite accounts to their gas (CO2, CH4, N2O)."""
    if report not in GWP100:
        raise WrongInput(f"no report is called {report!r}")
    weights = {account: GWP100[report][gas] for account, gas in accounts.items()}
    return weighted_account(model, weights, label or f"GHG {report} GWP-100", unit, prefix, scenario)


@dataclass(frozen=True)
class GasProfile:
    """How a published table names its greenhouse gas accounts. match: words that all stand in its source or name; accounts: account -> gas, or a weight
    where the account is in CO2 equivalents already. unit: of the sum, where none is asked for."""

    match: tuple[str, ...]
    accounts: Mapping[str, str | float]
    prefix: bool = False
    unit: str | None = None


#: The sources of emissions that the Eora tables list for every gas; totals and other gases stand beside them.
EORA_SOURCES = """
Public electricity and heat production
Other Energy Industries
Manufacturing Industries and Construction
Domestic aviation
Road transportation
Rail transportation
Inland navigation
Other transportation
Residential and other sectors
Fugitive emissions from solid fuels
Fugitive emissions from oil and gas
Memo: International aviation
Memo: International navigation
Production of minerals
Cement production
Lime production
Production of chemicals
Production of metals
Production of pulp/paper/food/drink
Production of halocarbons and SF6
Refrigeration and Air Conditioning
Foam Blowing
Fire Extinguishers
Aerosols
F-gas as Solvent
Semiconductor/Electronics Manufacture
Electrical Equipment
Other F-gas use
Non-energy use of lubricants/waxes (CO2)
Solvent and other product use: paint
Solvent and other product use: degrease
Solvent and other product use: chemicals
Solvent and other product use: other
Enteric fermentation
Manure management
Rice cultivation
Direct soil emissions
Manure in pasture/range/paddock
Indirect N2O from agriculture
Other direct soil emissions
Savanna burning
Agricultural waste burning
Forest fires
Grassland fires
Decay of wetlands/peatlands
Other vegetation fires
Forest Fires-Post burn decay
Solid waste disposal on land
Wastewater handling
Waste incineration
Other waste handling
Fossil fuel fires
Indirect N2O from non-agricultural NOx
Indirect N2O from non-agricultural NH3
Other sources
""".strip().splitlines()

#: Account names and units of published tables.
GAS_PROFILES = {
    "exiobase_monetary": GasProfile(("exiobase", "monetary"), {"CO2 - combustion - air": "CO2", "CH4 - combustion - air": "CH4", "N2O - combustion - air": "N2O"}, unit="kg CO2eq"),
    "exiobase_hybrid": GasProfile(("exiobase", "hybrid"), {"Carbon dioxide, fossil (air - Emiss)": "CO2", "CH4 (air - Emiss)": "CH4", "N2O (air - Emiss)": "N2O"}, unit="kg CO2eq"),
    "eora": GasProfile(("eora",), {f"I-GHG-{gas} emissions (Gg) - {source}": gas for gas in GWP100["AR6"] for source in EORA_SOURCES}, prefix=True, unit="Gg CO2eq"),
    "adb": GasProfile(("adb",), {"GHG | Total by substance": 1.0}, unit="Gigagrams of Carbon Dioxide equivalent (Gg of CO2e)"),
    "gloria": GasProfile(("gloria",), {"Emissions (EDGAR) | 'co2_excl_short_cycle_org_c_total_EDGAR_consistent'": "CO2", "Emissions (EDGAR) | 'ch4_total_EDGAR_consistent'": "CH4", "Emissions (EDGAR) | 'n2o_total_EDGAR_consistent'": "N2O"}, unit="kg CO2eq"),
    "emerging": GasProfile(("emerging",), {"Coal": 1.0, "Natural gas": 1.0, "Oil products": 1.0, "Crude, NGL, Ref Feeds.": 1.0, "Oil shale & oil sands": 1.0, "Peat & Peat products": 1.0, "Other": 1.0}, unit="Mt CO2eq"),
}


def register_gas_profile(name: str, profile: GasProfile) -> None:
    """A profile of one's own, or another in place of one that stands."""
    GAS_PROFILES[name] = profile


def gas_profile_of(model: Model) -> str | None:
    """The profile whose words all stand in the table's source or name: of several the one with most words."""
    told = " ".join(str(model.meta.get(k) or "") for k in ("source", "name")).lower()
    fit = [n for n, p in GAS_PROFILES.items() if p.match and all(w.lower() in told for w in p.match)]
    return max(fit, key=lambda n: len(GAS_PROFILES[n].match), default=None)


def ghg_of_profile(model: Model, profile: str | None = None, report: str = "AR6", label: str | None = None, unit: str | None = None, scenario: str | None = None) -> Model:
    """Greenhouse gases as CO2 equivalents, the accounts taken from a profile: the one named, or the one that fits the table's source."""
    name = profile or gas_profile_of(model)
    if name not in GAS_PROFILES:
        raise WrongInput(f"no profile of gases fits: {name!r}; there are {sorted(GAS_PROFILES)}")
    if report not in GWP100:
        raise WrongInput(f"no report is called {report!r}")
    own = GAS_PROFILES[name]
    weights = {account: GWP100[report][gas] if isinstance(gas, str) else float(gas) for account, gas in own.accounts.items()}
    return weighted_account(model, weights, label or f"GHG {report} GWP-100", unit or own.unit, own.prefix, scenario)


def exploded(model: Model, item: str, matrix: str = "f", scenario: str | None = None) -> DataFrame:
    """What each contributor (rows) causes per unit demanded of each good (columns) of one account or factor: diag(e) w and the like.

    matrix: f or m of input-output tables; fa, fc, ma, mc of supply-use tables."""
    planner = model.planner(scenario)
    level = "Satellite account" if matrix[0] == "f" else "Factor of production"
    ids = model.axis.filter((F.col("level") == level) & (F.col("item") == item)).select("id")
    base = {"f": "e", "m": "v"}[matrix[0]]
    row = lambda name: B.sum_columns(B.keep(planner.resolve(name), ids))
    if model.kind == "IOT":
        return B.scale_rows(row(base), planner.resolve("w"))
    if matrix[1:] == "a":
        return B.concat(B.scale_rows(row(f"{base}a"), planner.resolve("waa")), B.scale_rows(row(f"{base}c"), planner.resolve("wca")))
    return B.concat(B.scale_rows(row(f"{base}a"), B.matmul(planner.resolve("s"), planner.resolve("wcc"))), B.scale_rows(row(f"{base}c"), planner.resolve("wcc")))


def exploded_prices(model: Model, scenario: str | None = None) -> DataFrame:
    """What each sector's factors add to the price of each good: diag(v.sum) w."""
    planner = model.planner(scenario)
    if model.kind == "IOT":
        return B.scale_rows(B.sum_columns(planner.resolve("v")), planner.resolve("w"))
    va, vc = (B.sum_columns(planner.resolve(x)) for x in ("va", "vc"))
    return B.concat(B.scale_rows(va, planner.resolve("waa")), B.scale_rows(vc, planner.resolve("wca")), B.scale_rows(va, planner.resolve("wac")), B.scale_rows(vc, planner.resolve("wcc")))


def direct_footprint(e: DataFrame, w: DataFrame) -> DataFrame:
    """diag(e) w for one row of coefficients."""
    return B.scale_rows(B.sum_columns(e), w)


def demand_shares(y: DataFrame) -> DataFrame:
    """Final demand over its grand total."""
    whole = y.agg(F.sum("value").alias("whole"))
    return y.join(F.broadcast(whole)).select("i", "j", ratio(F.col("value"), F.col("whole")).alias("value"))  # one row


def paths(model: Model, item: str, matrix: str = "f", max_depth: int = 5, cutoff: float = 0.0, top: int = 200, scenario: str | None = None, goods: Iterable[str] | None = None, regions: Iterable[str] | None = None, categories: Iterable[str] | None = None) -> DataFrame:
    """Structural paths: path (from the supplier up to the demand), depth, contribution, share, cumulative. Each demanded good is followed up its inputs;
    a node whose contribution is below the cutoff goes with all above it. Input-output tables only.

    Branch and bound: a node is followed further only if its weight times the most that any path above it can contribute reaches the `top` best found so
    far, so that a level holds about as many rows as there are paths worth telling times the inputs of a good. Paths are ids until the end.


    goods, regions, categories: only demand for these sectors, of these regions, of these categories; shares are of what that demand causes."""
    if model.kind != "IOT":
        raise NotComputable("paths are followed in input-output tables")
    planner = model.planner(scenario)
    level = "Satellite account" if matrix == "f" else "Factor of production"
    ids = model.axis.filter((F.col("level") == level) & (F.col("item") == item)).select("id")
    direct = B.sum_columns(B.keep(planner.resolve("e" if matrix == "f" else "v"), ids)).select(F.col("i").alias("node"), F.col("value").alias("direct"))
    y = planner.resolve("Y")
    for side, column, wanted in (("i", "item", goods), ("j", "region", regions), ("j", "item", categories)):
        if wanted is not None:
            some = model.axis.filter(F.col(column).isin(*list(wanted))).select(F.col("id").alias(side))
            y = y.join(some, side, "left_semi").select("i", "j", "value")
    if not (goods is None and regions is None and categories is None) and y.isEmpty():
        raise WrongInput("no demand is left by the filters")
    z = planner.resolve("z").filter("value <> 0").select(F.col("i").alias("up"), F.col("j").alias("node"), F.col("value").alias("input"))
    front = y.filter("value <> 0").select(F.col("i").alias("node"), F.col("value").alias("weight"), F.array("j", "i").alias("ids"))
    best = _best_above(direct, z, max_depth)
    kept, least = None, cutoff
    for depth in range(max_depth + 1):
        front = front.join(direct, "node", "left").withColumn("contribution", F.col("weight") * F.coalesce("direct", F.lit(0.0))).drop("direct")
        front = stored(front.filter(F.abs("contribution") >= cutoff))
        new = front.filter("contribution <> 0").select("ids", F.lit(depth).alias("depth"), "contribution")
        kept = stored((new if kept is None else kept.unionByName(new)).filter(F.abs("contribution") >= least))
        size, lowest = kept.select(F.abs("contribution").alias("c")).orderBy(F.desc("c")).limit(top).agg(F.count("*"), F.min("c")).first()
        least = max(least, lowest) if size == top else least  # ties stay
        if depth < max_depth:
            above = best[max_depth - depth - 1].select(F.col("node").alias("up"), "most")
            front = front.join(z, "node").join(above, "up").withColumn("weight", F.col("weight") * F.col("input"))
            front = front.filter(F.abs("weight") * F.col("most") >= least * (1 - 1e-9)).select(F.col("up").alias("node"), "weight", F.concat("ids", F.array("up")).alias("ids"))
    whole = B.scale_columns(B.keep(planner.resolve(matrix), ids), B.sum_rows(y)).agg(F.sum("value")).first()[0]
    best_rows = _named(kept.filter(F.abs("contribution") >= least), model).orderBy(F.desc(F.abs(F.col("contribution"))), "depth", "path").limit(top)
    by = Window.orderBy(F.desc(F.abs(F.col("contribution"))), "depth", "path")  # over the top rows alone
    share = F.col("contribution") / F.lit(whole) if whole else F.lit(None).cast("double")
    return best_rows.withColumn("share", share).withColumn("cumulative", F.sum("share").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def _best_above(direct: DataFrame, z: DataFrame, depth: int) -> list[DataFrame]:
    """By number of further steps, for each node the most that a path which goes on from it by so many steps or fewer can contribute for a weight of one."""
    own = direct.select("node", F.abs("direct").alias("most"))
    out = [own]
    for _ in range(depth):
        further = z.join(out[-1].withColumnRenamed("node", "up"), "up").select("node", (F.abs("input") * F.col("most")).alias("most"))
        out.append(stored(own.unionByName(further).groupBy("node").agg(F.max("most").alias("most"))))
    return out


def _named(found: DataFrame, model: Model) -> DataFrame:
    """path, depth, contribution: ids (from the demand up) spelt out; few rows."""
    axis = model.axis.select("id", F.concat_ws("|", "region", "item").alias("name"))
    each = found.select("ids", "depth", "contribution", F.posexplode("ids").alias("at", "id"))
    each = each.join(axis, "id").withColumn("name", F.when(F.col("at") == 0, F.concat(F.lit("FD: "), "name")).otherwise(F.col("name")))
    parts = each.groupBy("ids", "depth", "contribution").agg(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), "name"))).alias("parts"))
    return parts.select(F.array_join("parts.name", " -> ").alias("path"), "depth", "contribution")
