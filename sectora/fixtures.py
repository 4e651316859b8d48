"""Input-output and supply-use tables built from star-schema sales tables: suppliers' regions sell parts to customers' regions and segments.

Sectors are the customers' segments; a part belongs to the segment of its key. Urgent and high orders are intermediate use, others final demand by
priority. Sums are exact (decimal) and only then turned to doubles, so that every engine gets the same cells.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .deploy import ship
from .model import Model

#: The segments in order; the sales tables have these five.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MIDDLE = ("1-URGENT", "2-HIGH")
_CUBES: dict[tuple[str, str], DataFrame] = {}


def _cents(name: str, digits: int) -> Column:
    """Hundredths of a number as decimal(digits, 2) has it, as a long. A double that is the nearest to a number of hundredths needs no decimal to tell which."""
    x, whole = F.col(name), F.rint(F.col(name) * 100)
    return F.when((F.abs(x) < 10 ** (digits - 2)) & (whole / 100 == x), whole.cast("long")).otherwise((x.cast(f"decimal({digits},2)") * 100).cast("long"))


def _exact(amount: Column) -> Column:
    """The sum of longs as a decimal, summed as two halves of 32 bits, which no table fills."""
    high, low = F.sum(F.shiftright(amount, 32)), F.sum(amount.bitwiseAND(F.lit(0xFFFFFFFF)))
    return high.cast("decimal(19,0)") * F.lit(Decimal(1 << 32)) + low.cast("decimal(19,0)")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by origin, part group, destination, segment, priority, first line or not, returned or not: a few thousand rows whatever the input, kept.

    Lines and orders are cut down to what the cube needs before they move: money as whole hundredths, regions as keys that get their names once all is summed.
    Lines meet suppliers and nations table by table, so that Spark sees how small those are and moves the lines once, to their orders."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CUBES:
        ship(spark)
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        nation = lambda n, r: read("nation").select(F.col("n_nationkey").alias(n), F.col("n_regionkey").alias(r))
        region = lambda r, name: read("region").select(F.col("r_regionkey").alias(r), F.col("r_name").alias(name))
        sold = read("lineitem").select(
            "l_orderkey", "l_suppkey", (F.col("l_partkey") % 5).cast("int").alias("pk"), (F.col("l_linenumber") == 1).alias("first"), (F.col("l_returnflag") == "R").alias("back"),
            _cents("l_extendedprice", 12).alias("price"), _cents("l_discount", 4).alias("discount"), _cents("l_tax", 4).alias("rate"), _cents("l_quantity", 12).alias("quantity"),
        )
        sellers = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("from_nation"))
        buyers = read("customer").select("c_custkey", F.col("c_nationkey").alias("to_nation"), F.col("c_mktsegment").alias("sd"))
        sold = sold.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(nation("from_nation", "from_region"), "from_nation").drop("l_suppkey", "s_suppkey", "from_nation")
        orders = read("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("prio")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        orders = orders.join(nation("to_nation", "to_region"), "to_nation").select("o_orderkey", "to_region", "sd", "prio")
        net = F.col("price") * (100 - F.col("discount"))
        # a tax may be too long for a long: that of the upper and that of the lower bits of net
        upper, lower = _exact(F.shiftright(net, 24) * F.col("rate")), _exact(net.bitwiseAND(F.lit(0xFFFFFF)) * F.col("rate"))
        scaled = lambda c, unit, kind: (c.cast("decimal(31,0)") * F.lit(Decimal(unit))).cast(kind)
        sums = (
            sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("from_region", "pk", "to_region", "sd", "prio", "first", "back")
            .agg(
                scaled(_exact(net), "0.0001", "decimal(28,4)").alias("v"), scaled(upper * F.lit(Decimal(1 << 24)) + lower, "0.000001", "decimal(33,6)").alias("tax"),
                scaled(_exact(F.col("price") * F.col("discount")), "0.0001", "decimal(27,4)").alias("off"), scaled(_exact(F.col("quantity")), "0.01", "decimal(22,2)").alias("qty"), F.count("*").alias("n"),
            )
        )
        named = sums.join(region("from_region", "ro"), "from_region").join(region("to_region", "rd"), "to_region")
        _CUBES[key] = named.select("ro", "pk", "rd", "sd", "prio", "first", "back", "v", "tax", "off", "qty", "n").persist()
    return _CUBES[key]


def _segment(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEGMENTS)), number + 1)


def _cells(rows: DataFrame, matrix: str, source: tuple, target: tuple, value, scenario=None) -> DataFrame:
    named = [c.alias(f"{n}_{s}") for s, side in (("from", source), ("to", target)) for n, c in zip(("region", "level", "item"), side, strict=True)]
    scenario = F.lit(schema.BASELINE) if scenario is None else scenario
    labels = [f"{n}_{s}" for s in ("from", "to") for n in ("region", "level", "item")]
    return rows.select(scenario.alias("scenario"), F.lit(matrix).alias("matrix"), *named, value.alias("x")).groupBy("scenario", "matrix", *labels).agg(F.sum("x").cast("double").alias("value"))


def _whole(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def iot_cells(c: DataFrame) -> DataFrame:
    """Z, Y, V (taxes, discounts, surplus), E and EY (quantity, lines)."""
    level, none = F.lit("Sector"), F.lit(None).cast("string")
    row, column = (F.col("ro"), level, _segment(F.col("pk"))), (F.col("rd"), level, F.col("sd"))
    final = (F.col("rd"), F.lit("Consumption category"), F.col("prio"))
    own = lambda name, item: (none, F.lit(name), F.lit(item))
    factor, satellite = "Factor of production", "Satellite account"
    middle, last = c.filter(F.col("prio").isin(*MIDDLE)), c.filter(~F.col("prio").isin(*MIDDLE))
    source = (F.col("ro"), level, _segment(F.col("pk")))
    # what is left of a sector's sales when inputs, taxes and discounts are paid
    signed = c.select(*_triple(source), F.col("v").alias("x")).union(c.select(*_triple(source), -F.col("tax") - F.col("off"))).union(middle.select(*_triple(column), -F.col("v")))
    return _whole([
        _cells(middle, "Z", row, column, F.col("v")), _cells(last, "Y", row, final, F.col("v")),
        _cells(c, "V", own(factor, "Taxes"), source, F.col("tax")), _cells(c, "V", own(factor, "Discounts"), source, F.col("off")),
        _cells(signed, "V", own(factor, "Surplus"), (F.col("region"), F.col("level"), F.col("item")), F.col("x")),
        _cells(c, "E", own(satellite, "Quantity"), source, F.col("qty")), _cells(c, "E", own(satellite, "Lines"), source, F.col("n")),
        _cells(last.filter("back"), "EY", own(satellite, "Quantity"), final, F.col("qty")), _cells(last.filter("back"), "EY", own(satellite, "Lines"), final, F.col("n")),
    ])


def _triple(side: tuple) -> list:
    return [c.alias(n) for n, c in zip(("region", "level", "item"), side, strict=True)]


def sut_cells(c: DataFrame) -> DataFrame:
    """U, S, Yc, Va (taxes, discounts), Vc (discounts of first lines), Ea (quantity), Ec (lines) and EY."""
    act, com, none = F.lit("Activity"), F.lit("Commodity"), F.lit(None).cast("string")
    product = lambda n: F.concat(F.lit("P"), n.cast("string"))
    maker = (F.col("pk") + F.col("first").cast("int")) % 5
    buyer = F.concat(F.lit("A"), (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("sd")) - 1).cast("string"))
    activity, commodity = (F.col("ro"), act, F.concat(F.lit("A"), maker.cast("string"))), (F.col("ro"), com, product(F.col("pk")))
    final = (F.col("rd"), F.lit("Consumption category"), F.col("prio"))
    own = lambda name, item: (none, F.lit(name), F.lit(item))
    factor, satellite = "Factor of production", "Satellite account"
    middle, last = c.filter(F.col("prio").isin(*MIDDLE)), c.filter(~F.col("prio").isin(*MIDDLE))
    return _whole([
        _cells(c, "S", activity, commodity, F.col("v")), _cells(middle, "U", commodity, (F.col("rd"), act, buyer), F.col("v")), _cells(last, "Yc", commodity, final, F.col("v")),
        _cells(c, "Va", own(factor, "Taxes"), activity, F.col("tax")), _cells(c, "Va", own(factor, "Discounts"), activity, F.col("off")),
        _cells(c.filter("first"), "Vc", own(factor, "Taxes"), commodity, F.col("tax")),
        _cells(c, "Ea", own(satellite, "Quantity"), activity, F.col("qty")), _cells(c, "Ec", own(satellite, "Lines"), commodity, F.col("n")),
        _cells(last.filter("back"), "EY", own(satellite, "Lines"), final, F.col("n")),
    ])


def iot_units(spark: SparkSession) -> DataFrame:
    rows = [("Sector", s, "EUR") for s in SEGMENTS] + [("Factor of production", f, "EUR") for f in ("Taxes", "Discounts", "Surplus")]
    return spark.createDataFrame([*rows, ("Satellite account", "Quantity", "t"), ("Satellite account", "Lines", "1")], schema.UNITS)


def sut_units(spark: SparkSession) -> DataFrame:
    rows = [("Activity", f"A{k}", "EUR") for k in range(5)] + [("Commodity", f"P{k}", "EUR") for k in range(5)] + [("Factor of production", f, "EUR") for f in ("Taxes", "Discounts")]
    return spark.createDataFrame([*rows, ("Satellite account", "Quantity", "t"), ("Satellite account", "Lines", "1")], schema.UNITS)


_MODELS: dict[tuple, Model] = {}


def _kept(spark: SparkSession, sf_dir: str, kind: str, tech: str, make) -> Model:
    key = (spark.sparkContext.applicationId, sf_dir, kind, tech)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def iot_model(spark: SparkSession, sf_dir: str) -> Model:
    names = {schema.BASELINE: ("E", "EY", "V", "Y", "Z")}
    return _kept(spark, sf_dir, "IOT", "industry", lambda: Model.from_labelled(iot_cells(cube(spark, sf_dir)), "IOT", iot_units(spark), check=False, names=names))


def sut_model(spark: SparkSession, sf_dir: str, tech: str = "industry") -> Model:
    names = {schema.BASELINE: ("EY", "Ea", "Ec", "S", "U", "Va", "Vc", "Yc")}
    return _kept(spark, sf_dir, "SUT", tech, lambda: Model.from_labelled(sut_cells(cube(spark, sf_dir)), "SUT", sut_units(spark), tech, check=False, names=names))
