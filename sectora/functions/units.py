"""Units: prefixes and powers taken apart, and conversions between named units closed over the chains that they form.

Tables of units are vocabularies: a row for each spelling, whatever the number of quantities that use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernels import stored
from ..schema import WrongInput

#: SI prefixes (fixed values).
PREFIXES = {"": 1.0, "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
#: Factors that differ by more than this share contradict each other.
NEAR = 1e-9
CONVERSIONS = "unit_from string, unit_to string, factor double"


#: A short name and its power, as km2, m^3, s-1.
POWER = r"^([A-Za-zµ]{1,3})\^?(-?[0-9])$"


def parsed(units: DataFrame, named: DataFrame) -> DataFrame:
    """unit, base, power, scale: a unit is `scale` times base to the power. units, named: unit.

    Named units stand as they are spelt. Others lose their power, then a prefix if what it stands before is another unit's core, named, or left by two units
    (the g of kg and Mg); of several bases the shortest is taken."""
    spelt = units.select("unit").distinct()
    atoms = named.select("unit").distinct()
    raised = F.col("unit").rlike(POWER)
    core = F.when(raised, F.regexp_extract("unit", POWER, 1)).otherwise(F.col("unit")).alias("core")
    power = F.when(raised, F.regexp_extract("unit", POWER, 2).cast("int")).otherwise(1).alias("power")
    others = spelt.join(atoms, "unit", "left_anti").select("unit", core, power)
    prefixes = F.explode(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])).alias("prefix", "by")
    read = others.select("*", prefixes).filter(F.col("core").startswith(F.col("prefix"))).withColumn("base", F.expr("substring(core, length(prefix) + 1)"))
    shared = read.filter("base <> ''").groupBy("base").agg(F.countDistinct("core").alias("n")).filter("n > 1").select("base")
    bases = others.select(F.col("core").alias("base")).union(atoms.select("unit")).union(shared).distinct()
    best = read.join(bases, "base").groupBy("unit", "power").agg(F.min_by(F.struct("base", "by"), F.struct(F.length("base"), "base")).alias("best"))
    apart = best.select("unit", "best.base", "power", F.pow("best.by", "power").alias("scale"))
    return apart.unionByName(spelt.join(atoms, "unit", "left_semi").select("unit", F.col("unit").alias("base"), F.lit(1).alias("power"), F.lit(1.0).alias("scale")))


def closed(conversions: DataFrame) -> DataFrame:
    """All conversions (CONVERSIONS) that follow from the given ones, backwards and in chains, those from a unit to itself among them. Each round doubles the
    length of the chains. Conversions that contradict each other are refused."""
    given = conversions.select("unit_from", "unit_to", "factor")
    if not given.filter("factor is null or factor <= 0 or isnan(factor) or unit_from is null or unit_to is null").isEmpty():
        raise WrongInput("a conversion without a positive factor")
    back = given.select(F.col("unit_to").alias("unit_from"), F.col("unit_from").alias("unit_to"), (1 / F.col("factor")).alias("factor"))
    own = given.select("unit_from").union(given.select("unit_to")).distinct().select("unit_from", F.col("unit_from").alias("unit_to"), F.lit(1.0).alias("factor"))
    known, size = _agreed(given.unionByName(back).unionByName(own)), -1
    while size != (size := known.count()):
        further = known.select("unit_from", F.col("unit_to").alias("through"), F.col("factor").alias("first"))
        onward = known.select(F.col("unit_from").alias("through"), "unit_to", F.col("factor").alias("second"))
        chained = further.join(onward, "through").select("unit_from", "unit_to", (F.col("first") * F.col("second")).alias("factor"))
        known = _agreed(known.unionByName(chained))
    return known


def _agreed(conversions: DataFrame) -> DataFrame:
    by_pair = stored(conversions.groupBy("unit_from", "unit_to").agg(F.min("factor").alias("factor"), F.max("factor").alias("most")))
    if not by_pair.filter(F.col("most") > F.col("factor") * (1 + NEAR)).isEmpty():
        raise WrongInput("conversions that contradict each other")
    return by_pair.select("unit_from", "unit_to", "factor")


def factors(pairs: DataFrame, conversions: DataFrame) -> DataFrame:
    """pairs (unit_from, unit_to) with the factor between them, null where they measure different things."""
    spelt = pairs.select(F.col("unit_from").alias("unit")).union(pairs.select("unit_to")).distinct()
    named = conversions.select(F.col("unit_from").alias("unit")).union(conversions.select("unit_to"))
    read = stored(parsed(spelt, named))
    side = lambda s: read.select(F.col("unit").alias(f"unit_{s}"), F.col("base").alias(f"base_{s}"), F.col("power").alias(f"power_{s}"), F.col("scale").alias(f"scale_{s}"))
    both = pairs.select("unit_from", "unit_to").distinct().join(side("from"), "unit_from").join(side("to"), "unit_to")
    between = closed(conversions).select(F.col("unit_from").alias("base_from"), F.col("unit_to").alias("base_to"), "factor")
    met = both.join(between, ["base_from", "base_to"], "left")
    base = F.when(F.col("base_from") == F.col("base_to"), 1.0).otherwise(F.col("factor"))
    whole = F.when(F.col("power_from") == F.col("power_to"), F.col("scale_from") / F.col("scale_to") * F.pow(base, F.col("power_from")))
    return met.select("unit_from", "unit_to", whole.alias("factor"))
