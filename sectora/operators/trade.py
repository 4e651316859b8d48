"""Trade between regions: flows, what is embodied in them, and how concentrated its origins are."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Model
from ..plans import blocks as B
from ..schema import NotComputable, WrongInput
from .indicators import is_chenery_moses

REGIONS = ["region_from", "region_to"]


def _parts(model: Model, planner, intermediate: bool, final: bool) -> DataFrame:
    names = ("Z", "Y") if model.kind == "IOT" else ("U", "Yc")
    wanted = [planner.resolve(n) for n, use in zip(names, (intermediate, final), strict=True) if use]
    if not wanted:
        raise WrongInput("neither intermediate nor final use is asked for")
    return B.concat(*wanted)


def _regions(model: Model, block: DataFrame, item: str | None, side: str = "i") -> DataFrame:
    """The block's cells with regions, of one item of the row side (or the column side)."""
    at = lambda k, n: model.axis.select(F.col("id").alias(k), F.col("region").alias(n), F.col("item").alias(f"item_{k}"))
    rows = block.join(at("i", "region_from"), "i").join(at("j", "region_to"), "j")
    return rows.filter(F.col(f"item_{side}") == item) if item is not None else rows


def grouped(flows: DataFrame, clusters: Mapping[str, Iterable[str]] | None, direction: str = "both") -> DataFrame:
    """region_from, region_to, value with regions replaced by the cluster they are in; others keep their name."""
    if clusters:
        if direction not in ("origin", "destination", "both"):
            raise WrongInput(f"no direction is called {direction!r}")
        spark = flows.sparkSession
        table = spark.createDataFrame([(m, c) for c, members in clusters.items() for m in members], "member string, cluster string")
        for column, way in (("region_from", "origin"), ("region_to", "destination")):
            if direction in (way, "both"):
                flows = flows.join(F.broadcast(table), flows[column] == table["member"], "left").withColumn(column, F.coalesce("cluster", column)).drop("member", "cluster")  # as many rows as the caller lists
    return flows.groupBy(*REGIONS).agg(F.sum("value").alias("value"))


def with_totals(flows: DataFrame) -> DataFrame:
    """flows with a Total row and column."""
    summed = flows.cube(*REGIONS).agg(F.sum("value").alias("value"), F.grouping("region_from").alias("gf"), F.grouping("region_to").alias("gt"))
    label = lambda c, g: F.when(F.col(g) == 1, F.lit("Total")).otherwise(F.col(c)).alias(c)
    return summed.select(label("region_from", "gf"), label("region_to", "gt"), "value")


def trades(model: Model, item: str | None = None, scenario: str | None = None, clusters: Mapping[str, Iterable[str]] | None = None, direction: str = "both", intermediate: bool = True, final: bool = True, aggregate: bool = True, total: bool = False) -> DataFrame:
    """region_from, region_to, value of an item's flows (of all goods, where they share a unit), domestic flows included; not aggregated, by cell.

    Where a supply-use table holds trade on the supply side, its supply of the item is taken, aggregated only."""
    if item is None and model.units.filter(F.col("level").isin(*model.levels)).select("unit").distinct().count() > 1:
        raise NotComputable("goods in several units can't be added")
    planner = model.planner(scenario)
    if model.kind == "SUT" and is_chenery_moses(model, scenario):
        if not aggregate:
            raise NotComputable("supply-side trade is known by region only")
        rows = _regions(model, planner.resolve("S"), item, "j")
    else:
        rows = _regions(model, _parts(model, planner, intermediate, final), item)
    if not aggregate:
        return model.labelled(rows.select("i", "j", "value"))
    out = grouped(rows, clusters, direction)
    return with_totals(out) if total else out


def weights(model: Model, planner, indicator: str, item: str, method: str) -> DataFrame:
    """The vector of what one unit of each good embodies: direct, total, or upstream (total less direct)."""
    if indicator not in ("satellite", "factor"):
        raise WrongInput(f"no indicator is called {indicator!r}")
    level = "Satellite account" if indicator == "satellite" else "Factor of production"
    rows = model.axis.filter(F.col("level") == level)
    ids = (rows if item == "total value added" and indicator == "factor" else rows.filter(F.col("item") == item)).select("id")
    side = "" if model.kind == "IOT" else "c"
    direct, whole = (("e", "f") if indicator == "satellite" else ("v", "m"))
    vector = lambda name: B.sum_columns(B.keep(planner.resolve(name + side), ids))
    if method == "direct":
        return vector(direct)
    if method == "total":
        return vector(whole)
    if method == "upstream":
        return B.subtract(vector(whole), vector(direct))
    raise WrongInput(f"no method is called {method!r}")


def content(model: Model, indicator: str, of: str, item: str | None = None, method: str = "total", scenario: str | None = None, clusters=None, direction: str = "both", intermediate: bool = True, final: bool = True, total: bool = False) -> DataFrame:
    """region_from, region_to, value: the account or factor `of` embodied in the flows of goods."""
    planner = model.planner(scenario)
    rows = B.scale_rows(weights(model, planner, indicator, of, method), _parts(model, planner, intermediate, final))
    out = grouped(_regions(model, rows, item), clusters, direction)
    return with_totals(out) if total else out


def content_breakdown(model: Model, indicator: str, of: str, scenario: str | None = None, intermediate: bool = True, final: bool = True) -> DataFrame:
    """contributor, region_from, region_to, value: total content by the region where it is caused."""
    if model.kind != "IOT":
        raise NotComputable("the breakdown is made for input-output tables")
    planner = model.planner(scenario)
    by = B.scale_rows(weights(model, planner, indicator, of, "direct"), planner.resolve("w"))
    place = model.axis.select("id", "region")
    by = by.join(place.select(F.col("id").alias("i"), F.col("region").alias("contributor")), "i").groupBy("contributor", F.col("j").alias("k")).agg(F.sum("value").alias("weight"))
    flows = _parts(model, planner, intermediate, final).join(place.select(F.col("id").alias("j"), F.col("region").alias("region_to")), "j").groupBy(F.col("i").alias("k"), "region_to").agg(F.sum("value").alias("value"))
    rows = by.join(flows, "k").join(place.select(F.col("id").alias("k"), F.col("region").alias("region_from")), "k")
    return rows.groupBy("contributor", *REGIONS).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def embodied_imports(flows: DataFrame) -> DataFrame:
    """region, imports: content that comes from other regions."""
    return flows.groupBy(F.col("region_to").alias("region")).agg(F.sum(F.when(F.col("region_from") != F.col("region_to"), F.col("value")).otherwise(0.0)).alias("imports"))


def embodied_exports(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.col("region_from").alias("region")).agg(F.sum(F.when(F.col("region_from") != F.col("region_to"), F.col("value")).otherwise(0.0)).alias("exports"))


def embodied_net_imports(flows: DataFrame) -> DataFrame:
    both = embodied_imports(flows).join(embodied_exports(flows), "region", "full")
    return both.select("region", (F.coalesce("imports", F.lit(0.0)) - F.coalesce("exports", F.lit(0.0))).alias("net_imports"))


def _shares(breakdown: DataFrame) -> DataFrame:
    size = F.abs("value")
    whole = F.sum(size).over(Window.partitionBy(*REGIONS))
    return breakdown.withColumn("share", F.when(whole != 0, size / whole).otherwise(0.0))


def concentration(breakdown: DataFrame) -> DataFrame:
    """region_from, region_to, hhi: the sum of squared shares of the contributing regions."""
    return _shares(breakdown).groupBy(*REGIONS).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def exposure(breakdown: DataFrame, to: Iterable[str]) -> DataFrame:
    """region_from, region_to, exposure: the share of the named contributing regions."""
    return _shares(breakdown).groupBy(*REGIONS).agg(F.sum(F.when(F.col("contributor").isin(*list(to)), F.col("share")).otherwise(0.0)).alias("exposure"))
