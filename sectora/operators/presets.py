"""Mixes from outside statistics: what a supply or trade mix should be, from shares by group and year, ready for `scenarios`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Model
from ..schema import WrongInput
from .indicators import outer_level
from .views import nearest_year


def _for_year(statistics: DataFrame, year: int, key: str) -> DataFrame:
    """The rows of the year nearest to the one asked for, by key; of two as near the earlier."""
    wanted = statistics.select(key).distinct().withColumn("year", F.lit(year))
    return nearest_year(wanted, statistics, key=key).drop("year", "year_found")


def supply_shares(model: Model, statistics: DataFrame, groups: Mapping[str, str], year: int, scenario: str | None = None) -> DataFrame:
    """region, item, share for a supply mix. statistics: region, group, year, value; groups: item -> group. A group's share goes to its items by their
    output in the region, evenly where they make nothing; regions without statistics are left out."""
    if not groups:
        raise WrongInput("no item belongs to a group")
    table = model.spark.createDataFrame([*groups.items()], "item string, group string")
    own = _for_year(statistics, year, "region").groupBy("region", "group").agg(F.sum("value").alias("value")).join(table.select("group").distinct(), "group", "left_semi")
    own = own.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("region")))
    x = model.resolve("X" if model.kind == "IOT" else "Xa", scenario)
    goods = model.axis.filter(F.col("level") == outer_level(model)).join(table, "item")
    made = goods.join(x.select(F.col("i").alias("id"), F.col("value").alias("made")), "id", "left").fillna(0.0, ["made"])
    by = Window.partitionBy("region", "group")
    weight = F.when(F.sum("made").over(by) > 0, F.col("made") / F.sum("made").over(by)).otherwise(1 / F.count("*").over(by))
    made = made.withColumn("weight", weight).select("region", "group", "item", "weight")
    out = made.join(own.select("region", "group", "share"), ["region", "group"]).select("region", "item", (F.col("share") * F.col("weight")).alias("share"))
    return out.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("region")))


def trade_shares(model: Model, statistics: DataFrame, item: str, year: int) -> DataFrame:
    """item, destination, origin, share for a trade mix. statistics: destination, origin, year, share. Origins that the table hasn't are left out and the
    rest brought to one; destinations without statistics buy at home."""
    regions = model.index("Region").select(F.col("item").alias("origin"))
    known = _for_year(statistics, year, "destination").join(regions, "origin", "left_semi").join(regions.withColumnRenamed("origin", "destination"), "destination", "left_semi").filter("share > 0")
    known = known.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("destination"))).select("destination", "origin", "share")
    home = regions.select(F.col("origin").alias("destination"), "origin", F.lit(1.0).alias("share")).join(known.select("destination"), "destination", "left_anti")
    return known.unionByName(home).select(F.lit(item).alias("item"), "destination", "origin", "share")
