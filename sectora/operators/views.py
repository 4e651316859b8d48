"""Frames for looking at a model: what a plot would show, the one-sheet table, and lookups of the nearest year."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Model


def plot_data(data: DataFrame, by: Iterable[str], filters: Mapping[str, Iterable] | None = None, agg: str = "sum", top: int | None = None, top_by: str | None = None) -> DataFrame:
    """data (with a column value) filtered, aggregated by columns (null is a group) and cut to the `top` members of a column by the sum of |value|."""
    by = list(by)
    for column, allowed in (filters or {}).items():
        data = data.filter(F.col(column).isin(*([allowed] if isinstance(allowed, str) else list(allowed))))
    out = data.groupBy(*by).agg(F.expr(f"{agg}(value)").alias("value"))
    if top is not None:
        column = top_by or by[0]
        best = out.groupBy(column).agg(F.sum(F.abs("value")).alias("size")).orderBy(F.desc("size"), column).limit(top).select(F.col(column).alias("_kept"))
        out = out.join(best, out[column].eqNullSafe(best["_kept"]), "left_semi")
    return out


def composition(data: DataFrame, total: Iterable[str], part: str) -> DataFrame:
    """Each part's share of its total."""
    keys = list(total)
    out = data.groupBy(*keys, part).agg(F.sum("value").alias("value"))
    whole = F.sum("value").over(Window.partitionBy(*keys))
    return out.withColumn("share", F.when(whole != 0, F.col("value") / whole))


def one_sheet(model: Model, scenario: str | None = None) -> DataFrame:
    """All flows of a scenario on one grid of labels, as labelled cells; absent cells are zero."""
    base = model.reset(scenario, "flows")
    return base.labelled_cells([scenario or model.baseline]).drop("scenario", "matrix")


def nearest_year(wanted: DataFrame, known: DataFrame, key: str = "region", year: str = "year") -> DataFrame:
    """For each key and year asked for the rows of the nearest year known; of two as near the earlier."""
    years = known.select(F.col(key).alias("_key"), F.col(year).alias("_year")).distinct()
    pairs = wanted.join(years, wanted[key] == years["_key"])
    rank = F.row_number().over(Window.partitionBy(key, year).orderBy(F.abs(F.col("_year") - F.col(year)), "_year"))
    best = pairs.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_key")
    found = known.withColumnRenamed(year, "year_found").withColumnRenamed(key, "_key")
    on = (F.col("_year") == F.col("year_found")) & (best[key] == F.col("_key"))
    return best.join(found, on).drop("_key", "_year")


def search(model: Model, pattern: str, name: str | None = None, ignore_case: bool = True) -> DataFrame:
    return model.search(pattern, name, ignore_case)


def sliced(model: Model, matrix: str, scenario: str | None = None, **labels: Iterable[str]) -> DataFrame:
    """A matrix's labelled cells where label columns (region_from, item_to, ...) are among the given labels."""
    out = model.table(matrix, scenario)
    for column, allowed in labels.items():
        out = out.filter(F.col(column).isin(*([allowed] if isinstance(allowed, str) else list(allowed))))
    return out


def wide(model: Model, matrix: str, scenario: str | None = None) -> DataFrame:
    """A matrix with a column for each column label, absent cells zero. The labels come to the driver, as they name the columns; the cells don't."""
    cells = model.table(matrix, scenario).withColumn("column", F.concat_ws("|", "region_to", "item_to"))
    names = sorted(r["column"] for r in cells.select("column").distinct().collect())
    return cells.groupBy("region_from", "level_from", "item_from").pivot("column", names).sum("value").fillna(0.0, names)


def path_links(paths: DataFrame) -> DataFrame:
    """source, target, value: the links of structural paths, summed, for a flow diagram; each path goes from the supplier to the demand."""
    steps = paths.select(F.split("path", " -> ").alias("s"), "contribution")
    pairs = steps.select(F.posexplode(F.slice("s", F.lit(1), F.size("s") - 1)).alias("k", "source"), "s", "contribution")
    return pairs.groupBy("source", F.get("s", F.col("k") + 1).alias("target")).agg(F.sum("contribution").alias("value"))


def paths_by_depth(paths: DataFrame) -> DataFrame:
    """depth, paths, contribution."""
    return paths.groupBy("depth").agg(F.count("*").alias("paths"), F.sum("contribution").alias("contribution"))
