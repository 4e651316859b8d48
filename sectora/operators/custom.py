"""Outputs of one's own: a named operator says what it needs and how its block is made; the planner treats it like any other matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, label_id
from ..plans import blocks as B
from ..plans.catalog import CATALOG, Strategy
from ..schema import WrongInput


def register(model: Model, name: str, needs: Iterable[str], make: Callable[..., DataFrame], text: str = "own", override: bool = False) -> Model:
    """The model with an output `name`, made by make(*blocks of needs). Names of the catalog are taken unless override says otherwise."""
    if not override and (name in CATALOG[model.kind] or name in model.operators):
        raise WrongInput(f"{name} is taken")
    if not name.isidentifier():
        raise WrongInput("a name is made of letters, digits and underscores")
    return replace(model, operators={**model.operators, name: Strategy("operator", text, tuple(needs), lambda c, *b: make(*b))})


def ratio_operator(model: Model, name: str, block: str, vector: str, along: str = "columns") -> Model:
    """block over a vector, along its columns or rows; a division by zero gives null, as nothing is guarded."""
    if along not in ("rows", "columns"):
        raise WrongInput("along rows or columns")
    side = "j" if along == "columns" else "i"

    def make(a: DataFrame, x: DataFrame) -> DataFrame:
        under = x.select(F.col("i").alias(side), F.col("value").alias("under"))
        return a.join(under, side, "left").select("i", "j", F.try_divide(F.col("value"), F.coalesce("under", F.lit(0.0))).alias("value"))

    return register(model, name, (block, vector), make, f"{block} / {vector}")


def product_operator(model: Model, name: str, left: str, right: str) -> Model:
    return register(model, name, (left, right), B.matmul, f"{left} @ {right}")


def sum_operator(model: Model, name: str, block: str, over: str = "columns") -> Model:
    """Totals over columns (a column Total) or rows (a row Total)."""
    total = model.spark.createDataFrame([(None, "Total", "Total")], "region string, level string, item string").select(label_id("region", "level", "item").alias("id"), "region", "level", "item")
    ident = label_id(F.lit(None).cast("string"), F.lit("Total"), F.lit("Total"))

    def make(a: DataFrame) -> DataFrame:
        keep = "i" if over == "columns" else "j"
        sums = a.groupBy(keep).agg(F.sum("value").alias("value"))
        return sums.select(F.col("i") if keep == "i" else ident.alias("i"), ident.alias("j") if keep == "i" else F.col("j"), "value")

    out = register(model, name, (block,), make, f"sum of {block} over {over}")
    return out if not out.axis.filter("level = 'Total'").isEmpty() else replace(out, axis=out.axis.unionByName(total))


def zeros_operator(model: Model, name: str, rows_of: str, columns_of: str) -> Model:
    """A block without cells; its labels are the rows of one block and the columns of another."""
    return register(model, name, (rows_of, columns_of), lambda a, b: B.empty(a), "0")
