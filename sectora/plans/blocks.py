"""Algebra of blocks: DataFrames (i long, j long, value double) of the cells that aren't zero. A vector is a block whose j is ONE.

Every operation is a join, an aggregation or a projection, left to Catalyst; none looks at the data. Absent cells are zero. No broadcast is forced: a side
below Spark's threshold is broadcast by Spark itself, larger ones are joined by a shuffle on the shared label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import WrongInput

#: The column of a vector.
ONE = 0


def empty(like: DataFrame) -> DataFrame:
    return like.select("i", "j", "value").limit(0)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def add(*blocks: DataFrame) -> DataFrame:
    """The sum of blocks; labels that some lack count as zero there."""
    whole = reduce(DataFrame.unionByName, [b.select("i", "j", "value") for b in blocks])
    return whole.groupBy("i", "j").agg(F.sum("value").alias("value"))


def negate(a: DataFrame) -> DataFrame:
    return a.withColumn("value", -F.col("value"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, negate(b))


def concat(*blocks: DataFrame) -> DataFrame:
    """Blocks that share no cell, side by side."""
    return reduce(DataFrame.unionByName, [b.select("i", "j", "value") for b in blocks])


def labels_apart(a: DataFrame, a_side: str, b: DataFrame, b_side: str) -> DataFrame:
    """Labels (id) that stand on one side only: columns ("j") or rows ("i") of a against those of b. Empty where the two agree."""
    left, right = a.select(F.col(a_side).alias("id")).distinct(), b.select(F.col(b_side).alias("id")).distinct()
    return left.join(right, "id", "left_anti").unionByName(right.join(left, "id", "left_anti"))


def require_same_labels(a: DataFrame, a_side: str, b: DataFrame, b_side: str) -> None:
    """An error where two sides differ in labels. Products leave out what doesn't meet, as absent cells are zero; call this where nothing may be absent."""
    if not labels_apart(a, a_side, b, b_side).isEmpty():
        raise WrongInput("the labels of the two sides differ")


def require_square(a: DataFrame, labels: DataFrame | None = None) -> None:
    """An error where rows and columns differ in labels, or where either has one that isn't among `labels` (id)."""
    if labels is None:
        return require_same_labels(a, "i", a, "j")
    both = a.select(F.col("i").alias("id")).union(a.select(F.col("j").alias("id")))
    if not both.join(labels.select("id"), "id", "left_anti").isEmpty():
        raise WrongInput("a label of the block isn't among those of the square")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def sum_rows(a: DataFrame) -> DataFrame:
    """The vector of row totals."""
    return a.groupBy("i").agg(F.sum("value").alias("value")).select("i", F.lit(ONE).cast("long").alias("j"), "value")


def sum_columns(a: DataFrame) -> DataFrame:
    """The vector of column totals."""
    return a.groupBy("j").agg(F.sum("value").alias("value")).select(F.col("j").alias("i"), F.lit(ONE).cast("long").alias("j"), "value")


def inverse_vector(x: DataFrame) -> DataFrame:
    """1/x, and 0 where x is 0."""
    return x.filter("value <> 0").withColumn("value", 1 / F.col("value"))


def scale_columns(a: DataFrame, x: DataFrame) -> DataFrame:
    """a diag(x), without the diagonal matrix."""
    return a.join(x.select(F.col("i").alias("j"), F.col("value").alias("x")), "j").select("i", "j", (F.col("value") * F.col("x")).alias("value"))


def scale_rows(x: DataFrame, a: DataFrame) -> DataFrame:
    """diag(x) a."""
    return a.join(x.select("i", F.col("value").alias("x")), "i").select("i", "j", (F.col("value") * F.col("x")).alias("value"))


def transpose_matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """The vector of a's columns weighted by x."""
    return sum_columns(scale_rows(x, a))


def identity(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))


def diagonal(x: DataFrame) -> DataFrame:
    return x.select("i", F.col("i").alias("j"), "value")


def keep(a: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """The cells whose row (column) is among the ids of rows (columns)."""
    if rows is not None:
        a = a.join(rows.select(F.col("id").alias("i")), "i", "left_semi")
    if columns is not None:
        a = a.join(columns.select(F.col("id").alias("j")), "j", "left_semi")
    return a.select("i", "j", "value")


def difference(a: DataFrame, base: DataFrame, relative: bool = False) -> DataFrame:
    """a less base, cell by cell; relative to base if asked (a division by a zero base gives null)."""
    both = a.select("i", "j", F.col("value").alias("x")).join(base.select("i", "j", F.col("value").alias("y")), ["i", "j"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.select("i", "j", (F.when(y != 0, (x - y) / y) if relative else x - y).alias("value"))
