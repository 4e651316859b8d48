"""Inverses and solutions of I - a, and inverses of other blocks: one numpy task where the labels are few, tiles where they are many.

The numpy kernel holds one dense square; it is chosen only while that fits a worker (`dense_labels`). Beyond, squares are inverted by elimination on tiles,
with pivots, and kept under their digest (`elimination`); systems with few right sides are solved on tiles without an inverse unless one is at hand
(`krylov`). Both ways give the same to rounding, for any square: singular ones get the pseudo-inverse, and the spectral radius doesn't matter.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NotComputable
from . import blocks as B

#: Labels up to which a square is held by one task: 4,000 labels take 128 MB a matrix.
DENSE_LABELS = 4_000
#: Right sides up to which a system is solved without an inverse.
FEW = 16
OUT = "i long, j long, value double"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; set here only where the session has none and runs locally."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sectora-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts plan and lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/sectora-blocks/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one_minus(a: DataFrame, ids: DataFrame) -> DataFrame:
    return B.concat(B.negate(B.keep(a, ids, ids)), B.identity(ids))


def _inverted(block: DataFrame, rows: DataFrame, columns: DataFrame, size: int | None = None):
    from . import elimination

    return elimination.factor(stored(block), rows, columns, size)


def solve_on_tiles(a: DataFrame, b: DataFrame, ids: DataFrame, transposed: bool = False, size: int | None = None) -> DataFrame:
    """x in (I - a) x = b, or in the transposed system. An inverse that is in the store is used; one is made for more than FEW right sides, and where a search
    without it gets nowhere."""
    from . import elimination, krylov
    from . import tiles as T

    square, b = stored(_one_minus(a, ids)), stored(b.select("i", "j", "value"))
    known = elimination.factor(square, ids, ids, size, only_stored=True)
    across = stored(T.numbered(b.select(F.col("j").alias("id")).distinct()))
    width = across.count()
    if known is None and 0 < width <= FEW:
        numbers = stored(T.numbered(ids))
        n = numbers.count()
        size = size or max(1, min(T.SIZE, n))
        every_row = b.sparkSession.range(-(-n // size)).select(F.col("id").cast("int").alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("at"), F.lit(0.0).alias("value"))
        right = T.filled(T.placed(b, numbers, across, size, width).unionByName(every_row), size, width)
        try:
            x = krylov.gmres(T.from_cells(B.transpose(square) if transposed else square, numbers, numbers, size), right, size, width)
            return T.to_cells(x, numbers, across, size, width)
        except krylov.Stagnant:
            pass
    return (known or elimination.factor(square, ids, ids, size)).times(b, transposed)


def _square(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (np.searchsorted(ids, rows), np.searchsorted(ids, columns)), values)
    return out


def _cells(x: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> pd.DataFrame:
    at = np.nonzero(x)
    return pd.DataFrame({"i": ids[at[0]], "j": columns[at[1]], "value": x[at]})


def inverse(a: DataFrame, ids: DataFrame, leontief: bool = True, labels: int = 0) -> DataFrame:
    """(I - a)^-1 over ids, or a^-1; singular squares get the pseudo-inverse. labels: how many ids there are, where known."""
    if labels > DENSE_LABELS:
        return inverse_on_tiles(a, ids, leontief)

    def kernel(cells: pd.DataFrame) -> pd.DataFrame:
        known = np.unique(cells["i"].to_numpy())
        square = _square(cells["i"].to_numpy(), cells["j"].to_numpy(), cells["value"].to_numpy(), known)
        square = np.eye(len(known)) - square if leontief else square
        try:
            found = np.linalg.inv(square)
        except np.linalg.LinAlgError:
            found = np.linalg.pinv(square)
        return _cells(found, known, known)

    marks = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("value"))
    return B.concat(B.keep(a, ids, ids), marks).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda cells: kernel(cells), OUT)


def inverse_on_tiles(a: DataFrame, ids: DataFrame, leontief: bool = True, size: int | None = None) -> DataFrame:
    """The same by elimination on tiles of `size` labels, or from the store."""
    return _inverted(_one_minus(a, ids) if leontief else B.keep(a, ids, ids), ids, ids, size).cells()


def rectangular_inverse(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The inverse of a block whose rows and columns are of different sets (as many of each); rows and columns change places. Pseudo-inverse if singular."""
    if max(rows.count(), columns.count()) > DENSE_LABELS:
        return _inverted(B.keep(a, rows, columns), rows, columns).cells()

    def kernel(cells: pd.DataFrame) -> pd.DataFrame:
        r, c = np.unique(cells["i"][cells["part"] < 2].to_numpy()), np.unique(cells["j"][cells["part"] != 1].to_numpy())
        some = cells[cells["part"] == 0]
        x = np.zeros((len(r), len(c)))
        np.add.at(x, (np.searchsorted(r, some["i"].to_numpy()), np.searchsorted(c, some["j"].to_numpy())), some["value"].to_numpy())
        try:
            found = np.linalg.inv(x)
        except np.linalg.LinAlgError:
            found = np.linalg.pinv(x)
        return _cells(found, c, r)

    mark = lambda ids, part: ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("value"), F.lit(part).alias("part"))
    whole = a.select("i", "j", "value", F.lit(0).alias("part")).union(mark(rows, 1)).union(mark(columns, 2))
    return whole.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda cells: kernel(cells), OUT)


def solve(a: DataFrame, b: DataFrame, ids: DataFrame, transposed: bool = False, labels: int = 0) -> DataFrame:
    """x in (I - a) x = b, or in (I - a)^T x = b; the inverse isn't made. Least squares where the square is singular."""
    if labels > DENSE_LABELS:
        return solve_on_tiles(a, b, ids, transposed)
    a = B.transpose(a) if transposed else a

    def kernel(cells: pd.DataFrame) -> pd.DataFrame:
        square = cells[cells["part"] == 0]
        right = cells[cells["part"] == 1]
        known = np.unique(np.concatenate([square["i"].to_numpy(), right["i"].to_numpy()]))
        columns = np.unique(right["j"].to_numpy())
        x = np.zeros((len(known), len(columns)))
        np.add.at(x, (np.searchsorted(known, right["i"].to_numpy()), np.searchsorted(columns, right["j"].to_numpy())), right["value"].to_numpy())
        m = np.eye(len(known)) - _square(square["i"].to_numpy(), square["j"].to_numpy(), square["value"].to_numpy(), known)
        try:
            found = np.linalg.solve(m, x)
        except np.linalg.LinAlgError:
            found = np.linalg.pinv(m) @ x
        return _cells(found, known, columns)

    marks = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("value"))
    whole = B.concat(B.keep(a, ids, ids), marks).withColumn("part", F.lit(0)).unionByName(b.select("i", "j", "value").withColumn("part", F.lit(1)))
    return whole.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda cells: kernel(cells), OUT)
