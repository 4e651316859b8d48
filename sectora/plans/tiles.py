"""Dense blocks as tables of square tiles, for squares that no task could hold: (bi, bj, tile), a tile the doubles of `size` x `size` cells.

A square of n labels has (n / size)^2 tiles, and a product takes (n / size)^3 multiplications of tiles by a numpy kernel instead of a joined row for each
multiplication of cells. Rows of tiles are streamed through tasks: what a task holds is a few tiles, whatever n is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import OUT, stored

TILES = "bi int, bj int, tile binary"
#: Labels along a side of a tile: 8 MB of doubles.
SIZE = 1000
#: Places along a side of the square of a product that one task adds up: 16 tiles.
GROUP = 4


def numbered(ids: DataFrame) -> DataFrame:
    """id, n: labels numbered from 0 in their order, without a sort in one task: parts of a range are counted and follow each other."""
    ranged = ids.select("id").repartitionByRange(max(1, ids.sparkSession.sparkContext.defaultParallelism), "id").withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged)
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a number for each part
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in (first or {0: 0}).items() for x in kv]), F.col("_part").cast("long"))
    return ranged.select("id", (start + F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1).alias("n"))


def placed(a: DataFrame, rows: DataFrame, columns: DataFrame, size: int, width: int) -> DataFrame:
    """bi, bj, at (place in the tile), value: the cells of a block whose labels are numbered by rows and columns; others are left out."""
    side = lambda t, k, n: t.select(F.col("id").alias(k), F.col("n").alias(n))
    both = a.join(side(rows, "i", "r"), "i").join(side(columns, "j", "c"), "j")
    at = F.col("r") % size * width + F.col("c") % width
    return both.select((F.col("r") / size).cast("int").alias("bi"), (F.col("c") / width).cast("int").alias("bj"), at.cast("int").alias("at"), "value")


def filled(cells: DataFrame, size: int, width: int) -> DataFrame:
    """Tiles of placed cells; cells that stand twice add up."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        out = np.bincount(part["at"].to_numpy(), part["value"].to_numpy(), size * width)
        return pd.DataFrame({"bi": part["bi"].iloc[:1], "bj": part["bj"].iloc[:1], "tile": [out.tobytes()]})

    return cells.groupBy("bi", "bj").applyInPandas(fill, TILES)


def from_cells(a: DataFrame, rows: DataFrame, columns: DataFrame, size: int = SIZE, width: int | None = None) -> DataFrame:
    """Tiles (size x width, square unless a width is given) of a block (i, j, value)."""
    width = width or size
    return filled(placed(a, rows, columns, size, width), size, width)


def to_cells(a: DataFrame, rows: DataFrame, columns: DataFrame, size: int = SIZE, width: int | None = None) -> DataFrame:
    """The cells (i, j, value) of tiles that aren't zero."""
    width = width or size

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, bj, tile in zip(frame["bi"], frame["bj"], frame["tile"], strict=True):
                x = np.frombuffer(tile)
                at = np.flatnonzero(x)
                yield pd.DataFrame({"r": bi * size + at // width, "c": bj * width + at % width, "value": x[at]})

    cells = a.mapInPandas(cut, "r long, c long, value double")
    side = lambda t, k, n: t.select(F.col("id").alias(k), F.col("n").alias(n))
    return cells.join(side(rows, "i", "r"), "r").join(side(columns, "j", "c"), "c").select(*[f.split()[0] for f in OUT.split(", ")])


def transpose(a: DataFrame, size: int = SIZE) -> DataFrame:
    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            turned = [np.frombuffer(t).reshape(size, -1).T.tobytes() for t in frame["tile"]]
            yield pd.DataFrame({"bi": frame["bj"], "bj": frame["bi"], "tile": turned})

    return a.mapInPandas(turn, TILES)


def _summed(parts: DataFrame) -> DataFrame:
    """The sum of tiles of one place."""

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["tile"].iloc[0]).copy()
        for t in frame["tile"].iloc[1:]:
            total += np.frombuffer(t)
        return pd.DataFrame({"bi": frame["bi"].iloc[:1], "bj": frame["bj"].iloc[:1], "tile": [total.tobytes()]})

    return parts.groupBy("bi", "bj").applyInPandas(whole, TILES)


def dealt(rows: DataFrame, order: list[str], work: Callable[[Iterator[dict]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Rows brought together by (gi, gj), which name squares of places, and handed to `work` one after the other in an order; only what it keeps is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, tile in work(row for batch in batches for row in batch.to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([tile], pa.binary())], ["bi", "bj", "tile"])

    return rows.repartition("gi", "gj").sortWithinPartitions("gi", "gj", *order).mapInArrow(run, TILES)


def matmul(a: DataFrame, b: DataFrame, size: int = SIZE, plus: DataFrame | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """The product of two tiled blocks, and plus. Tiles go to squares of `GROUP` x `GROUP` places of the result; a task adds up its square in place, one inner
    index after the other, so that it holds the square and what stands at one inner index, and each place leaves one tile. blocks: how many tiles the
    result has down and across, where known."""
    rows, columns = blocks or (_extent(a, "bi"), _extent(b, "bj"))
    group = max(1, min(GROUP, -(-max(rows, columns) // 3)))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // group) - 1))))
    left = a.select((F.col("bi") / group).cast("int").alias("gi"), across(columns).alias("gj"), F.col("bj").alias("k"), F.lit(0).alias("side"), F.col("bi").alias("at"), F.lit(0).alias("too"), "tile")
    right = b.select(across(rows).alias("gi"), (F.col("bj") / group).cast("int").alias("gj"), F.col("bi").alias("k"), F.lit(1).alias("side"), F.col("bj").alias("at"), F.lit(0).alias("too"), "tile")
    both = left.unionByName(right)
    if plus is not None:
        both = both.unionByName(plus.select((F.col("bi") / group).cast("int").alias("gi"), (F.col("bj") / group).cast("int").alias("gj"), F.lit(-1).alias("k"), F.lit(2).alias("side"), F.col("bi").alias("at"), F.col("bj").alias("too"), "tile"))

    def multiply(found: Iterator[dict]) -> Iterator[tuple[int, int, bytes]]:
        place, k, sums, lefts = None, None, {}, {}
        for row in found:
            if (row["gi"], row["gj"]) != place:
                yield from ((bi, bj, x.tobytes()) for (bi, bj), x in sums.items())
                place, k, sums, lefts = (row["gi"], row["gj"]), None, {}, {}
            if row["k"] != k:
                k, lefts = row["k"], {}
            x = np.frombuffer(row["tile"])
            if row["side"] == 2:
                sums[row["at"], row["too"]] = x.copy()
            elif row["side"] == 0:
                lefts[row["at"]] = x.reshape(-1, size)
            else:
                for bi, y in lefts.items():
                    product = (y @ x.reshape(size, -1)).ravel()
                    spot = (bi, row["at"])
                    if spot in sums:
                        sums[spot] += product
                    else:
                        sums[spot] = product
        yield from ((bi, bj, x.tobytes()) for (bi, bj), x in sums.items())

    return dealt(both, ["k", "side", "at"], multiply)


def _extent(a: DataFrame, side: str) -> int:
    return 1 + (a.agg(F.max(side)).first()[0] or 0)


def add(*blocks: DataFrame) -> DataFrame:
    whole = blocks[0]
    for b in blocks[1:]:
        whole = whole.unionByName(b)
    return _summed(whole)


def norm(a: DataFrame) -> float:
    """The root of the sum of all squared cells."""

    def squares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"s": [sum(float(x @ x) for x in map(np.frombuffer, frame["tile"]))]})

    return float(a.mapInPandas(squares, "s double").agg(F.sum("s")).first()[0] or 0.0) ** 0.5


def largest(a: DataFrame) -> float:
    """The largest cell without its sign; one number a tile is summed up."""

    def most(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"m": [max((float(np.abs(np.frombuffer(t)).max()) for t in frame["tile"]), default=0.0)]})

    return a.mapInPandas(most, "m double").agg(F.max("m")).first()[0] or 0.0
