"""Inverses of squares that no task could hold: Gauss-Jordan on tiles with pivots chosen over all rows, and a store that keeps them.

One step takes a column of tiles. Each of its tiles proposes as many rows as a tile is wide, by elimination with partial pivoting; proposals meet in a tree,
`FAN` at a time, until one set of rows is left (a tournament). These are the step's pivots, wherever they stand: rows aren't moved, only remembered. Then
all tiles are updated in one pass: tiles go to squares of places with the pivots' rows and the column's tiles that they need, and are streamed.
After the last step the tiles hold the inverse, its rows and columns in the order of the pivots, so only the numbering of labels is changed.

A task holds a few tiles. The driver holds a tile of pivots, and the numbers of the rows chosen so far (8 bytes a label, never cells). Every step is a table in
the shared folder, so a lost executor costs no more than its tasks of the last step.

Inverses are kept under a digest of the block's cells and labels: whatever is solved with the same square, transposed or not, in this session or another
one that shares the folder, is a product of tiles. Squares whose pivots vanish are singular; these, and blocks that aren't square, get the
pseudo-inverse, by Newton's iteration on tiles, which needs products only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NotComputable
from . import tiles as T
from .kernels import shared_dir, stored

#: Proposals that meet in one task of the tournament.
FAN = 8
#: Columns that are eliminated one by one before the rest of a tile is updated by a product.
PANEL = 32
#: Squares that were inverted rather than found in the store, since the process began.
made = 0


class Singular(Exception):
    pass


def pivot_order(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows of x in the order in which elimination with partial pivoting takes them, as many as x has columns, and the smallest pivot's size."""
    x, order = x.copy(), np.arange(len(x))
    most, least = min(x.shape), np.inf
    for first in range(0, most, PANEL):
        last = min(first + PANEL, most)
        for c in range(first, last):
            p = c + int(np.argmax(np.abs(x[c:, c])))
            if p != c:
                x[[c, p]], order[[c, p]] = x[[p, c]], order[[p, c]]
            size = abs(x[c, c])
            least = min(least, size)
            if size:
                x[c + 1 :, c] /= x[c, c]
                x[c + 1 :, c + 1 : last] -= np.outer(x[c + 1 :, c], x[c, c + 1 : last])
        if last < x.shape[1]:
            lower = np.tril(x[first:last, first:last], -1) + np.eye(last - first)
            x[first:last, last:] = np.linalg.solve(lower, x[first:last, last:])
            x[last:, last:] -= x[last:, first:last] @ x[first:last, last:]
    return order[:most], least


def _dense(a: DataFrame, rows: DataFrame, columns: DataFrame, n: int, size: int) -> DataFrame:
    """All tiles of a square, absent cells zero; ones on the diagonal beyond its last label."""
    below = -(-n // size)
    spark = a.sparkSession
    at = lambda bi, bj, place, value: (bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), place.cast("int").alias("at"), F.lit(value).alias("value"))
    spots = spark.range(below * below).select(*at(F.floor(F.col("id") / below), F.col("id") % below, F.lit(0), 0.0))
    edge = F.floor(F.col("id") / size)
    beyond = spark.range(n, below * size).select(*at(edge, edge, F.col("id") % size * (size + 1), 1.0))
    return T.filled(T.placed(a, rows, columns, size, size).unionByName(spots).unionByName(beyond), size, size)


def _pivots(state: DataFrame, k: int, used: np.ndarray, size: int, below: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows for the step, and the inverse of their cells in its column of tiles. Pivots up to floor count as zero."""
    taken = state.sparkSession.sparkContext.broadcast(used)
    kind = "g int, rows binary, cells binary"

    def best(rows: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick, _ = pivot_order(cells)
        return rows[pick], cells[pick]

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bi, tile in zip(frame["bi"], frame["tile"], strict=True):
                free = np.flatnonzero(~taken.value[bi * size : bi * size + size])
                if len(free):
                    rows, cells = best(bi * size + free, np.frombuffer(tile).reshape(size, size)[free])
                    yield pd.DataFrame({"g": [bi], "rows": [rows.astype("<i8").tobytes()], "cells": [cells.tobytes()]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(r, "<i8") for r in frame["rows"]])
        order = np.argsort(rows)
        rows, cells = best(rows[order], np.concatenate([np.frombuffer(c).reshape(-1, size) for c in frame["cells"]])[order])
        return pd.DataFrame({"g": frame["g"].iloc[:1], "rows": [rows.astype("<i8").tobytes()], "cells": [cells.tobytes()]})

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, cells in zip(frame["rows"], frame["cells"], strict=True):
                cells = np.frombuffer(cells).reshape(-1, size)
                order, least = pivot_order(cells)
                whole = len(order) == size and least > floor
                back = np.linalg.inv(cells[order]).tobytes() if whole else None
                yield pd.DataFrame({"rows": [np.frombuffer(rows, "<i8")[order].tobytes()], "back": [back]})

    found, width = state.filter(F.col("bj") == k).select("bi", "tile").mapInPandas(propose, kind), below
    while width > 1:
        width = -(-width // FAN)
        found = found.withColumn("g", F.floor(F.col("g") / FAN).cast("int")).groupBy("g").applyInPandas(meet, kind)
    (row,) = found.mapInPandas(settle, "rows binary, back binary").collect()  # one tile
    if row["back"] is None:
        raise Singular
    return np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["back"]).reshape(size, size)


def _step(state: DataFrame, k: int, rows: np.ndarray, back: np.ndarray, size: int, below: int) -> DataFrame:
    """state after column k of tiles has been eliminated by the pivots `rows`, whose cells there have the inverse `back`."""
    spark = state.sparkSession
    where = {int(b): (rows[rows // size == b] % size, np.flatnonzero(rows // size == b)) for b in np.unique(rows // size)}
    shared = spark.sparkContext.broadcast((where, back))
    side = min(8, max(2, -(-below // 8)))
    groups = -(-below // side)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    group = lambda c: F.floor(F.col(c) / side).cast("int")

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, _ = shared.value
        for frame in frames:
            for bi, bj, tile in zip(frame["bi"], frame["bj"], frame["tile"], strict=True):
                yield pd.DataFrame({"bi": [bi], "bj": [bj], "tile": [np.frombuffer(tile).reshape(size, size)[at[bi][0]].tobytes()]})

    def assembled(frame: pd.DataFrame) -> pd.DataFrame:
        at, inverse = shared.value
        p = np.zeros((size, size))
        for bi, piece in zip(frame["bi"], frame["tile"], strict=True):
            p[at[bi][1]] = np.frombuffer(piece).reshape(-1, size)
        return pd.DataFrame({"bi": [k], "bj": frame["bj"].iloc[:1], "tile": [(inverse @ p).tobytes()]})

    def update(found: Iterator[dict]) -> Iterator[tuple[int, int, bytes]]:
        at, inverse = shared.value
        place, across, down = None, {}, {}
        for row in found:
            if (row["gi"], row["gj"]) != place:
                place, across, down = (row["gi"], row["gj"]), {}, {}
            x = np.frombuffer(row["tile"]).reshape(size, size)
            bi, bj = row["bi"], row["bj"]
            if row["kind"] == 0:
                across[bj] = x
            elif row["kind"] == 1:
                down[bi] = x
            else:
                own, slots = at.get(bi, (np.zeros(0, np.int64),) * 2)
                new = -(down[bi] @ inverse) if bj == k else x - down[bi] @ across[bj]
                new[own] = (inverse if bj == k else across[bj])[slots]
                yield bi, bj, new.tobytes()

    pivot_rows = state.filter(F.col("bj") != k).filter(F.col("bi").isin(list(where))).mapInPandas(slices, T.TILES)
    across = pivot_rows.groupBy("bj").applyInPandas(assembled, T.TILES)
    parts = [
        across.select(everywhere.alias("gi"), group("bj").alias("gj"), F.lit(0).alias("kind"), "bi", "bj", "tile"),
        state.filter(F.col("bj") == k).select(group("bi").alias("gi"), everywhere.alias("gj"), F.lit(1).alias("kind"), "bi", "bj", "tile"),
        state.select(group("bi").alias("gi"), group("bj").alias("gj"), F.lit(2).alias("kind"), "bi", "bj", "tile"),
    ]
    return T.dealt(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["kind", "bi", "bj"], update)


@dataclass(frozen=True)
class Factor:
    """An inverse in tiles. `rows` and `columns` number its labels (id, n): rows are labels of the square's columns, columns those of its rows."""

    tiles: DataFrame
    rows: DataFrame
    columns: DataFrame
    size: int
    below: int
    across: int

    def cells(self) -> DataFrame:
        return T.to_cells(self.tiles, self.rows, self.columns, self.size)

    def times(self, b: DataFrame, transposed: bool = False) -> DataFrame:
        """The inverse, or its transpose, times a block (i, j, value)."""
        tiles, rows, columns, below = self.tiles, self.rows, self.columns, self.below
        if transposed:
            tiles, rows, columns, below = T.transpose(tiles, self.size), columns, rows, self.across
        across = stored(T.numbered(b.select(F.col("j").alias("id")).distinct()))
        m = across.count()
        width = max(1, min(self.size, m))
        product = T.matmul(tiles, T.from_cells(b, columns, across, self.size, width), self.size, blocks=(below, -(-m // width)))
        return T.to_cells(product, rows, across, self.size, width)


def digest(a: DataFrame, rows: DataFrame, columns: DataFrame, size: int) -> str:
    """Names a block by its cells and labels."""
    wide = lambda *c: F.coalesce(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.lit(0))
    cells = a.agg(F.count("*"), wide("i", "j", "value"), wide(F.lit(1), "value", "j", "i")).first()
    labels = [v for t in ([rows] if rows is columns else [rows, columns]) for v in t.agg(F.count("*"), wide("id")).first()]
    return "-".join(str(v) for v in (*cells, *labels, size))


def _at(spark, key: str) -> str:
    return f"{shared_dir(spark)}/sectora-factors/{key}"


def _found(spark, key: str, size: int, below: int, across: int) -> Factor | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_at(spark, key)}/tiles/_SUCCESS")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    labels = spark.read.parquet(f"{_at(spark, key)}/labels")
    rows, columns = (labels.filter(F.col("side") == k).select("id", "n") for k in ("row", "column"))
    return Factor(spark.read.parquet(f"{_at(spark, key)}/tiles"), rows, columns, size, below, across)


def factor(a: DataFrame, rows: DataFrame, columns: DataFrame, size: int | None = None, only_stored: bool = False) -> Factor | None:
    """The inverse of the square a, whose labels (id) are rows and columns, from the store or made; None if it had to be made and only_stored is asked for.
    Singular squares and blocks that aren't square get the pseudo-inverse."""
    global made
    spark = a.sparkSession
    n = rows.count()
    m = n if rows is columns else columns.count()
    size = size or max(1, min(T.SIZE, n))
    key = digest(a, rows, columns, size)
    known = _found(spark, key, size, -(-m // size), -(-n // size))
    if known or only_stored:
        return known
    made += 1
    row_numbers = stored(T.numbered(rows))
    column_numbers = row_numbers if rows is columns else stored(T.numbered(columns))
    try:
        if n != m:
            raise Singular
        tiles, pivots = _one_tile(a, row_numbers, column_numbers, n, size) if n <= size else _gauss_jordan(a, row_numbers, column_numbers, n, size)
    except Singular:
        tiles, pivots = _pseudo_inverse(stored(T.from_cells(a, row_numbers, column_numbers, size)), size, -(-n // size), -(-m // size)), None
    if pivots is not None:  # the inverse's row r belongs to the column that r was the pivot of
        turned = lambda numbers, to: numbers.join(spark.createDataFrame(pd.DataFrame({"n": np.arange(len(to)), "m": to})), "n").select("id", F.col("m").alias("n"))
        out_rows, out_columns = turned(column_numbers, pivots), turned(row_numbers, np.argsort(pivots))
    else:
        out_rows, out_columns = column_numbers, row_numbers
    labels = out_rows.withColumn("side", F.lit("row")).unionByName(out_columns.withColumn("side", F.lit("column")))
    for name, table in (("labels", labels), ("tiles", tiles)):  # tiles last: what is found has both
        table.write.mode("overwrite").parquet(f"{_at(spark, key)}/{name}")
    return _found(spark, key, size, -(-m // size), -(-n // size))


def _one_tile(a: DataFrame, rows: DataFrame, columns: DataFrame, n: int, size: int) -> tuple[DataFrame, None]:
    """The inverse of a square that fits a tile."""

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tile in frame["tile"]:
                x = np.frombuffer(tile).reshape(size, size)
                out = np.zeros((size, size))
                try:
                    out[:n, :n] = np.linalg.inv(x[:n, :n])
                except np.linalg.LinAlgError:
                    out[:n, :n] = np.linalg.pinv(x[:n, :n])
                yield pd.DataFrame({"bi": [0], "bj": [0], "tile": [out.tobytes()]})

    return T.from_cells(a, rows, columns, size).mapInPandas(invert, T.TILES), None


def _gauss_jordan(a: DataFrame, rows: DataFrame, columns: DataFrame, n: int, size: int) -> tuple[DataFrame, np.ndarray]:
    below = -(-n // size)
    state = stored(_dense(a, rows, columns, n, size))
    largest = T.largest(state)
    used, pivots = np.zeros(below * size, bool), np.zeros(below * size, np.int64)
    for k in range(below):
        chosen, back = _pivots(state, k, used, size, below, n * np.finfo(float).eps * largest)
        state = _step(state, k, chosen, back, size, below)
        state = state if k == below - 1 else stored(state)  # the last one is written to the store
        used[chosen] = True
        pivots[k * size : k * size + size] = chosen
    return state, pivots


def _pseudo_inverse(tiles: DataFrame, size: int, below: int, across: int, tolerance: float = 1e-11, most: int = 200) -> DataFrame:
    """The Moore-Penrose inverse: x becomes 2 x - x a x, from a multiple of the transpose on. Each round doubles what is known of the smallest singular values."""
    scale = T.norm(tiles) ** 2
    if not scale:
        return T.transpose(tiles, size)
    times = lambda t, by: t.mapInPandas(lambda frames: (f.assign(tile=[(np.frombuffer(x) * by).tobytes() for x in f["tile"]]) for f in frames), T.TILES)
    x = stored(times(T.transpose(tiles, size), 1 / scale))
    for _ in range(most):
        ax = stored(T.matmul(tiles, x, size, blocks=(below, below)))
        change = stored(T.add(x, times(T.matmul(x, ax, size, blocks=(across, below)), -1.0)))
        x = stored(T.add(x, change))
        if T.norm(change) <= tolerance * T.norm(x):
            return x
    raise NotComputable(f"no pseudo-inverse within {most} rounds")
