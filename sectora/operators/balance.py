"""RAS: a matrix fitted to given row and column totals by scaling rows and columns in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model
from ..plans import blocks as B
from ..plans import tiles as T
from ..plans.kernels import DENSE_LABELS, OUT, stored
from ..schema import NotComputable, WrongInput


def checked(block: DataFrame, rows: DataFrame, columns: DataFrame, tolerance: float) -> None:
    """Negative cells or totals, totals that don't agree, and totals of empty rows or columns can't be fitted."""
    totals = [t.agg(F.sum("value"), F.min("value")).first() for t in (rows, columns)]
    low = block.agg(F.min("value")).first()[0]
    if (low or 0) < 0 or any((t[1] or 0) < 0 for t in totals):
        raise WrongInput("negative cells or totals")
    a, b = (t[0] or 0.0 for t in totals)
    if abs(a - b) > tolerance * max(1.0, abs(a)):
        raise WrongInput("the totals of rows and columns differ")
    for totals, side in ((rows, "i"), (columns, "j")):
        filled = block.filter("value > 0").select(F.col(side).alias("i")).distinct()
        if not totals.filter("value > 0").join(filled, "i", "left_anti").isEmpty():
            raise WrongInput("a total above zero for an empty row or column")


def ras(block: DataFrame, rows: DataFrame, columns: DataFrame, tolerance: float = 1e-8, most: int = 1000) -> DataFrame:
    """block scaled until its row sums are `rows` and its column sums `columns` (vectors), both within tolerance, absolute and relative.

    Squares of up to DENSE_LABELS labels are fitted by one numpy task, larger ones on tiles; both make the same rounds."""
    checked(block, rows, columns, 1e-6)
    if max(rows.count(), columns.count()) > DENSE_LABELS:
        return on_tiles(block, rows, columns, tolerance, most)

    def kernel(cells: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in cells.groupby("part")}
        empty = cells.iloc[:0]
        a, r, c = (part.get(k, empty) for k in (0, 1, 2))
        i, j = np.unique(np.concatenate([a["i"], r["i"]])), np.unique(np.concatenate([a["j"], c["i"]]))
        x = np.zeros((len(i), len(j)))
        np.add.at(x, (np.searchsorted(i, a["i"]), np.searchsorted(j, a["j"])), a["value"])
        want_r, want_c = np.zeros(len(i)), np.zeros(len(j))
        want_r[np.searchsorted(i, r["i"])], want_c[np.searchsorted(j, c["i"])] = r["value"], c["value"]
        for _ in range(most):
            sums = x.sum(1)
            x *= np.divide(want_r, sums, out=np.zeros_like(sums), where=sums > 0)[:, None]
            sums = x.sum(0)
            x *= np.divide(want_c, sums, out=np.zeros_like(sums), where=sums > 0)
            if np.allclose(x.sum(1), want_r, rtol=tolerance, atol=tolerance) and np.allclose(x.sum(0), want_c, rtol=tolerance, atol=tolerance):
                at = np.nonzero(x)
                return pd.DataFrame({"i": i[at[0]], "j": j[at[1]], "value": x[at]})
        raise ValueError(f"no fit within {most} rounds")

    whole = block.select("i", "j", "value", F.lit(0).alias("part"))
    for k, totals in ((1, rows), (2, columns)):
        whole = whole.unionByName(totals.select("i", F.lit(0).cast("long").alias("j"), "value", F.lit(k).alias("part")))
    return whole.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda cells: kernel(cells), OUT)


#: Rounds of scaling between two tables of the scaling vectors.
ROUNDS = 4


def on_tiles(block: DataFrame, rows: DataFrame, columns: DataFrame, tolerance: float = 1e-8, most: int = 1000, size: int | None = None) -> DataFrame:
    """The same without a square in one task and without touching its cells in a round: only the two scaling vectors are iterated, each a tile for each row
    (column) of tiles; the block is read as tiles, kept where Spark keeps tables, and scaled once at the end. The vectors are a table in the shared
    folder every `ROUNDS` rounds."""
    sides = [a.select(F.col(k).alias("id")).union(t.select(F.col("i").alias("id"))).distinct() for a, k, t in ((block, "i", rows), (block, "j", columns))]
    numbers = [stored(T.numbered(s)) for s in sides]
    size = size or max(1, min(T.SIZE, max(n.count() for n in numbers)))
    tiles = T.from_cells(block, numbers[0], numbers[1], size).persist()
    zero = block.sparkSession.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("value"))
    one = T.numbered(zero.select(F.col("i").alias("id")))
    column = lambda t, n: T.from_cells(t.select("i", F.lit(0).cast("long").alias("j"), "value"), n, one, size, 1)
    want = [stored(column(t, n).select("bi", F.col("tile").alias("want"))) for t, n in ((rows, numbers[0]), (columns, numbers[1]))]
    try:
        vector = lambda n: stored(n.select(F.floor(F.col("n") / size).cast("int").alias("bi")).distinct().select("bi", F.lit(np.ones(size).tobytes()).alias("v")))
        r, c = vector(numbers[0]), vector(numbers[1])
        for done in range(0, most, ROUNDS):
            for _ in range(min(ROUNDS, most - done)):
                r = _scaled(tiles, "bi", "bj", c, want[0], r, size)
                c = _scaled(tiles, "bj", "bi", r, want[1], c, size)
            # after the columns have been fitted, rows tell how far the block is off
            r, c = stored(r.select("bi", "v")), stored(c.select("bi", "v"))
            off = _scaled(tiles, "bi", "bj", c, want[0], r, size, tolerance).agg(F.max("off")).first()[0]
            if not off:
                break
        else:
            raise NotComputable(f"no fit within {most} rounds")
    finally:
        tiles.unpersist()
    cells = lambda t, n: T.to_cells(t.select("bi", F.lit(0).alias("bj"), F.col("v").alias("tile")), n, one, size, 1)
    return B.scale_columns(B.scale_rows(cells(r, numbers[0]), block), cells(c, numbers[1])).filter("value <> 0")


def _scaled(tiles: DataFrame, at: str, across: str, by: DataFrame, want: DataFrame, old: DataFrame, size: int, tolerance: float = 0.0) -> DataFrame:
    """bi, v, off: the scaling of rows (at: "bi") or columns ("bj") of tiles that brings their sums, the other side scaled by `by`, to `want`; 0 where the sum is.
    off: whether a sum under the old scaling is more than tolerance from what is wanted."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, tile, v in zip(frame[at], frame["tile"], frame["v"], strict=True):
                x, y = np.frombuffer(tile).reshape(size, size), np.frombuffer(v)
                yield pd.DataFrame({"bi": [k], "v": [(x @ y if at == "bi" else y @ x).tobytes()]})

    def fit(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in parts["v"]], 0) if len(parts) else np.zeros(size)
        goal = np.zeros(size) if own["want"].iloc[0] is None else np.frombuffer(own["want"].iloc[0])
        new = np.divide(goal, total, out=np.zeros(size), where=total > 0)
        off = not np.allclose(np.frombuffer(own["v"].iloc[0]) * total, goal, rtol=tolerance, atol=tolerance)
        return pd.DataFrame({"bi": own["bi"].iloc[:1], "v": [new.tobytes()], "off": [off]})

    parts = tiles.join(by.select(F.col("bi").alias(across), "v"), across).mapInPandas(sums, "bi int, v binary")
    own = old.select("bi", "v").join(want, "bi", "left")
    return own.groupBy("bi").cogroup(parts.groupBy("bi")).applyInPandas(fit, "bi int, v binary, off boolean")


def ras_model(model: Model, rows: DataFrame, columns: DataFrame, name: str, base: str | None = None) -> Model:
    """A scenario whose intermediate flows are fitted to totals by label (region, item, value of the goods)."""
    if model.kind != "IOT":
        raise NotComputable("intermediate flows of input-output tables are fitted")
    axis = model.axis.filter(F.col("level") == "Sector").select(F.col("id").alias("i"), "region", "item")
    vector = lambda t: axis.join(t, ["region", "item"]).select("i", F.lit(B.ONE).cast("long").alias("j"), "value")
    flows = model.reset(base, "flows")
    z = ras(flows.resolve("Z", base), vector(rows), vector(columns))
    kept = {m: flows.stored_block(m, base) for m in flows.names[base or model.baseline] if m != "Z"}
    return model.with_blocks(name, {**kept, "Z": z})
