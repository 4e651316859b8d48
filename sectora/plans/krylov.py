"""Solutions of squares that no task could hold, for few right-hand sides, without an inverse: restarted GMRES on tiles.

The square is read as a table of tiles; the basis of the search space is a table too, one row for each row of tiles, so that a step is one product of tiles with
a thin column of tiles and a few numbers a column: the driver gets the inner products, never a vector. Every column of the right side has its own search.
Each new direction is made orthogonal to the others twice. Residuals are measured anew at each restart. The square's spectral radius doesn't matter; where a
restart gains too little, the caller is told and can fall back on elimination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NotComputable
from . import tiles as T
from .kernels import stored

#: Steps before a restart, and restarts at most.
STEPS, RESTARTS = 40, 6
#: A residual this small relative to the right side ends the search.
TOLERANCE = 1e-11
#: A row of tiles: right side, solution so far, directions so far, and the newest one while it is being made.
STATE = "bi int, b binary, x binary, basis array<binary>, raw binary"


class Stagnant(NotComputable):
    pass


def _product(square: DataFrame, state: DataFrame, of: str, size: int, then) -> DataFrame:
    """then(row of the state, its part of the square times column `of`), for every row; absent rows of tiles count as zero."""
    vector = state.select(F.col("bi").alias("bj"), F.col(of).alias("v"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for bi, tile, v in zip(frame["bi"], frame["tile"], frame["v"], strict=True):
                part = np.frombuffer(tile).reshape(size, size) @ np.frombuffer(v).reshape(size, -1)
                sums[bi] = sums[bi] + part if bi in sums else part
            if len(sums) > 64:
                yield pd.DataFrame({"bi": list(sums), "part": [x.tobytes() for x in sums.values()]})
                sums = {}
        if sums:
            yield pd.DataFrame({"bi": list(sums), "part": [x.tobytes() for x in sums.values()]})

    parts = square.join(vector, "bj").select("bi", "tile", "v").mapInPandas(multiply, "bi int, part binary")
    summed = state.groupBy("bi").cogroup(parts.groupBy("bi")).applyInPandas(
        lambda own, some: then(own, np.sum([np.frombuffer(x) for x in some["part"]], 0) if len(some) else np.zeros(len(own["b"].iloc[0]) // 8)), STATE + ", dots binary"
    )
    return stored(summed)


def _total(state: DataFrame) -> np.ndarray:
    """The sum of `dots` over all rows."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for d in frame["dots"]:
                total = np.frombuffer(d) if total is None else total + np.frombuffer(d)
        if total is not None:
            yield pd.DataFrame({"dots": [total.tobytes()]})

    return np.sum([np.frombuffer(r["dots"]) for r in state.select("dots").mapInPandas(add, "dots binary").collect()], 0)  # a few numbers a task


def _frame(own: pd.DataFrame, dots: np.ndarray, **new) -> pd.DataFrame:
    row = {k: own[k].iloc[0] for k in ("bi", "b", "x", "basis", "raw")} | new
    return pd.DataFrame({k: [v] for k, v in row.items()} | {"dots": [np.ascontiguousarray(dots).tobytes()]})


def gmres(square: DataFrame, right: DataFrame, size: int, width: int) -> DataFrame:
    """x in square x = right as tiles; right has one column of tiles, size x width. Stagnant where a restart gains less than a digit."""
    square = stored(square)
    load = lambda x: np.frombuffer(x).reshape(size, width)

    def start(own: pd.DataFrame, product: np.ndarray) -> pd.DataFrame:
        """The residual as the first direction."""
        rest = load(own["b"].iloc[0]) - product.reshape(size, width)
        b = load(own["b"].iloc[0])
        return _frame(own, np.stack([(rest**2).sum(0), (b**2).sum(0)]), basis=[], raw=rest.tobytes())

    def further(own: pd.DataFrame, product: np.ndarray) -> pd.DataFrame:
        new = product.reshape(size, width)
        return _frame(own, np.stack([(load(v) * new).sum(0) for v in own["basis"].iloc[0]]), raw=new.tobytes())

    def rows(state: DataFrame, work, keep: bool = True) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in range(len(frame)):
                    yield work(frame.iloc[k : k + 1])

        done = state.mapInPandas(run, STATE + ", dots binary")
        return stored(done) if keep else done

    def cleared(own: pd.DataFrame, h: np.ndarray) -> pd.DataFrame:
        """The new direction without what it has of the others, and what is left of these in it."""
        basis = [load(v) for v in own["basis"].iloc[0]]
        new = load(own["raw"].iloc[0]) - sum(v * c for v, c in zip(basis, h, strict=True))
        return _frame(own, np.stack([*((v * new).sum(0) for v in basis), (new**2).sum(0)]), raw=new.tobytes())

    def joined(own: pd.DataFrame, h: np.ndarray, by: np.ndarray) -> pd.DataFrame:
        basis = list(own["basis"].iloc[0])
        new = (load(own["raw"].iloc[0]) - sum((load(v) * c for v, c in zip(basis, h, strict=True)), np.zeros((size, width)))) * by
        return _frame(own, np.zeros(0), basis=[*basis, new.tobytes()], raw=new.tobytes())

    def moved(own: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        x = load(own["x"].iloc[0]) + sum(load(v) * c for v, c in zip(own["basis"].iloc[0], y, strict=False))
        return _frame(own, np.zeros(0), x=x.tobytes(), basis=[], raw=x.tobytes())

    zero = np.zeros((size, width)).tobytes()
    state = stored(right.select("bi", F.col("tile").alias("b"), F.lit(zero).alias("x"), F.array().cast("array<binary>").alias("basis"), F.lit(zero).alias("raw")))
    before = None
    for _ in range(RESTARTS):
        state = _product(square, state, "x", size, start)
        rest, norm = np.sqrt(_total(state).reshape(2, width))
        norm = np.where(norm > 0, norm, 1.0)
        if (rest <= TOLERANCE * norm * 10).all():
            return state.select("bi", F.lit(0).alias("bj"), F.col("x").alias("tile"))
        if before is not None and (rest / norm).max() > 0.1 * before:
            break
        before = (rest / norm).max()
        inverse = lambda v: np.divide(1.0, v, out=np.zeros(width), where=v > 0)
        state = rows(state, lambda own, by=inverse(rest): joined(own, np.zeros((0, width)), by), keep=False)
        hessenberg = np.zeros((width, STEPS + 1, STEPS))
        y = np.zeros((width, 0))
        for k in range(STEPS):
            state = _product(square, state, "raw", size, further)
            h = _total(state).reshape(k + 1, width)
            state = rows(state, lambda own, h=h: cleared(own, h))
            left = _total(state).reshape(k + 2, width)
            length = np.sqrt(np.maximum(left[-1] - (left[:-1] ** 2).sum(0), 0.0))
            length = np.where(length > 1e-14 * np.sqrt((h**2).sum(0) + left[-1]), length, 0.0)  # nothing new: the search space has the solution
            hessenberg[:, : k + 1, k], hessenberg[:, k + 1, k] = (h + left[:-1]).T, length
            goal = np.zeros((width, k + 2))
            goal[:, 0] = rest
            y = np.stack([np.linalg.lstsq(hessenberg[c, : k + 2, : k + 1], goal[c], rcond=None)[0] for c in range(width)])
            off = np.array([np.linalg.norm(hessenberg[c, : k + 2, : k + 1] @ y[c] - goal[c]) for c in range(width)])
            if (off <= TOLERANCE * norm).all() or not length.any():
                break
            state = rows(state, lambda own, h=left[:-1], by=inverse(length): joined(own, h, by), keep=False)
        state = rows(state, lambda own, y=y.T: moved(own, y))
    raise Stagnant(f"no solution within {RESTARTS} restarts of {STEPS} steps, or too slow")
