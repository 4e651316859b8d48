"""The formulas one by one, for blocks that don't belong to a model: each takes and gives DataFrames (i, j, value). Labels of squares are those that occur."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indicators import demand_shares
from ..plans import blocks as B
from ..plans import kernels as K


def labels(*blocks: DataFrame) -> DataFrame:
    """The ids that stand in squares."""
    sides = [b.select(F.col(k).alias("id")) for b in blocks for k in ("i", "j")]
    return reduce(DataFrame.union, sides).distinct()


def _row_labels(*blocks: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [b.select(F.col("i").alias("id")) for b in blocks]).distinct()


def _solved(z: DataFrame, right: DataFrame, ids: DataFrame, transposed: bool = False) -> DataFrame:
    """A solution in one task only where the labels fit it."""
    return K.solve(z, right, ids, transposed, ids.count())


def calc_X(Z: DataFrame, Y: DataFrame) -> DataFrame:
    return B.sum_rows(B.concat(Z, Y))


def calc_flow(coefficients: DataFrame, X: DataFrame) -> DataFrame:
    """Z of z, V of v, E of e, and their activity and commodity parts: columns times output."""
    return B.scale_columns(coefficients, X)


def calc_coefficient(flows: DataFrame, X: DataFrame) -> DataFrame:
    """z of Z, v of V, e of E, and their parts: columns over output, 0 where there is none."""
    return B.scale_columns(flows, B.inverse_vector(X))


calc_Z = calc_V = calc_E = calc_Va = calc_Vc = calc_Ea = calc_Ec = calc_flow
calc_z = calc_v = calc_e = calc_va = calc_vc = calc_ea = calc_ec = calc_coefficient


def calc_b(X: DataFrame, Z: DataFrame) -> DataFrame:
    return B.scale_rows(B.inverse_vector(X), Z)


def calc_w(z: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    ids = labels(z) if ids is None else ids
    return K.inverse(z, ids, labels=ids.count())


calc_g = calc_w


def calc_X_from_w(w: DataFrame, Y: DataFrame) -> DataFrame:
    return B.matmul(w, B.sum_rows(Y))


def calc_X_from_z(z: DataFrame, Y: DataFrame) -> DataFrame:
    return _solved(z, B.sum_rows(Y), labels(z).union(_row_labels(Y)).distinct())


def calc_multiplier(coefficients: DataFrame, w: DataFrame) -> DataFrame:
    """m of v, f of e, and their parts."""
    return B.matmul(coefficients, w)


calc_m = calc_f = calc_ma = calc_mc = calc_fa = calc_fc = calc_multiplier


def calc_multiplier_from_z(coefficients: DataFrame, z: DataFrame) -> DataFrame:
    """As calc_multiplier, by solving the transposed system."""
    return B.transpose(_solved(z, B.transpose(coefficients), labels(z), transposed=True))


calc_m_from_z = calc_f_from_z = calc_multiplier_from_z


def calc_footprint(multipliers: DataFrame, Y: DataFrame) -> DataFrame:
    """M of m, F of f, and their parts: columns times the demand for each good."""
    return B.scale_columns(multipliers, B.sum_rows(Y))


calc_M = calc_F = calc_Ma = calc_Mc = calc_Fa = calc_Fc = calc_footprint


def calc_p(v: DataFrame, w: DataFrame) -> DataFrame:
    return B.transpose_matvec(w, B.sum_columns(v))


def calc_p_from_z(v: DataFrame, z: DataFrame) -> DataFrame:
    return _solved(z, B.sum_columns(v), labels(z), transposed=True)


def calc_f_dis(e: DataFrame, w: DataFrame) -> DataFrame:
    return B.scale_rows(B.sum_columns(e), w)


calc_y = demand_shares
X_inverse = B.inverse_vector


def calc_all_shock(z: DataFrame, e: DataFrame, v: DataFrame, Y: DataFrame) -> dict[str, DataFrame]:
    """All flows that follow from coefficients and demand."""
    X = calc_X_from_z(z, Y)
    return {"X": X, "Z": calc_flow(z, X), "E": calc_flow(e, X), "V": calc_flow(v, X)}
