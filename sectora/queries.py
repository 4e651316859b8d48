"""The registered queries of the input-output operators, each with the SQL that gives the same rows.

Rows are (row_label, col_label, value) unless a query says otherwise; labels are "region|item". Values are rounded on both sides, zeros left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import MIDDLE, SEGMENTS, cube, iot_cells, iot_model, sut_cells, sut_model
from .functions import concordance as C
from .functions import primitives as P
from .model import Model
from .operators import balance, custom, indicators, scenarios, sectors, splits, structure, trade, views
from .plans import blocks as B
from .plans import kernels
from .sources import flat, ordered, records
from .sql import Sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(c, digits: int):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rows_of(model: Model, block: DataFrame, digits: int) -> DataFrame:
    """row_label, col_label, value of a block's cells that don't round to zero."""
    name = lambda k, n: model.axis.select(F.col("id").alias(k), F.concat_ws("|", "region", "item").alias(n))
    out = block.join(name("i", "row_label"), "i").join(name("j", "col_label"), "j", "left")
    return out.select("row_label", F.coalesce("col_label", F.lit("")).alias("col_label"), rounded(F.col("value"), digits).alias("value")).filter("value <> 0")


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


S = Sql()


def add_matrix(prefix: str, name: str, matrix: str, relation: str, digits: int, make: Callable, method: str = "inverse") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = make(spark, sf_dir)
        return rows_of(model, model.resolve(matrix, method=method), digits)

    add(f"{prefix}_{name}", query, S.block(relation, digits))


# --- matrices: name, matrix, relation of the SQL, digits
for _name, _matrix, _relation, _digits in (
    ("flows_z", "Z", "zf", 4), ("final_demand", "Y", "yf", 4), ("output", "X", "x", 4), ("value_added", "V", "vf", 6), ("satellites", "E", "ef", 2),
    ("coef_z", "z", "zc", 8), ("coef_b", "b", "bc", 8), ("coef_v", "v", "vc", 8), ("coef_e", "e", "ec", 8), ("leontief", "w", "w", 7), ("ghosh", "g", "g", 7),
    ("multipliers_m", "m", "m", 7), ("footprint_m", "M", "mm", 1), ("multipliers_f", "f", "f", 7), ("footprint_f", "F", "ff", 1), ("prices", "p", "p", 7), ("satellites_of_demand", "EY", "eyf", 2),
):
    add_matrix("iot", _name, _matrix, _relation, _digits, iot_model)
for _name, _matrix, _relation, _digits in (
    ("use_shares", "u", "u", 8), ("market_shares", "s", "s", 8), ("output_activities", "Xa", "xa", 4), ("output_commodities", "Xc", "xc", 4), ("unified_flows", "Z", "sz", 4), ("unified_coefficients", "z", "szc", 8),
    ("wcc", "wcc", "wcc", 7), ("waa", "waa", "waa", 7), ("wca", "wca", "wca", 7), ("wac", "wac", "wac", 7), ("va", "va", "sva", 8), ("vc", "vc", "svc", 8), ("ea", "ea", "sea", 8), ("ec", "ec", "sec", 8),
    ("ma", "ma", "sma", 7), ("mc", "mc", "smc", 7), ("fa", "fa", "sfa", 7), ("fc", "fc", "sfc", 7), ("footprint_mc", "Mc", "smmc", 1), ("footprint_ma", "Ma", "smma", 1), ("footprint_fc", "Fc", "sffc", 1),
    ("footprint_fa", "Fa", "sffa", 1), ("prices_a", "pa", "spa", 7), ("prices_c", "pc", "spc", 7), ("bu", "bu", "sbu", 8), ("bs", "bs", "sbs", 8), ("gcc", "gcc", "gcc", 7), ("gaa", "gaa", "gaa", 7),
    ("gca", "gca", "gca", 7), ("gac", "gac", "gac", 7), ("leontief", "w", "sw", 7), ("final_demand", "Y", "ycf", 4), ("output", "X", "sx", 4), ("value_added", "V", "svf", 6), ("coef_v", "v", "svu", 8), ("satellites", "E", "sef", 2),
    ("coef_e", "e", "seu", 8), ("use", "U", "uf", 4), ("supply", "S", "sf", 4), ("satellites_of_demand", "EY", "seyf", 2), ("footprint_m", "M", "smmu", 1), ("multipliers_m", "m", "smu", 7), ("footprint_f", "F", "sffu", 1),
    ("multipliers_f", "f", "sfu", 7), ("prices", "p", "spu", 7), ("value_added_a", "Va", "vaf", 6), ("value_added_c", "Vc", "vcf", 6), ("satellites_a", "Ea", "eaf", 2), ("satellites_c", "Ec", "ecf", 2), ("final_demand_c", "Yc", "ycf", 4),
):
    add_matrix("sut", _name, _matrix, _relation, _digits, sut_model)
add_matrix("sut", "commodity_shares", "c", "sc", 8, lambda spark, sf_dir: sut_model(spark, sf_dir, "product"))
add_matrix("iot", "prices_by_solve", "p", "p", 7, iot_model, "solve")
add_matrix("iot", "multipliers_f_by_solve", "f", "f", 7, iot_model, "solve")
add_matrix("sut", "multipliers_fc_by_solve", "fc", "sfc", 7, sut_model, "solve")


def iot_query(name: str, sql: str | None = None, make: Callable = iot_model):
    def wrap(f: Callable[[Model], DataFrame]) -> Callable:
        add(name, lambda spark, sf_dir: f(make(spark, sf_dir)), sql)
        return f

    return wrap


def sut_query(name: str, sql: str | None = None):
    return iot_query(name, sql, sut_model)


# --- kernels and small primitives
@iot_query("iot_leontief_by_joins", S.block("w", 7))
def _(m: Model) -> DataFrame:
    return rows_of(m, kernels.inverse_on_tiles(m.resolve("z"), m.ids("Sector")), 7)


@iot_query("iot_output_from_coefficients", S.block("x", 4))
def _(m: Model) -> DataFrame:
    return rows_of(m, kernels.solve(m.resolve("z"), B.sum_rows(m.resolve("Y")), m.ids("Sector")), 4)


@iot_query("iot_demand_shares", S.block("(SELECT i, j, v / (SELECT sum(v) FROM yf) AS v FROM yf)", 9, "yf"))
def _(m: Model) -> DataFrame:
    return rows_of(m, indicators.demand_shares(m.resolve("Y")), 9)


@iot_query("iot_direct_footprint", S.block("(SELECT w.i, w.j, e.v * w.v AS v FROM w JOIN ec e ON e.j = w.i AND e.i = 'Quantity')", 8, "w", "ec"))
def _(m: Model) -> DataFrame:
    return rows_of(m, indicators.exploded(m, "Quantity"), 8)


@iot_query("iot_exploded_prices", S.block("(SELECT w.i, w.j, k.v * w.v AS v FROM w JOIN (SELECT j, sum(v) AS v FROM vc GROUP BY j) k ON k.j = w.i)", 8, "w", "vc"))
def _(m: Model) -> DataFrame:
    return rows_of(m, indicators.exploded_prices(m), 8)


def _primitive(name: str, relation: str, digits: int, make: Callable[[Model], DataFrame]) -> None:
    iot_query(f"primitive_{name}", S.block(relation, digits))(lambda m: rows_of(m, make(m), digits))


for _name, _relation, _digits, _make in (
    ("calc_X", "x", 4, lambda m: P.calc_X(m.resolve("Z"), m.resolve("Y"))),
    ("calc_Z", "zf", 4, lambda m: P.calc_Z(m.resolve("z"), m.resolve("X"))),
    ("calc_V", "vf", 4, lambda m: P.calc_V(m.resolve("v"), m.resolve("X"))),
    ("calc_E", "ef", 2, lambda m: P.calc_E(m.resolve("e"), m.resolve("X"))),
    ("calc_z", "zc", 8, lambda m: P.calc_z(m.resolve("Z"), m.resolve("X"))),
    ("calc_v", "vc", 8, lambda m: P.calc_v(m.resolve("V"), m.resolve("X"))),
    ("calc_e", "ec", 8, lambda m: P.calc_e(m.resolve("E"), m.resolve("X"))),
    ("calc_b", "bc", 8, lambda m: P.calc_b(m.resolve("X"), m.resolve("Z"))),
    ("calc_w", "w", 7, lambda m: P.calc_w(m.resolve("z"))),
    ("calc_g", "g", 7, lambda m: P.calc_g(m.resolve("b"))),
    ("calc_X_from_w", "x", 0, lambda m: P.calc_X_from_w(m.resolve("w"), m.resolve("Y"))),
    ("calc_X_from_z", "x", 0, lambda m: P.calc_X_from_z(m.resolve("z"), m.resolve("Y"))),
    ("calc_m", "m", 7, lambda m: P.calc_m(m.resolve("v"), m.resolve("w"))),
    ("calc_f", "f", 7, lambda m: P.calc_f(m.resolve("e"), m.resolve("w"))),
    ("calc_m_from_z", "m", 7, lambda m: P.calc_m_from_z(m.resolve("v"), m.resolve("z"))),
    ("calc_f_from_z", "f", 7, lambda m: P.calc_f_from_z(m.resolve("e"), m.resolve("z"))),
    ("calc_M", "mm", 1, lambda m: P.calc_M(m.resolve("m"), m.resolve("Y"))),
    ("calc_F", "ff", 1, lambda m: P.calc_F(m.resolve("f"), m.resolve("Y"))),
    ("calc_p", "p", 7, lambda m: P.calc_p(m.resolve("v"), m.resolve("w"))),
    ("calc_p_from_z", "p", 7, lambda m: P.calc_p_from_z(m.resolve("v"), m.resolve("z"))),
    ("calc_all_shock", "zf", 0, lambda m: P.calc_all_shock(m.resolve("z"), m.resolve("e"), m.resolve("v"), m.resolve("Y"))["Z"]),
):
    _primitive(_name, _relation, _digits, _make)
add("primitive_X_inverse", lambda spark, d: (lambda m: rows_of(m, P.X_inverse(m.resolve("X")), 14))(iot_model(spark, d)), S.block("(SELECT i, j, 1 / v AS v FROM x)", 14, "x"))


# --- indicators
@iot_query("gdp", S.select("SELECT split_part(j, '|', 1) AS region, round(sum(v), 6) + 0.0 AS gdp FROM vf GROUP BY 1", "vf"))
def _(m: Model) -> DataFrame:
    return indicators.gdp(m).select("region", rounded(F.col("gdp"), 6).alias("gdp"))


@iot_query("gdp_shares", S.select("SELECT region, item, round(gdp, 6) + 0.0 AS gdp, round(100 * gdp / sum(gdp) OVER (PARTITION BY region), 6) + 0.0 AS share FROM (SELECT split_part(j, '|', 1) AS region, split_part(j, '|', 2) AS item, sum(v) AS gdp FROM vf WHERE i <> 'Taxes' GROUP BY 1, 2)", "vf"))
def _(m: Model) -> DataFrame:
    out = indicators.gdp(m, exclude=["Taxes"], total=False, share=True)
    return out.select("region", "item", rounded(F.col("gdp"), 6).alias("gdp"), rounded(F.col("share"), 6).alias("share"))


@iot_query("imbalance_of_coefficients", S.select("SELECT split_part(j, '|', 1) AS region, split_part(j, '|', 2) AS item, round(v - 1, 7) + 0.0 AS imbalance FROM (SELECT j, sum(v) AS v FROM (SELECT j, v FROM zc UNION ALL SELECT j, v FROM vc WHERE i <> 'Surplus') GROUP BY j) WHERE abs(v - 1) > 0.05 AND v <> 0", "zc", "vc"))
def _(m: Model) -> DataFrame:
    return indicators.balance(_without_surplus(m), "coefficients").select("region", "item", rounded(F.col("imbalance"), 7).alias("imbalance"))


def _without_surplus(m: Model) -> Model:
    kept = m.resolve("V").join(m.axis.filter("item = 'Surplus'").select(F.col("id").alias("i")), "i", "left_anti")
    return m.update_scenario(m.baseline, V=kept)


@iot_query("imbalance_of_flows", S.select("WITH a AS (SELECT j, sum(v) AS v FROM (SELECT j, v FROM zf UNION ALL SELECT j, v FROM vf WHERE i <> 'Surplus') GROUP BY j) SELECT split_part(x.i, '|', 1) AS region, split_part(x.i, '|', 2) AS item, round(a.v - x.v, 3) + 0.0 AS imbalance FROM x JOIN a ON a.j = x.i WHERE abs(a.v - x.v) >= 0.05", "zf", "vf", "x"))
def _(m: Model) -> DataFrame:
    return indicators.balance(_without_surplus(m), "flows").select("region", "item", rounded(F.col("imbalance"), 3).alias("imbalance"))


@iot_query("imbalance_of_prices", S.select("WITH p AS (SELECT w.j AS i, sum(k.v * w.v) AS v FROM w JOIN (SELECT j, sum(v) AS v FROM vc WHERE i <> 'Surplus' GROUP BY j) k ON k.j = w.i GROUP BY 1) SELECT split_part(i, '|', 1) AS region, split_part(i, '|', 2) AS item, round(v - 1, 7) + 0.0 AS imbalance FROM p WHERE abs(v - 1) > 0.05 AND v <> 0", "vc", "w"))
def _(m: Model) -> DataFrame:
    return indicators.balance(_without_surplus(m), "prices").select("region", "item", rounded(F.col("imbalance"), 7).alias("imbalance"))


_LINK = """SELECT split_part(k.i, '|', 1) AS region, split_part(k.i, '|', 2) AS item, {columns} FROM x k
    LEFT JOIN (SELECT i AS k, sum(v) AS v FROM g WHERE i <> j GROUP BY i) tf ON tf.k = k.i LEFT JOIN (SELECT j AS k, sum(v) AS v FROM w WHERE i <> j GROUP BY j) tb ON tb.k = k.i
    LEFT JOIN (SELECT i AS k, sum(v) AS v FROM bc WHERE i <> j GROUP BY i) df ON df.k = k.i LEFT JOIN (SELECT j AS k, sum(v) AS v FROM zc WHERE i <> j GROUP BY j) db ON db.k = k.i"""


@iot_query("linkages", S.select(_LINK.format(columns=", ".join([*(f"round({t}.v / avg({t}.v) OVER (), 6) + 0.0 AS {n}" for t, n in (("tf", "total_forward"), ("tb", "total_backward"), ("df", "direct_forward"), ("db", "direct_backward"))), "round(tf.v / df.v, 6) + 0.0 AS amplification_forward", "round(tb.v / db.v, 6) + 0.0 AS amplification_backward"])), "x", "g", "w", "bc", "zc"))
def _(m: Model) -> DataFrame:
    out = indicators.linkages(m)
    return out.select("region", "item", *[rounded(F.col(c), 6).alias(c) for c in out.columns[2:]])


_SIDES = (("total_forward", "g", "i"), ("total_backward", "w", "j"), ("direct_forward", "bc", "i"), ("direct_backward", "zc", "j"))
_SAME = "split_part(i, '|', 1) = split_part(j, '|', 1)"
_SUMS = ", ".join(f"{n} AS (SELECT {k} AS k, sum(CASE WHEN {_SAME} THEN v ELSE 0 END) AS l, sum(CASE WHEN {_SAME} THEN 0 ELSE v END) AS f FROM {r} WHERE i <> j GROUP BY 1)" for n, r, k in _SIDES)
_MULTI = ", ".join(f"round({n}.l, 6) + 0.0 AS {n}_local, round({n}.f, 6) + 0.0 AS {n}_foreign, round({n}.l / ({n}.l + {n}.f), 6) + 0.0 AS {n}_local_share" for n, _, _ in _SIDES)


@iot_query("linkages_multi", S.select(f"WITH {_SUMS} SELECT split_part(x.i, '|', 1) AS region, split_part(x.i, '|', 2) AS item, {_MULTI} FROM x " + " ".join(f"JOIN {n} ON {n}.k = x.i" for n, _, _ in _SIDES), "x", "w", "g", "bc", "zc"))
def _(m: Model) -> DataFrame:
    out = indicators.linkages(m, multi=True)
    return out.select("region", "item", *[rounded(F.col(c), 6).alias(c) for c in out.columns[2:]])


@iot_query("output_mix", S.select("SELECT split_part(i, '|', 1) AS region, split_part(i, '|', 2) AS item, round(v / sum(v) OVER (PARTITION BY split_part(i, '|', 1)), 8) + 0.0 AS share FROM x WHERE split_part(i, '|', 2) IN ('BUILDING', 'MACHINERY')", "x"))
def _(m: Model) -> DataFrame:
    return indicators.mix(m, ["BUILDING", "MACHINERY"]).select("region", "item", rounded(F.col("share"), 8).alias("share"))


@iot_query("ghg_weighted_account", S.select("SELECT j AS col_label, round(sum(CASE WHEN i = 'Quantity' THEN v * 1.0 ELSE v * 29.8 END), 3) + 0.0 AS value FROM ef GROUP BY j", "ef"))
def _(m: Model) -> DataFrame:
    out = indicators.ghg(m, {"Quantity": "CO2", "Lines": "CH4"}, label="GHG", unit="t")
    cells = out.table("E").filter("item_from = 'GHG'")
    return cells.select(F.concat_ws("|", "region_to", "item_to").alias("col_label"), rounded(F.col("value"), 3).alias("value"))


_PATHS = """WITH RECURSIVE d AS (SELECT j AS node, v AS direct FROM ec WHERE i = 'Quantity'),
    p(node, weight, path, depth) AS (SELECT i, v, i || ' -> FD: ' || j, 0 FROM yf UNION ALL SELECT z.i, p.weight * z.v, z.i || ' -> ' || p.path, p.depth + 1 FROM p JOIN zc z ON z.j = p.node WHERE p.depth < 2),
    c AS (SELECT path, depth, weight * direct AS contribution FROM p JOIN d ON d.node = p.node)
    SELECT path, depth, round(contribution, 1) + 0.0 AS contribution, round(contribution / (SELECT sum(v) FROM ff WHERE i = 'Quantity'), 7) + 0.0 AS share FROM c ORDER BY abs(contribution) DESC, depth, path LIMIT 200"""


@iot_query("structural_paths", S.select(_PATHS, "yf", "zc", "ec", "ff"))
def _(m: Model) -> DataFrame:
    return indicators.paths(m, "Quantity", max_depth=2, top=200).select("path", "depth", rounded(F.col("contribution"), 1).alias("contribution"), rounded(F.col("share"), 7).alias("share"))


_SOME = ("(SELECT * FROM yf WHERE split_part(i, '|', 2) IN ('BUILDING', 'MACHINERY') AND split_part(j, '|', 1) = 'ASIA')", "BUILDING", "MACHINERY")
_SOME_PATHS = _PATHS.replace("FROM yf", f"FROM {_SOME[0]}").replace("(SELECT sum(v) FROM ff WHERE i = 'Quantity')", f"(SELECT sum(m.v * s.v) FROM {_SOME[0]} s JOIN f m ON m.j = s.i WHERE m.i = 'Quantity')")


@iot_query("structural_paths_of_demand", S.select(_SOME_PATHS, "yf", "zc", "ec", "f"))
def _(m: Model) -> DataFrame:
    out = indicators.paths(m, "Quantity", max_depth=2, top=200, goods=_SOME[1:], regions=["ASIA"])
    return out.select("path", "depth", rounded(F.col("contribution"), 1).alias("contribution"), rounded(F.col("share"), 7).alias("share"))


# five steps: a path is followed only while its weight times all that lies above its end can reach the 200th best of at most two steps
_DEEP_PATHS = """WITH RECURSIVE d AS (SELECT j AS node, v AS direct FROM ec WHERE i = 'Quantity'), t AS (SELECT j AS node, v AS total FROM f WHERE i = 'Quantity'),
    s(node, weight, depth) AS (SELECT i, v, 0 FROM yf UNION ALL SELECT z.i, s.weight * z.v, s.depth + 1 FROM s JOIN zc z ON z.j = s.node WHERE s.depth < 2),
    least AS (SELECT min(c) AS c FROM (SELECT weight * direct AS c FROM s JOIN d USING (node) ORDER BY c DESC LIMIT 200)),
    p(node, weight, path, depth) AS (SELECT i, v, i || ' -> FD: ' || j, 0 FROM yf UNION ALL
        SELECT z.i, p.weight * z.v, z.i || ' -> ' || p.path, p.depth + 1 FROM p JOIN zc z ON z.j = p.node JOIN t ON t.node = z.i, least WHERE p.depth < 5 AND p.weight * z.v * t.total >= least.c * 0.999),
    c AS (SELECT path, depth, weight * direct AS contribution FROM p JOIN d ON d.node = p.node ORDER BY contribution DESC, depth, path LIMIT 200),
    grand AS (SELECT sum(v) AS whole FROM ff WHERE i = 'Quantity')
    SELECT path, depth, round(contribution, 1) + 0.0 AS contribution, round(contribution / whole, 7) + 0.0 AS share,
           round(sum(contribution / whole) OVER (ORDER BY contribution DESC, depth, path ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative FROM c, grand"""


@iot_query("structural_paths_deep", S.select(_DEEP_PATHS, "yf", "zc", "ec", "f", "ff"))
def _(m: Model) -> DataFrame:
    out = indicators.paths(m, "Quantity", max_depth=5, top=200)
    return out.select("path", "depth", *[rounded(F.col(c), n).alias(c) for c, n in (("contribution", 1), ("share", 7), ("cumulative", 6))])


@iot_query("ghg_by_profile", S.select("SELECT j AS col_label, round(sum(CASE WHEN i = 'Quantity' THEN v * 30.0 ELSE v * 265.0 END), 3) + 0.0 AS value FROM ef GROUP BY j", "ef"))
def _(m: Model) -> DataFrame:
    indicators.register_gas_profile("sales", indicators.GasProfile(("sales", "orders"), {"Quantity": "CH4", "Lines": "N2O"}))
    out = indicators.ghg_of_profile(m.describe(source="Orders of the sales data"), report="AR5", unit="t")
    cells = out.table("E").filter("item_from = 'GHG AR5 GWP-100'")
    return cells.select(F.concat_ws("|", "region_to", "item_to").alias("col_label"), rounded(F.col("value"), 3).alias("value"))


# --- trade
_R = "split_part(i, '|', 1) AS region_from, split_part(j, '|', 1) AS region_to"
_USE = "(SELECT i, j, v FROM zf UNION ALL SELECT i, j, v FROM yf)"


@iot_query("trades", S.select(f"SELECT {_R}, round(sum(v), 4) + 0.0 AS value FROM {_USE} WHERE split_part(i, '|', 2) = 'BUILDING' GROUP BY 1, 2", "zf", "yf"))
def _(m: Model) -> DataFrame:
    return trade.trades(m, "BUILDING").select("region_from", "region_to", rounded(F.col("value"), 4).alias("value"))


@iot_query("trades_with_totals", S.select(f"SELECT coalesce(region_from, 'Total') AS region_from, coalesce(region_to, 'Total') AS region_to, round(sum(v), 4) + 0.0 AS value FROM (SELECT {_R}, v FROM {_USE}) GROUP BY CUBE (region_from, region_to)", "zf", "yf"))
def _(m: Model) -> DataFrame:
    return trade.trades(m, total=True).select("region_from", "region_to", rounded(F.col("value"), 4).alias("value"))


@iot_query("trades_by_clusters", S.select(f"SELECT CASE WHEN region_from IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE region_from END AS region_from, CASE WHEN region_to IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE region_to END AS region_to, round(sum(v), 4) + 0.0 AS value FROM (SELECT {_R}, v FROM {_USE}) GROUP BY 1, 2", "zf", "yf"))
def _(m: Model) -> DataFrame:
    return trade.trades(m, clusters={"EAST": ["ASIA", "MIDDLE EAST"]}).select("region_from", "region_to", rounded(F.col("value"), 4).alias("value"))


_CONTENT = f"(SELECT u.i, u.j, u.v * k.v AS v FROM {_USE} u JOIN f k ON k.j = u.i AND k.i = 'Quantity')"


@iot_query("embodied_content", S.select(f"SELECT {_R}, round(sum(v), 1) + 0.0 AS value FROM {_CONTENT} GROUP BY 1, 2", "zf", "yf", "f"))
def _(m: Model) -> DataFrame:
    return trade.content(m, "satellite", "Quantity").select("region_from", "region_to", rounded(F.col("value"), 1).alias("value"))


@iot_query("embodied_upstream", S.select(f"SELECT {_R}, round(sum(v), 1) + 0.0 AS value FROM (SELECT u.i, u.j, u.v * (k.v - d.v) AS v FROM {_USE} u JOIN f k ON k.j = u.i AND k.i = 'Quantity' JOIN ec d ON d.j = u.i AND d.i = 'Quantity') GROUP BY 1, 2", "zf", "yf", "f", "ec"))
def _(m: Model) -> DataFrame:
    return trade.content(m, "satellite", "Quantity", method="upstream").select("region_from", "region_to", rounded(F.col("value"), 1).alias("value"))


@iot_query("embodied_net_imports", S.select(f"WITH c AS (SELECT {_R}, v FROM {_CONTENT}) SELECT region, round(sum(v), 0) + 0.0 AS net_imports FROM (SELECT region_to AS region, v FROM c WHERE region_from <> region_to UNION ALL SELECT region_from, -v FROM c WHERE region_from <> region_to) GROUP BY region", "zf", "yf", "f"))
def _(m: Model) -> DataFrame:
    return trade.embodied_net_imports(trade.content(m, "satellite", "Quantity")).select("region", rounded(F.col("net_imports"), 0).alias("net_imports"))


_BREAK = f"""b AS (SELECT split_part(w.i, '|', 1) AS contributor, split_part(u.i, '|', 1) AS region_from, split_part(u.j, '|', 1) AS region_to, sum(e.v * w.v * u.v) AS v
    FROM {_USE} u JOIN w ON w.j = u.i JOIN ec e ON e.j = w.i AND e.i = 'Quantity' GROUP BY 1, 2, 3), s AS (SELECT *, abs(v) / sum(abs(v)) OVER (PARTITION BY region_from, region_to) AS share FROM b)"""


@iot_query("embodied_breakdown", S.select(f"WITH {_BREAK} SELECT contributor, region_from, region_to, round(v, 1) + 0.0 AS value FROM b", "zf", "yf", "w", "ec"))
def _(m: Model) -> DataFrame:
    return trade.content_breakdown(m, "satellite", "Quantity").select("contributor", "region_from", "region_to", rounded(F.col("value"), 1).alias("value"))


@iot_query("trade_concentration", S.select(f"WITH {_BREAK} SELECT region_from, region_to, round(sum(share * share), 7) + 0.0 AS hhi FROM s GROUP BY 1, 2", "zf", "yf", "w", "ec"))
def _(m: Model) -> DataFrame:
    return trade.concentration(trade.content_breakdown(m, "satellite", "Quantity")).select("region_from", "region_to", rounded(F.col("hhi"), 7).alias("hhi"))


@iot_query("trade_exposure", S.select(f"WITH {_BREAK} SELECT region_from, region_to, round(sum(CASE WHEN contributor IN ('ASIA', 'EUROPE') THEN share ELSE 0 END), 7) + 0.0 AS exposure FROM s GROUP BY 1, 2", "zf", "yf", "w", "ec"))
def _(m: Model) -> DataFrame:
    return trade.exposure(trade.content_breakdown(m, "satellite", "Quantity"), ["ASIA", "EUROPE"]).select("region_from", "region_to", rounded(F.col("exposure"), 7).alias("exposure"))


# --- structure
_EAST = "CASE WHEN split_part({0}, '|', 1) IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE split_part({0}, '|', 1) END || '|' || CASE WHEN split_part({0}, '|', 2) IN ('BUILDING', 'FURNITURE') THEN 'HOMES' ELSE split_part({0}, '|', 2) END"


_PLACES = "CASE WHEN split_part({0}, '|', 1) IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE split_part({0}, '|', 1) END || '|' || CASE WHEN split_part({0}, '|', 2) = 'P1' THEN 'P2' ELSE split_part({0}, '|', 2) END"


def aggregated(m: Model) -> Model:
    spark = m.spark
    regions = spark.createDataFrame([("ASIA", "EAST"), ("MIDDLE EAST", "EAST")], "source string, target string")
    homes = spark.createDataFrame([("BUILDING", "HOMES"), ("FURNITURE", "HOMES")], "source string, target string")
    return structure.aggregate(m, {"Region": regions, "Sector": homes})


@iot_query("aggregate_flows", S.select(f"SELECT {_EAST.format('i')} AS row_label, {_EAST.format('j')} AS col_label, round(sum(v), 4) + 0.0 AS value FROM zf GROUP BY 1, 2", "zf"))
def _(m: Model) -> DataFrame:
    out = aggregated(m)
    return rows_of(out, out.resolve("Z"), 4)


_IDLE = ("ASIA|AUTOMOBILE", "MIDDLE EAST|AUTOMOBILE", "EUROPE|MACHINERY", "ASIA|BUILDING")
_IDLE_SQL = (
    f"SELECT {_EAST.format('i')} AS row_label, {_EAST.format('j')} AS col_label, round(sum(v) / max(CASE WHEN split_part(j, '|', 2) = 'AUTOMOBILE' THEN 2 ELSE 1 END), 8) + 0.0 AS value "
    f"FROM zc WHERE j IN {_IDLE[:3]} AND i NOT IN {_IDLE} GROUP BY 1, 2"
)


# goods that nobody buys have coefficients but no output; a group of such goods keeps the mean of theirs, one that also has others (EAST|HOMES) doesn't
@iot_query("aggregate_idle_columns", S.select(_IDLE_SQL, "zc"))
def _(m: Model) -> DataFrame:
    name = F.concat_ws("|", "region", "item")
    idle = m.axis.filter((F.col("level") == "Sector") & name.isin(*_IDLE)).select(F.col("id").alias("i"))
    sold = {x: m.resolve(x).join(idle, "i", "left_anti").select("i", "j", "value") for x in ("z", "Y")}
    out = aggregated(m.with_blocks("idle", sold | {x: m.resolve(x) for x in ("v", "e")}))
    columns = out.axis.filter((F.col("level") == "Sector") & name.isin("EAST|AUTOMOBILE", "EUROPE|MACHINERY")).select("id")
    return rows_of(out, B.keep(out.resolve("z", "idle"), None, columns), 8)


@iot_query("aggregate_coefficients", S.select(f"WITH a AS (SELECT {_EAST.format('i')} AS i, {_EAST.format('j')} AS j, sum(v) AS v FROM zf GROUP BY 1, 2), k AS (SELECT {_EAST.format('i')} AS i, sum(v) AS v FROM x GROUP BY 1) SELECT a.i AS row_label, a.j AS col_label, round(a.v / k.v, 8) + 0.0 AS value FROM a JOIN k ON k.i = a.j", "zf", "x"))
def _(m: Model) -> DataFrame:
    out = aggregated(m)
    return rows_of(out, out.resolve("z"), 8)


for _method, _z, _y in (("b", "z_b", "yc_b"), ("d", "z_d", "y_d"), ("a", "z_a", "yc_b"), ("c", "z_c", "y_c")):
    add(f"to_iot_{_method}_flows", lambda spark, d, k=_method: (lambda m: rows_of(m, m.resolve("Z"), 3))(structure.to_iot(sut_model(spark, d), k.upper())), S.block(_z, 3))
    add(f"to_iot_{_method}_demand", lambda spark, d, k=_method: (lambda m: rows_of(m, m.resolve("Y"), 4 if k in "ab" else 3))(structure.to_iot(sut_model(spark, d), k.upper())), S.block(_y, 4 if _method in "ab" else 3))


@sut_query("chenery_moses_supply", S.block("cm_s", 3))
def _(m: Model) -> DataFrame:
    out = structure.to_chenery_moses(m)
    return rows_of(out, out.resolve("S"), 3)


@sut_query("chenery_moses_use", S.block("cm_u", 4))
def _(m: Model) -> DataFrame:
    out = structure.to_chenery_moses(m)
    return rows_of(out, out.resolve("U"), 4)


_POOL = """t AS (SELECT i, j, v FROM uf WHERE split_part(i, '|', 2) = 'P1' UNION ALL SELECT i, j, v FROM ycf WHERE split_part(i, '|', 2) = 'P1')"""


@sut_query("pool_trade_supply", S.select(f"WITH {_POOL} SELECT split_part(i, '|', 1) || '|P1 - supply' AS row_label, split_part(j, '|', 1) || '|P1 - need' AS col_label, round(sum(v), 4) + 0.0 AS value FROM t GROUP BY 1, 2", "uf", "ycf"))
def _(m: Model) -> DataFrame:
    out = structure.pool_trade(m, ["P1"])
    return rows_of(out, out.resolve("S"), 4).filter("row_label like '%- supply'")


@sut_query("pool_trade_output", S.select("SELECT i AS row_label, '' AS col_label, round(v, 4) + 0.0 AS value FROM xc WHERE split_part(i, '|', 2) <> 'P1' UNION ALL SELECT i, '', round(v, 4) + 0.0 FROM xc WHERE split_part(i, '|', 2) = 'P1' UNION ALL SELECT split_part(j, '|', 1) || '|P1 - need', '', round(sum(v), 4) + 0.0 FROM (SELECT i, j, v FROM uf UNION ALL SELECT i, j, v FROM ycf) WHERE split_part(i, '|', 2) = 'P1' GROUP BY 1", "xc", "uf", "ycf"))
def _(m: Model) -> DataFrame:
    out = structure.pool_trade(m, ["P1"])
    return rows_of(out, out.resolve("Xc"), 4)


_IN = "split_part({0}, '|', 1) IN ('ASIA', 'EUROPE')"


@iot_query("region_subset_value_added", S.select(f"SELECT row_label, col_label, round(sum(v), 6) + 0.0 AS value FROM (SELECT i AS row_label, j AS col_label, v FROM vf WHERE {_IN.format('j')} UNION ALL SELECT 'imports ' || split_part(i, '|', 1), j, v FROM zf WHERE {_IN.format('j')} AND NOT {_IN.format('i')}) GROUP BY 1, 2", "vf", "zf"))
def _(m: Model) -> DataFrame:
    out = structure.region_subset(m, ["ASIA", "EUROPE"], "by_region")
    return rows_of(out, out.resolve("V"), 6)


@iot_query("region_subset_demand", S.select(f"SELECT row_label, col_label, round(sum(v), 4) + 0.0 AS value FROM (SELECT i AS row_label, j AS col_label, v FROM yf WHERE {_IN.format('i')} AND {_IN.format('j')} UNION ALL SELECT i, split_part(i, '|', 1) || '|Intermediate exports', v FROM zf WHERE {_IN.format('i')} AND NOT {_IN.format('j')} UNION ALL SELECT i, split_part(i, '|', 1) || '|Final Demand exports', v FROM yf WHERE {_IN.format('i')} AND NOT {_IN.format('j')}) GROUP BY 1, 2", "yf", "zf"))
def _(m: Model) -> DataFrame:
    out = structure.region_subset(m, ["ASIA", "EUROPE"])
    return rows_of(out, out.resolve("Y"), 4)


@iot_query("add_extension", S.select("SELECT 'Tonnage' AS row_label, j AS col_label, round(2 * v, 2) + 0.0 AS value FROM ef WHERE i = 'Quantity'", "ef"))
def _(m: Model) -> DataFrame:
    cells = m.table("E").filter("item_from = 'Quantity'").select(F.lit("Tonnage").alias("item_from"), "region_to", "level_to", "item_to", (2 * F.col("value")).alias("value"))
    out = structure.add_extensions(m, cells, "E", m.spark.createDataFrame([("Tonnage", "t")], "item string, unit string"))
    return rows_of(out, out.resolve("E"), 2).filter("row_label = 'Tonnage'")


# --- scenarios
_SHOCKS = [(1, "z", "ASIA", "BUILDING", "EUROPE", "MACHINERY", "Percentage", 0.5), (2, "z", "East", "FURNITURE", "EUROPE", "MACHINERY", "Update", 0.01), (3, "z", "ASIA", "FURNITURE", "EUROPE", "MACHINERY", "Percentage", 1.0), (4, "Y", "EUROPE", "MACHINERY", "ASIA", "5-LOW", "Absolute", 1000.0)]
_SHOCKED = """zs AS (SELECT i, j, CASE WHEN j = 'EUROPE|MACHINERY' AND i = 'ASIA|BUILDING' THEN v * 1.5 ELSE v END AS v FROM zc WHERE NOT (j = 'EUROPE|MACHINERY' AND i IN ('ASIA|FURNITURE', 'MIDDLE EAST|FURNITURE'))
    UNION ALL VALUES ('ASIA|FURNITURE', 'EUROPE|MACHINERY', 0.02::DOUBLE), ('MIDDLE EAST|FURNITURE', 'EUROPE|MACHINERY', 0.01::DOUBLE)),
    ys AS (SELECT i, sum(v) + CASE WHEN i = 'EUROPE|MACHINERY' THEN 1000 ELSE 0 END AS v FROM yf GROUP BY i)"""


def _shocked(m: Model) -> Model:
    m = m.with_clusters(region={"East": ["ASIA", "MIDDLE EAST"]})
    return scenarios.shock(m, m.spark.createDataFrame(_SHOCKS, scenarios.SHOCKS), "shock")


@iot_query("shock_coefficients", S.select(f"WITH {_SHOCKED} SELECT i AS row_label, j AS col_label, round(v, 8) + 0.0 AS value FROM zs WHERE round(v, 8) <> 0", "zc", "yf"))
def _(m: Model) -> DataFrame:
    out = _shocked(m)
    return rows_of(out, out.resolve("z", "shock"), 8)


@iot_query("shock_output", S.select("SELECT i AS row_label, '' AS col_label, round(v, 1) + 0.0 AS value FROM shock_x", "shock_x"))
def _(m: Model) -> DataFrame:
    out = _shocked(m)
    return rows_of(out, out.resolve("X", "shock"), 1)


@iot_query("scenario_difference", S.select("SELECT a.i AS row_label, '' AS col_label, round((a.v - x.v) / x.v, 7) + 0.0 AS value FROM shock_x a JOIN x ON x.i = a.i WHERE round((a.v - x.v) / x.v, 7) <> 0", "shock_x", "x"))
def _(m: Model) -> DataFrame:
    out = _shocked(m)
    return rows_of(out, out.query(["X"], ["shock"], base=out.baseline, relative=True)["shock"]["X"], 7)


_BUNDLE = "(VALUES ('ASIA', 'BUILDING', 0.7::DOUBLE), ('ASIA', 'FURNITURE', 0.3::DOUBLE), ('EUROPE', 'BUILDING', 0.25::DOUBLE), ('EUROPE', 'MACHINERY', 0.75::DOUBLE)) AS k(r, s, w)"


@iot_query("supply_mix_coefficients", S.select(f"WITH k AS (SELECT r || '|' || s AS i, r, w FROM {_BUNDLE}), t AS (SELECT k.r, z.j, sum(z.v) AS v FROM zc z JOIN k ON k.i = z.i GROUP BY 1, 2) SELECT i AS row_label, j AS col_label, round(v, 8) + 0.0 AS value FROM (SELECT i, j, v FROM zc WHERE i NOT IN (SELECT i FROM k) UNION ALL SELECT k.i, t.j, k.w * t.v FROM t JOIN k ON k.r = t.r) WHERE round(v, 8) <> 0", "zc"))
def _(m: Model) -> DataFrame:
    shares = m.spark.createDataFrame([("ASIA", "BUILDING", 0.7), ("ASIA", "FURNITURE", 0.3), ("EUROPE", "BUILDING", 0.25), ("EUROPE", "MACHINERY", 0.75)], "region string, item string, share double")
    out = scenarios.supply_mix(m, shares, "mix")
    return rows_of(out, out.resolve("z", "mix"), 8)


@iot_query("trade_mix_coefficients", S.select("WITH k(i, w) AS (VALUES ('ASIA|BUILDING', 0.6::DOUBLE), ('AFRICA|BUILDING', 0.4::DOUBLE)), t AS (SELECT j, sum(v) AS v FROM zc JOIN k ON k.i = zc.i WHERE split_part(j, '|', 1) = 'EUROPE' GROUP BY j) SELECT i AS row_label, j AS col_label, round(v, 8) + 0.0 AS value FROM (SELECT i, j, v FROM zc WHERE NOT (i IN (SELECT i FROM k) AND split_part(j, '|', 1) = 'EUROPE') UNION ALL SELECT k.i, t.j, k.w * t.v FROM t, k) WHERE round(v, 8) <> 0", "zc"))
def _(m: Model) -> DataFrame:
    shares = m.spark.createDataFrame([("BUILDING", "EUROPE", "ASIA", 0.6), ("BUILDING", "EUROPE", "AFRICA", 0.4)], "item string, destination string, origin string, share double")
    out = scenarios.trade_mix(m, shares, "trade")
    return rows_of(out, out.resolve("z", "trade"), 8)


@iot_query("ras_margins", S.select("SELECT i AS row_label, '' AS col_label, round(1.1 * sum(v), 0) + 0.0 AS value FROM zf GROUP BY i", "zf"))
def _(m: Model) -> DataFrame:
    z = m.resolve("Z")
    more = lambda x: x.withColumn("value", F.col("value") * 1.1)
    return rows_of(m, B.sum_rows(balance.ras(z, more(B.sum_rows(z)), more(B.sum_columns(z)))), 0)


# flows whose rows and columns are scaled are found again, cell by cell, from their totals
@iot_query("ras_cells", S.select("SELECT i AS row_label, j AS col_label, round(v * (1 + length(i) % 4) * (2 + length(j) % 3), -1) + 0.0 AS value FROM zf", "zf"))
def _(m: Model) -> DataFrame:
    z = m.resolve("Z")
    size = lambda k, n: m.axis.select(F.col("id").alias(k), F.length(F.concat_ws("|", "region", "item")).alias(n))
    scaled = z.join(size("i", "a"), "i").join(size("j", "b"), "j").select("i", "j", (F.col("value") * (1 + F.col("a") % 4) * (2 + F.col("b") % 3)).alias("value"))
    return rows_of(m, balance.ras(z, B.sum_rows(scaled), B.sum_columns(scaled), tolerance=1e-12), -1)


@sut_query("sut_aggregate_use", S.select(f"SELECT {_PLACES.format('i')} AS row_label, {_PLACES.format('j')} AS col_label, round(sum(v), 4) + 0.0 AS value FROM uf GROUP BY 1, 2", "uf"))
def _(m: Model) -> DataFrame:
    regions = m.spark.createDataFrame([("ASIA", "EAST"), ("MIDDLE EAST", "EAST")], "source string, target string")
    goods = m.spark.createDataFrame([("P1", "P2")], "source string, target string")
    out = structure.aggregate(m, {"Region": regions, "Commodity": goods})
    return rows_of(out, out.resolve("U"), 4)


@sut_query("sut_shock_output", S.select("SELECT w.i AS row_label, '' AS col_label, round(sum(w.v * y.v), 1) + 0.0 AS value FROM wcc w JOIN (SELECT i, sum(v) + CASE WHEN i = 'EUROPE|P3' THEN 1000 ELSE 0 END AS v FROM ycf GROUP BY i) y ON y.i = w.j GROUP BY 1", "wcc", "ycf"))
def _(m: Model) -> DataFrame:
    rows = [(1, "Yc", "EUROPE", "P3", "ASIA", "5-LOW", "Absolute", 1000.0)]
    out = scenarios.shock(m, m.spark.createDataFrame(rows, scenarios.SHOCKS), "shock")
    return rows_of(out, out.resolve("Xc", "shock"), 1)


@iot_query("add_sector_output", S.block("ns_x", 2))
def _(m: Model) -> DataFrame:
    m = m.with_clusters(region={"East": ["ASIA", "MIDDLE EAST"]})
    rows = [("SOLAR", "ASIA", "input", "East", "MACHINERY", "Update", 0.3), ("SOLAR", "ASIA", "input", None, "BUILDING", "Percentage", 0.1), ("SOLAR", "ASIA", "factor", None, "Taxes", "Update", 0.2)]
    demand = m.spark.createDataFrame([("SOLAR", "ASIA", "5-LOW", 500.0)], "sector string, region string, category string, value double")
    out = sectors.add_sectors(m, m.spark.createDataFrame(rows, sectors.INVENTORY), "EUR", {"SOLAR": "BUILDING"}, demand)
    return rows_of(out, out.resolve("X"), 2)


@sut_query("add_activity_output", S.block("na_x", 2))
def _(m: Model) -> DataFrame:
    m = m.with_clusters(region={"Both": ["ASIA", "EUROPE"]})
    rows = m.spark.createDataFrame([("NEW", "ASIA", "input", "Both", "P2", "Update", 0.25), ("NEW", "ASIA", "factor", None, "Taxes", "Update", 0.1)], sectors.INVENTORY)
    shares = m.spark.createDataFrame([("NEW", "ASIA", "N1", 1.0), ("NEW", "ASIA", "P3", 0.01)], sectors.SHARES)
    demand = m.spark.createDataFrame([("N1", "ASIA", "5-LOW", 5000.0)], sectors.DEMAND)
    out = sectors.add_sectors(m, rows, "EUR", {"NEW": "A1"}, demand, shares=shares)
    return rows_of(out, out.resolve("Xc"), 2)


def _tools(m: Model) -> Model:
    """TOOLS split off MACHINERY in three regions; EUROPE's inventory asks for more than its parent has."""
    parts = m.spark.createDataFrame([("ASIA", 0.2371913), ("EUROPE", 0.4123719), ("AFRICA", 0.1039127)], "region string, part double")
    x = m.table("X").filter("item_from = 'MACHINERY'").select(F.col("region_from").alias("region"), "value")
    outputs = x.join(parts, "region").select(F.lit("TOOLS").alias("sector"), "region", (F.col("value") * F.col("part")).alias("quantity"))
    rows = [("TOOLS", "ASIA", "input", "ASIA", "FURNITURE", "Percentage", 0.5), ("TOOLS", "EUROPE", "input", "EUROPE", "BUILDING", "Update", 0.9)]
    return splits.split_sectors(m, {"TOOLS": "MACHINERY"}, outputs, m.spark.createDataFrame(rows, sectors.INVENTORY))


for _matrix, _relation, _digits in (("Z", "sp_z", 4), ("V", "sp_cv", 6), ("X", "sp_x", 2)):
    iot_query(f"split_sector_{_matrix.lower()}", S.block(_relation, _digits))(lambda m, x=_matrix, n=_digits: (lambda out: rows_of(out, out.resolve(x), n))(_tools(m)))


# regions by halves of the world, through their codes; EUROPE has no half and keeps its name
_HALF = "CASE split_part({0}, '|', 1) WHEN 'EUROPE' THEN 'EUROPE' WHEN 'ASIA' THEN 'EAST' WHEN 'MIDDLE EAST' THEN 'EAST' ELSE 'WEST' END || '|' || split_part({0}, '|', 2)"


@iot_query("aggregate_by_preset", S.select(f"SELECT {_HALF.format('i')} AS row_label, {_HALF.format('j')} AS col_label, round(sum(v), 4) + 0.0 AS value FROM zf GROUP BY 1, 2", "zf"))
def _(m: Model) -> DataFrame:
    spark = m.spark
    names = spark.createDataFrame([("short", n, n[:2]) for n in ("Africa", "America", "asia", "Europe", "Middle  East")], C.NAMES)
    facts = spark.createDataFrame([("Af", "half", "WEST"), ("Am", "half", "WEST"), ("as", "half", "EAST"), ("Mi", "half", "EAST")], C.FACTS)
    matches = C.match_labels(m.index("Region").withColumnRenamed("item", "label"), names)
    out = structure.aggregate(m, {"Region": C.groups_of(matches, facts, "half")})
    return rows_of(out, out.resolve("Z"), 4)


def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations in four spellings and of regions with all their nations, matched to the nations' keys."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    short = F.concat(F.lit("n"), key)
    spelt = F.when(F.col("n_nationkey") % 4 == 0, name).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" "))).when(F.col("n_nationkey") % 4 == 2, short).otherwise(F.reverse(name))
    labels = nation.select(spelt.alias("label")).union(region.select(F.concat(F.lit("all of "), "r_name")))
    names = nation.select(F.lit("name").alias("classification"), name.alias("name"), key.alias("code")).union(nation.select(F.lit("short"), F.upper(short), key))
    members = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("All of  "), "r_name").alias("alias"), key.alias("code"))
    return C.match_labels(labels, names, members, ["name", "short"]).select("label", "stage", "code")


add("concordance", concordance, """WITH l AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) || ' ' WHEN 2 THEN 'n' || n_nationkey ELSE reverse(n_name) END AS label,
    CASE n_nationkey % 4 WHEN 0 THEN 'exact' WHEN 3 THEN 'unmatched' ELSE 'folded' END AS stage, CASE WHEN n_nationkey % 4 < 3 THEN CAST(n_nationkey AS VARCHAR) END AS code FROM nation)
    SELECT label, stage, code FROM l UNION ALL SELECT 'all of ' || r_name, 'group', CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey""")


# contributors in supply-use tables: activities and commodities (rows) to a unit of what activities or commodities sell
for _side, _parts in (("a", (("sea", "waa"), ("sec", "wca"))), ("c", (("sea", "wac"), ("sec", "wcc")))):
    _text = " UNION ALL ".join(f"SELECT w.i, w.j, e.v * w.v AS v FROM {w} w JOIN {e} e ON e.j = w.i WHERE e.i = '{'Quantity' if e == 'sea' else 'Lines'}'" for e, w in _parts)
    _needs = tuple(n for p in _parts for n in p)
    for _account, _only in (("Quantity", 0), ("Lines", 1)):
        _some = _text.split(" UNION ALL ")[_only]
        sut_query(f"sut_exploded_f{_side}_{_account.lower()}", S.block(f"({_some})", 9, *_needs))(lambda m, a=_account, k=_side: rows_of(m, indicators.exploded(m, a, f"f{k}"), 9))


# --- operators of one's own, views, files
@iot_query("custom_ratio", S.select("SELECT e.i AS row_label, e.j AS col_label, round(e.v / x.v, 8) + 0.0 AS value FROM ef e JOIN x ON x.i = e.j", "ef", "x"))
def _(m: Model) -> DataFrame:
    out = custom.ratio_operator(m, "intensity", "E", "X")
    return rows_of(out, out.resolve("intensity"), 8)


@iot_query("custom_total", S.select("SELECT i AS row_label, 'Total' AS col_label, round(sum(v), 3) + 0.0 AS value FROM ff GROUP BY i", "ff"))
def _(m: Model) -> DataFrame:
    out = custom.sum_operator(m, "all_F", "F")
    return rows_of(out, out.resolve("all_F"), 3)


@iot_query("plot_top_sectors", S.select("WITH a AS (SELECT split_part(i, '|', 2) AS item, split_part(i, '|', 1) AS region, sum(v) AS v FROM x GROUP BY 1, 2), k AS (SELECT item FROM a GROUP BY item ORDER BY sum(abs(v)) DESC, item LIMIT 3) SELECT item AS item_from, region AS region_from, round(v, 4) + 0.0 AS value FROM a WHERE item IN (SELECT item FROM k)", "x"))
def _(m: Model) -> DataFrame:
    out = views.plot_data(m.table("X"), ["item_from", "region_from"], top=3, top_by="item_from")
    return out.select("item_from", "region_from", rounded(F.col("value"), 4).alias("value"))


@iot_query("export_with_units", S.select("SELECT i AS row_label, j AS col_label, round(v, 8) + 0.0 AS value, CASE WHEN i = 'Quantity' THEN 't' ELSE '1' END || '/EUR' AS unit FROM ec WHERE split_part(j, '|', 1) = 'ASIA'", "ec"))
def _(m: Model) -> DataFrame:
    out = flat.export(m, ["e"], filters={"region_to": ["ASIA"]})
    return out.select(F.concat_ws("|", "region_from", "item_from").alias("row_label"), F.concat_ws("|", "region_to", "item_to").alias("col_label"), rounded(F.col("value"), 8).alias("value"), "unit")


@iot_query("flat_round_trip", S.block("zf", 4))
def _(m: Model) -> DataFrame:
    again = Model.from_labelled(flat.from_flat(flat.to_flat(m.labelled_cells())), "IOT", m.units, check=False, names=m.names)
    return rows_of(again, again.resolve("Z"), 4)


def _through_files(m: Model, format: str) -> Model:
    """The table written as a flat file and read again."""
    path = f"{kernels.shared_dir(m.spark)}/sectora-files/{uuid.uuid4().hex}"
    flat.write_flat(m, path, format)
    return flat.read_flat(m.spark, path, m.kind, format, units=m.units)


for _kind, _format, _matrix, _relation, _digits, _make in (("iot", "parquet", "Z", "zf", 4, iot_model), ("iot", "csv", "f", "f", 7, iot_model), ("sut", "parquet", "U", "uf", 4, sut_model), ("sut", "csv", "fc", "sfc", 7, sut_model)):
    add(f"{_kind}_{_matrix.lower()}_of_{_format}_file", lambda spark, d, f=_format, x=_matrix, n=_digits, make=_make: (lambda m: rows_of(m, m.resolve(x), n))(_through_files(make(spark, d), f)), S.block(_relation, _digits))


def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of parts in the order in which a text file of all order lines names them, told from the file alone."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 997).cast("string").alias("value"))
    path = f"{kernels.shared_dir(spark)}/sectora-files/{uuid.uuid4().hex}"
    sold.orderBy("l_orderkey", "l_linenumber", "value").select("value").write.text(path)
    return ordered.first_seen(ordered.lines(spark, path, 1 << 20), "value").select(F.col("value").alias("label"), "position")


add("first_seen_order", first_seen_order, """WITH l AS (SELECT CAST(l_partkey % 997 AS VARCHAR) AS label, row_number() OVER (ORDER BY l_orderkey, l_linenumber, CAST(l_partkey % 997 AS VARCHAR)) AS place FROM lineitem)
    SELECT label, row_number() OVER (ORDER BY min(place)) - 1 AS position FROM l GROUP BY label""")


def _with_demand(kind: str, level: str, rows: str, of: tuple, label: Callable, digits: int) -> None:
    """A table with a block of its own between `rows` and final demand, given as cells beside the fixture's."""
    name, matrix, given, value, condition = of

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sales = cube(spark, sf_dir).filter(~F.col("prio").isin(*MIDDLE)).filter(condition)
        keys = [*label(), F.lit(level), F.col("rd"), F.lit("Consumption category"), F.col("prio")]
        names = ("region_from", "item_from", "level_from", "region_to", "level_to", "item_to")
        more = sales.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("x")).groupBy(*names).agg(F.sum("x").cast("double").alias("value"))
        base = {"IOT": iot_cells, "SUT": sut_cells}[kind](cube(spark, sf_dir))
        m = Model.from_labelled(base.unionByName(more.withColumns({"scenario": F.lit("baseline"), "matrix": F.lit(given)})), kind)
        return rows_of(m, m.resolve(matrix), digits)

    add(name, query, S.block(f"(SELECT {rows} AS i, fin AS j, CAST(sum({value}) AS DOUBLE) AS v FROM cube WHERE NOT mid AND {condition} GROUP BY 1, 2)", digits, "cube"))


_with_demand("IOT", "Factor of production", "'Taxes'", ("iot_value_added_of_demand", "VY", "VY", "tax", "back"), lambda: [F.lit(None).cast("string"), F.lit("Taxes")], 6)
_with_demand("SUT", "Activity", "act", ("sut_demand_of_activities", "Ya", "Y", "v", "back"), lambda: [F.col("ro"), F.concat(F.lit("A"), ((F.col("pk") + F.col("first").cast("int")) % 5).cast("string"))], 4)


@iot_query("search_labels", S.select("SELECT DISTINCT split_part(i, '|', 2) AS item FROM x WHERE regexp_matches(split_part(i, '|', 2), '(?i)^[a-b]')", "x"))
def _(m: Model) -> DataFrame:
    return m.search("^[a-b]", "sectors").select("item")


def record_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    cells = records.scatter(lines, {"matrix": F.lit("Z"), "item_from": "flag", "item_to": "status"}, F.col("q"))
    return cells.select("item_from", "item_to", rounded(F.col("value"), 2).alias("value"))


add("record_scatter", record_scatter, "SELECT l_returnflag AS item_from, l_linestatus AS item_to, round(sum(l_quantity), 2) + 0.0 AS value FROM lineitem GROUP BY 1, 2")


def nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    known = orders.groupBy(F.col("o_orderpriority").alias("region"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).filter("year % 3 = 0")
    wanted = orders.select(F.col("o_orderpriority").alias("region"), F.year("o_orderdate").alias("year")).distinct()
    return views.nearest_year(wanted, known).select("region", F.col("year").cast("long").alias("year"), F.col("year_found").cast("long").alias("year_found"), "n")


add("nearest_year", nearest_year, """WITH k AS (SELECT o_orderpriority AS region, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2 HAVING year(o_orderdate) % 3 = 0),
    w AS (SELECT DISTINCT o_orderpriority AS region, year(o_orderdate) AS y FROM orders),
    p AS (SELECT w.region, w.y AS year, k.y AS year_found, k.n, row_number() OVER (PARTITION BY w.region, w.y ORDER BY abs(k.y - w.y), k.y) AS rn FROM w JOIN k ON k.region = w.region)
    SELECT region, CAST(year AS BIGINT) AS year, CAST(year_found AS BIGINT) AS year_found, n FROM p WHERE rn = 1""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embodied quantities by account and destination: from sales lines to footprints, through reads, joins, sums, scaling and the inverse."""
    m = iot_model(spark, sf_dir)
    return rows_of(m, m.resolve("F"), 1)


__all__ = ["MIDDLE", "ORACLE_SQL", "QUERIES", "SEGMENTS", "flagship"]
