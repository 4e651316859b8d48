"""The cube of sales: exact on odd amounts, small, and its lines move once."""

from decimal import Decimal

from against_sql import SF_DIR

from sectora import fixtures

PLACES = "n_nationkey int, n_regionkey int", [(1, 10), (2, 20)]
REGIONS = "r_regionkey int, r_name string", [(10, "ASIA"), (20, "EUROPE")]
# price, discount, tax, quantity: nulls, values between two hundredths, the largest that fit, credit notes
ODD = [
    (None, 0.05, 0.02, 1.0), (12.5, None, 0.02, 2.0), (1.005, 0.125, 0.015, 0.335), (2.675, 0.1, 0.07, 1.115), (-33.33, 0.07, 0.08, -4.0), (9999999999.99, 0.99, 99.99, 9999999999.99),
    (9999999999.99, -99.99, 99.99, 7.0), (9999999999.99, -99.99, -99.99, 7.0), (0.29, 0.29, 0.57, 0.58), (1e-9, 0.0, 0.0, 0.0), (104949.5, 0.06, 0.04, 50.0), (-0.0, 0.0, 0.0, 0.0),
]


def _tables(spark, path, lines):
    orders, lot = [(k, 7 + k % 2, "1-URGENT") for k in range(3)], [(n % 3, n % 2, n % 5, 1 + n % 2, "R", *line) for n, line in enumerate(lines)]
    for name, schema, rows in (
        ("nation", *PLACES), ("region", *REGIONS), ("supplier", "s_suppkey long, s_nationkey int", [(0, 1), (1, 2)]), ("customer", "c_custkey long, c_nationkey int, c_mktsegment string", [(7, 2, "BUILDING"), (8, 1, "MACHINERY")]),
        ("orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date", [(*o, None) for o in orders]),
        ("lineitem", "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string, l_extendedprice double, l_discount double, l_tax double, l_quantity double", lot),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_exact_on_odd_amounts(spark, tmp_path):
    lines = ODD * 30
    _tables(spark, tmp_path, lines)
    lot = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    lot = lot.selectExpr("l_partkey % 5 as pk", "cast(l_extendedprice as decimal(12,2)) as p", "cast(l_discount as decimal(4,2)) as d", "cast(l_tax as decimal(4,2)) as t", "cast(l_quantity as decimal(12,2)) as q")
    want: dict = {}
    for r in lot.collect():
        one = [None if r.p is None or r.d is None else r.p * (1 - r.d), None if r.p is None or r.d is None else r.p * (1 - r.d) * r.t, None if r.p is None or r.d is None else r.p * r.d, r.q]
        at = want.setdefault(r.pk, [Decimal(0)] * 4)
        want[r.pk] = [a + (x or 0) for a, x in zip(at, one, strict=True)]
    got: dict = {}
    for r in fixtures.cube(spark, str(tmp_path)).collect():
        at = got.setdefault(r.pk, [Decimal(0)] * 4)
        got[r.pk] = [a + (x or 0) for a, x in zip(at, (r.v, r.tax, r.off, r.qty), strict=True)]
    assert got == want and sum(r.n for r in fixtures.cube(spark, str(tmp_path)).collect()) == len(lines)


def test_lines_move_once_and_groups_are_few(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("nation", "region", "supplier", "customer", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF_DIR}/{name}.parquet")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # as small beside these tables as the usual one beside large ones
        cube = fixtures.cube(spark, str(tmp_path))
        plan = cube._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_suppkey" not in plan
    assert "year" not in cube.columns and cube.count() == cube.select("ro", "pk", "rd", "sd", "prio", "first", "back").distinct().count()
