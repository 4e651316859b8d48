"""The same matrices in SQL, for holding results against another engine: named relations, put together with all that they need.

A block is a relation (i, j, v) whose labels are "region|item"; a vector has the column j = ''.
"""

from __future__ import annotations

from .fixtures import MIDDLE, SEGMENTS

_SEG = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
_MID = "(" + ", ".join(f"'{p}'" for p in MIDDLE) + ")"


def mm(a: str, b: str) -> str:
    return f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY 1, 2"


def columns_over(a: str, x: str) -> str:
    return f"SELECT a.i, a.j, CASE WHEN x.v <> 0 THEN a.v / x.v ELSE 0 END AS v FROM {a} a JOIN {x} x ON x.i = a.j"


def rows_over(a: str, x: str) -> str:
    return f"SELECT a.i, a.j, CASE WHEN x.v <> 0 THEN a.v / x.v ELSE 0 END AS v FROM {a} a JOIN {x} x ON x.i = a.i"


def columns_times(a: str, x: str) -> str:
    return f"SELECT a.i, a.j, a.v * x.v AS v FROM {a} a JOIN {x} x ON x.i = a.j"


def rows_times(a: str, x: str) -> str:
    return f"SELECT a.i, a.j, a.v * x.v AS v FROM {a} a JOIN {x} x ON x.i = a.i"


def plus(*parts: str) -> str:
    return "SELECT i, j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT i, j, v FROM {p}" for p in parts) + ") GROUP BY 1, 2"


def total(*parts: str) -> str:
    return "SELECT i, '' AS j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT i, v FROM {p}" for p in parts) + ") GROUP BY 1"


def column_sums(a: str) -> str:
    return f"SELECT j AS i, '' AS j, sum(v) AS v FROM {a} GROUP BY 1"


class Sql:
    """Relations by name: their text and what they are made from."""

    def __init__(self):
        self.known: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._base()
        self._iot()
        self._sut()

    def put(self, name: str, text: str, *needs: str) -> None:
        self.known[name] = (text, needs)

    def inverse(self, name: str, of: str, labels: str) -> None:
        """(I - of)^-1 by doubling: 2^7 terms of the series."""
        self.put(f"{name}_p0", f"SELECT i, j, v FROM {of}", of)
        self.put(f"{name}_t0", f"SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, 1.0::DOUBLE AS v FROM {labels} UNION ALL SELECT i, j, v FROM {of}) GROUP BY 1, 2", of, labels)
        for k in range(1, 7):
            self.put(f"{name}_p{k}", mm(f"{name}_p{k - 1}", f"{name}_p{k - 1}"), f"{name}_p{k - 1}")
            self.put(f"{name}_q{k}", mm(f"{name}_t{k - 1}", f"{name}_p{k}"), f"{name}_t{k - 1}", f"{name}_p{k}")
            self.put(f"{name}_t{k}", plus(f"{name}_t{k - 1}", f"{name}_q{k}"), f"{name}_t{k - 1}", f"{name}_q{k}")
        self.put(name, f"SELECT i, j, v FROM {name}_t6", f"{name}_t6")

    def _base(self) -> None:
        self.put("cube", f"""SELECT ro.r_name AS ro, l_partkey % 5 AS pk, rd.r_name AS rd, c_mktsegment AS sd, o_orderpriority AS prio, l_linenumber = 1 AS first, l_returnflag = 'R' AS back,
            ro.r_name || '|' || {_SEG}[CAST(l_partkey % 5 AS INTEGER) + 1] AS src, rd.r_name || '|' || c_mktsegment AS dst, rd.r_name || '|' || o_orderpriority AS fin, o_orderpriority IN {_MID} AS mid,
            ro.r_name || '|P' || CAST(l_partkey % 5 AS VARCHAR) AS com, ro.r_name || '|A' || CAST((l_partkey % 5 + CAST(l_linenumber = 1 AS INTEGER)) % 5 AS VARCHAR) AS act,
            rd.r_name || '|A' || CAST(list_position({_SEG}, c_mktsegment) - 1 AS VARCHAR) AS buyer,
            sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS v,
            sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * CAST(l_tax AS DECIMAL(4, 2))) AS tax,
            sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS off, sum(CAST(l_quantity AS DECIMAL(12, 2))) AS qty, count(*) AS n
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation no ON s_nationkey = no.n_nationkey JOIN region ro ON no.n_regionkey = ro.r_regionkey
            JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nd ON c_nationkey = nd.n_nationkey JOIN region rd ON nd.n_regionkey = rd.r_regionkey GROUP BY ALL""")
        cells = lambda i, j, x, where="true": f"SELECT {i} AS i, {j} AS j, CAST(sum({x}) AS DOUBLE) AS v FROM cube WHERE {where} GROUP BY 1, 2"
        for name, text in (
            ("zf", cells("src", "dst", "v", "mid")), ("yf", cells("src", "fin", "v", "NOT mid")),
            ("vf", " UNION ALL ".join(["(" + cells("'Taxes'", "src", "tax") + ")", "(" + cells("'Discounts'", "src", "off") + ")",
                "SELECT 'Surplus', k, CAST(sum(x) AS DOUBLE) FROM (SELECT src AS k, CAST(v AS DECIMAL(24, 6)) AS x FROM cube UNION ALL SELECT src, CAST(-tax AS DECIMAL(24, 6)) - CAST(off AS DECIMAL(24, 6)) FROM cube UNION ALL SELECT dst, CAST(-v AS DECIMAL(24, 6)) FROM cube WHERE mid) GROUP BY 2"])),
            ("ef", "(" + cells("'Quantity'", "src", "qty") + ") UNION ALL (" + cells("'Lines'", "src", "n") + ")"),
            ("sf", cells("act", "com", "v")), ("uf", cells("com", "buyer", "v", "mid")), ("ycf", cells("com", "fin", "v", "NOT mid")),
            ("vaf", "(" + cells("'Taxes'", "act", "tax") + ") UNION ALL (" + cells("'Discounts'", "act", "off") + ")"), ("vcf", cells("'Taxes'", "com", "tax", "first")),
            ("eaf", cells("'Quantity'", "act", "qty")), ("ecf", cells("'Lines'", "com", "n")),
            ("eyf", "(" + cells("'Quantity'", "fin", "qty", "NOT mid AND back") + ") UNION ALL (" + cells("'Lines'", "fin", "n", "NOT mid AND back") + ")"), ("seyf", cells("'Lines'", "fin", "n", "NOT mid AND back")),
        ):
            self.put(name, text, "cube")

    def _iot(self) -> None:
        put = self.put
        put("x", total("zf", "yf"), "zf", "yf")
        put("yt", total("yf"), "yf")
        for name, of in (("zc", "zf"), ("vc", "vf"), ("ec", "ef")):
            put(name, columns_over(of, "x"), of, "x")
        put("bc", rows_over("zf", "x"), "zf", "x")
        self.inverse("w", "zc", "x")
        self.inverse("g", "bc", "x")
        put("m", mm("vc", "w"), "vc", "w")
        put("f", mm("ec", "w"), "ec", "w")
        put("mm", columns_times("m", "yt"), "m", "yt")
        put("ff", columns_times("f", "yt"), "f", "yt")
        put("p", "SELECT j AS i, '' AS j, sum(v) AS v FROM m GROUP BY 1", "m")
        put("shock_z", """SELECT i, j, CASE WHEN j = 'EUROPE|MACHINERY' AND i = 'ASIA|BUILDING' THEN v * 1.5 ELSE v END AS v FROM zc
            WHERE NOT (j = 'EUROPE|MACHINERY' AND i IN ('ASIA|FURNITURE', 'MIDDLE EAST|FURNITURE'))
            UNION ALL VALUES ('ASIA|FURNITURE', 'EUROPE|MACHINERY', 0.02::DOUBLE), ('MIDDLE EAST|FURNITURE', 'EUROPE|MACHINERY', 0.01::DOUBLE)""", "zc")
        put("shock_y", "SELECT i, '' AS j, sum(v) + CASE WHEN i = 'EUROPE|MACHINERY' THEN 1000 ELSE 0 END AS v FROM yf GROUP BY i", "yf")
        self.inverse("shock_w", "shock_z", "x")
        put("shock_x", mm("shock_w", "shock_y"), "shock_w", "shock_y")

        # a new sector: its parent's column, one input from two regions, another changed by a share
        put("ns_z", """SELECT i, j, v FROM zc UNION ALL SELECT i, 'ASIA|SOLAR', CASE WHEN i = 'ASIA|BUILDING' THEN 1.1 * v WHEN i IN ('ASIA|MACHINERY', 'MIDDLE EAST|MACHINERY')
            THEN 0.3 * v / (SELECT sum(v) FROM zc WHERE j = 'ASIA|BUILDING' AND i IN ('ASIA|MACHINERY', 'MIDDLE EAST|MACHINERY')) ELSE v END FROM zc WHERE j = 'ASIA|BUILDING'""", "zc")
        put("ns_y", "SELECT i, j, v FROM yt UNION ALL VALUES ('ASIA|SOLAR', '', 500.0::DOUBLE)", "yt")
        self.inverse("ns_w", "ns_z", "ns_y")
        put("ns_x", mm("ns_w", "ns_y"), "ns_w", "ns_y")
        # sectors split off MACHINERY; EUROPE's asks for more than its parent has, so that its column follows the medians of the others
        put("sp_k", """SELECT r || '|MACHINERY' AS old, r || '|TOOLS' AS new, q FROM (VALUES ('ASIA', 0.2371913::DOUBLE), ('EUROPE', 0.4123719::DOUBLE), ('AFRICA', 0.1039127::DOUBLE)) AS t(r, q)""")
        for name, of, asked in (("z", "zf", """CASE WHEN k.new = 'ASIA|TOOLS' AND b.i = 'ASIA|FURNITURE' THEN 1.5 * k.q WHEN k.new = 'EUROPE|TOOLS' AND b.i = 'EUROPE|BUILDING' THEN 0.9 * k.q * x.v / b.v ELSE k.q END"""), ("v", "vf", "k.q")):
            put(f"sp_a{name}", f"SELECT b.i, k.old, k.new, b.v, {asked} AS share FROM {of} b JOIN sp_k k ON b.j = k.old JOIN x ON x.i = k.old WHERE b.v <> 0", of, "sp_k", "x")
            put(f"sp_u{name}", f"SELECT i, median(share) AS usual FROM sp_a{name} WHERE old NOT IN (SELECT old FROM sp_a{name} WHERE share > 1.000000001) GROUP BY i", f"sp_a{name}")
            put(f"sp_p{name}", f"""SELECT a.i, a.old, a.new, a.v * CASE WHEN a.old IN (SELECT old FROM sp_a{name} WHERE share > 1.000000001) THEN coalesce(u.usual, 0) ELSE a.share END AS v
                FROM sp_a{name} a LEFT JOIN sp_u{name} u ON u.i = a.i""", f"sp_a{name}", f"sp_u{name}")
            put(f"sp_c{name}", f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM {of} UNION ALL SELECT i, old, -v FROM sp_p{name} UNION ALL SELECT i, new, v FROM sp_p{name}) GROUP BY 1, 2", of, f"sp_p{name}")
        parted = "SELECT b.i, b.j, b.v * (1 - coalesce(k.q, 0)) AS v FROM {0} b LEFT JOIN sp_k k ON k.old = b.i UNION ALL SELECT k.new, b.j, b.v * k.q FROM {0} b JOIN sp_k k ON k.old = b.i"
        put("sp_z", parted.format("sp_cz"), "sp_cz", "sp_k")
        put("sp_y", parted.format("yf"), "yf", "sp_k")
        put("sp_x", total("sp_z", "sp_y"), "sp_z", "sp_y")

    def _sut(self) -> None:
        put = self.put
        put("xa", total("sf"), "sf")
        put("xc", total("uf", "ycf"), "uf", "ycf")
        put("u", columns_over("uf", "xa"), "uf", "xa")
        put("s", columns_over("sf", "xc"), "sf", "xc")
        put("sz", "SELECT * FROM uf UNION ALL SELECT * FROM sf", "uf", "sf")
        put("szc", "SELECT * FROM u UNION ALL SELECT * FROM s", "u", "s")
        put("us", mm("u", "s"), "u", "s")
        put("su", mm("s", "u"), "s", "u")
        self.inverse("wcc", "us", "xc")
        self.inverse("waa", "su", "xa")
        put("wca", mm("wcc", "u"), "wcc", "u")
        put("wac", mm("waa", "s"), "waa", "s")
        for name, of, x in (("sva", "vaf", "xa"), ("svc", "vcf", "xc"), ("sea", "eaf", "xa"), ("sec", "ecf", "xc")):
            put(name, columns_over(of, x), of, x)
        put("yct", total("ycf"), "ycf")
        put("syt", mm("s", "yct"), "s", "yct")
        for a, c, ma, mc, fa, fc in (("sva", "svc", "sma", "smc", "smma", "smmc"), ("sea", "sec", "sfa", "sfc", "sffa", "sffc")):
            put(f"{ma}_u", mm(c, "u"), c, "u")
            put(f"{ma}_d", plus(a, f"{ma}_u"), a, f"{ma}_u")
            put(ma, mm(f"{ma}_d", "waa"), f"{ma}_d", "waa")
            put(f"{mc}_s", mm(a, "s"), a, "s")
            put(f"{mc}_d", plus(c, f"{mc}_s"), c, f"{mc}_s")
            put(mc, mm(f"{mc}_d", "wcc"), f"{mc}_d", "wcc")
            put(fa, columns_times(ma, "syt"), ma, "syt")
            put(fc, columns_times(mc, "yct"), mc, "yct")
        put("spa", column_sums("sma"), "sma")
        put("spc", column_sums("smc"), "smc")
        put("sbu", rows_over("uf", "xc"), "uf", "xc")
        put("sbs", rows_over("sf", "xa"), "sf", "xa")
        put("bubs", mm("sbu", "sbs"), "sbu", "sbs")
        put("bsbu", mm("sbs", "sbu"), "sbs", "sbu")
        self.inverse("gcc", "bubs", "xc")
        self.inverse("gaa", "bsbu", "xa")
        put("gca", mm("gcc", "sbu"), "gcc", "sbu")
        put("gac", mm("gaa", "sbs"), "gaa", "sbs")
        # unified blocks, and the commodity shares of activities
        for name, parts in (("sw", ("wcc", "wca", "wac", "waa")), ("sx", ("xa", "xc")), ("svf", ("vaf", "vcf")), ("svu", ("sva", "svc")), ("sef", ("eaf", "ecf")), ("seu", ("sea", "sec")),
                            ("smu", ("sma", "smc")), ("smmu", ("smma", "smmc")), ("sfu", ("sfa", "sfc")), ("sffu", ("sffa", "sffc")), ("spu", ("spa", "spc"))):
            put(name, " UNION ALL ".join(f"SELECT i, j, v FROM {p}" for p in parts), *parts)
        put("sc", "SELECT s.j AS i, s.i AS j, s.v / x.v AS v FROM sf s JOIN xa x ON x.i = s.i", "sf", "xa")
        # a new activity that sells a new commodity and a fifth of an old one; its inputs are its parent's, P2 from two regions
        put("na_u", """SELECT i, j, v FROM u UNION ALL SELECT i, 'ASIA|NEW', CASE WHEN i IN ('ASIA|P2', 'EUROPE|P2')
            THEN 0.25 * v / (SELECT sum(v) FROM u WHERE j = 'ASIA|A1' AND i IN ('ASIA|P2', 'EUROPE|P2')) ELSE v END FROM u WHERE j = 'ASIA|A1'""", "u")
        put("na_s", "SELECT i, j, v FROM s UNION ALL VALUES ('ASIA|NEW', 'ASIA|N1', 1.0::DOUBLE), ('ASIA|NEW', 'ASIA|P3', 0.01::DOUBLE)", "s")
        put("na_y", "SELECT i, j, v FROM yct UNION ALL VALUES ('ASIA|N1', '', 5000.0::DOUBLE)", "yct")
        put("na_us", mm("na_u", "na_s"), "na_u", "na_s")
        self.inverse("na_w", "na_us", "na_y")
        put("na_x", mm("na_w", "na_y"), "na_w", "na_y")
        # supply-use to input-output
        put("t_b", rows_over("sf", "xa"), "sf", "xa")
        put("z_b", mm("uf", "t_b"), "uf", "t_b")
        put("yc_b", "SELECT i, j, v FROM ycf", "ycf")
        put("z_d", mm("s", "uf"), "s", "uf")
        put("y_d", mm("s", "ycf"), "s", "ycf")
        # the inverse of the market shares m (activities by commodities): I - (I - m) with activities and commodities of one number matched; Newton steps
        put("sm", "SELECT replace(i, '|A', '|P') AS i, j, v FROM s", "s")
        put("sm_n", "SELECT j AS i, i AS j, v / (SELECT max(r) * max(c) FROM (SELECT sum(abs(v)) AS r FROM sm GROUP BY i), (SELECT sum(abs(v)) AS c FROM sm GROUP BY j)) AS v FROM sm", "sm")
        last = "sm_n"
        for k in range(24):
            put(f"sm_a{k}", mm("sm", last), "sm", last)
            put(f"sm_b{k}", mm(last, f"sm_a{k}"), last, f"sm_a{k}")
            put(f"sm_i{k}", f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM {last} UNION ALL SELECT i, j, -v FROM sm_b{k}) GROUP BY 1, 2", last, f"sm_b{k}")
            last = f"sm_i{k}"
        # S = s diag(q); inverse(S') = inverse(s)' diag(1/q) from the left, labels of commodities by activities
        put("si", f"SELECT i, replace(j, '|P', '|A') AS j, v FROM {last}", last)  # inverse of s: commodity by activity
        put("t_a", "SELECT j AS i, i AS j, v FROM si", "si")  # inverse(S') diag(q) = inverse(s)': activity by commodity
        put("z_a", mm("uf", "t_a"), "uf", "t_a")
        put("t_c", "SELECT a.j AS i, a.i AS j, a.v * g.v / q.v AS v FROM si a JOIN xa g ON g.i = a.j JOIN xc q ON q.i = a.i", "si", "xa", "xc")
        put("z_c", mm("t_c", "uf"), "t_c", "uf")
        put("y_c", mm("t_c", "ycf"), "t_c", "ycf")
        # trade on the supply side
        own = "split_part(j, '|', 1) || '|' || split_part(i, '|', 2)"
        put("cm_u", f"SELECT {own} AS i, j, sum(v) AS v FROM uf GROUP BY 1, 2", "uf")
        put("cm_used", f"SELECT i, {own} AS j, sum(v) AS v FROM (SELECT * FROM uf UNION ALL SELECT * FROM ycf) GROUP BY 1, 2", "uf", "ycf")
        put("cm_s", "SELECT s.i, k.j, sum(s.v * k.v) AS v FROM s JOIN cm_used k ON k.i = s.j WHERE split_part(s.i, '|', 1) = split_part(s.j, '|', 1) GROUP BY 1, 2", "s", "cm_used")

    def _ordered(self, names: tuple[str, ...]) -> list[str]:
        out: list[str] = []

        def visit(n: str) -> None:
            if n not in out:
                for x in self.known[n][1]:
                    visit(x)
                if n not in out:
                    out.append(n)

        for n in names:
            visit(n)
        return out

    def select(self, text: str, *needs: str) -> str:
        """text with the relations it needs in front; its own WITH, if it has one, joins theirs."""
        defined = [f"{n} AS MATERIALIZED ({self.known[n][0]})" for n in self._ordered(needs)]
        text = text.strip()
        if text.upper().startswith("WITH RECURSIVE "):
            return "WITH RECURSIVE " + ", ".join(defined) + ", " + text[15:]
        if text.upper().startswith("WITH "):
            return "WITH " + ", ".join(defined) + ", " + text[5:]
        return "WITH " + ", ".join(defined) + " " + text

    def block(self, relation: str, digits: int, *needs: str) -> str:
        """The rows of a block, rounded, without zeros."""
        return self.select(f"SELECT i AS row_label, j AS col_label, round(v, {digits}) + 0.0 AS value FROM {relation} WHERE round(v, {digits}) <> 0", *(needs or (relation,)))
