"""Which matrices there are and the ways to make each from others: a table of strategies, in order of preference.

A strategy names what it needs and builds one lazy block from those blocks, so the planner only chooses; Catalyst sees the whole plan. `method` marks the
strategies between which the solve-or-inverse choice decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..schema import NotComputable
from . import blocks as B
from . import kernels as K


class Context(Protocol):
    """What strategies may ask of the planner."""

    tech: str

    def ids(self, level: str) -> DataFrame: ...

    def size(self, level: str) -> int: ...


Make = Callable[..., DataFrame]


@dataclass(frozen=True)
class Strategy:
    kind: str
    text: str
    needs: tuple[str, ...]
    make: Make
    method: str = ""


def formula(text: str, needs: str, make: Make, method: str = "") -> Strategy:
    return Strategy("formula", text, tuple(needs.split()), make, method)


def total(y: DataFrame) -> DataFrame:
    return B.sum_rows(y)


def flow(coefficient: str, output: str) -> Strategy:
    return formula(f"{coefficient} @ diag({output})", f"{coefficient} {output}", lambda c, a, x: B.scale_columns(a, x))


def share(of: str, output: str) -> Strategy:
    return formula(f"{of} @ diag(1/{output})", f"{of} {output}", lambda c, a, x: B.scale_columns(a, B.inverse_vector(x)))


def row_share(output: str, of: str) -> Strategy:
    return formula(f"diag(1/{output}) @ {of}", f"{output} {of}", lambda c, x, a: B.scale_rows(B.inverse_vector(x), a))


def inverse_of(text: str, needs: str, level: str, square: Make, after: Make | None = None) -> Strategy:
    """(I - square)^-1, then `after` it."""
    return formula(text, needs, lambda c, *b: (after or (lambda w, *_: w))(K.inverse(square(*b), c.ids(level), labels=c.size(level)), *b), "inverse")


def solved(text: str, needs: str, level: str, square: Make, right: Make, transposed: bool = False, flip: bool = False) -> Strategy:
    """x of (I - square) x = right, or of the transposed system; flip turns the solution over."""

    def make(c: Context, *b: DataFrame) -> DataFrame:
        x = K.solve(square(*b), right(c, *b), c.ids(level), transposed, c.size(level))
        return B.transpose(x) if flip else x

    return formula(text, needs, make, "solve")


def iot() -> dict[str, tuple[Strategy, ...]]:
    z_of, s = lambda z, *_: z, "Sector"
    through = lambda a: formula(f"{a} @ w", f"{a} w", lambda c, x, w: B.matmul(x, w), "inverse")
    through_z = lambda a: solved(f"solve((I - z)', {a}')'", f"z {a}", s, z_of, lambda c, z, x: B.transpose(x), True, True)
    footprint = lambda m: formula(f"{m} @ diag(Y.sum)", f"{m} Y", lambda c, x, y: B.scale_columns(x, total(y)))
    return {
        "Z": (flow("z", "X"),),
        "z": (share("Z", "X"),),
        "w": (solved("solve(I - z, I)", "z", s, z_of, lambda c, z: B.identity(c.ids(s))), inverse_of("inverse(I - z)", "z", s, z_of)),
        "Y": (),
        "X": (
            formula("Z.sum + Y.sum", "Z Y", lambda c, z, y: total(B.concat(z, y))),
            solved("solve(I - z, Y.sum)", "z Y", s, z_of, lambda c, z, y: total(y)),
            formula("w @ Y.sum", "w Y", lambda c, w, y: B.matmul(w, total(y)), "inverse"),
        ),
        "V": (flow("v", "X"),), "v": (share("V", "X"),), "E": (flow("e", "X"),), "e": (share("E", "X"),),
        "EY": (), "VY": (formula("0", "V Y", lambda c, v, y: B.empty(v)),),
        "m": (through_z("v"), through("v")), "M": (footprint("m"),), "f": (through_z("e"), through("e")), "F": (footprint("f"),),
        "b": (row_share("X", "Z"),), "g": (inverse_of("inverse(I - b)", "b", s, lambda b: b),),
        "p": (
            solved("solve((I - z)', v.sum')", "z v", s, z_of, lambda c, z, v: B.sum_columns(v), True),
            formula("(v.sum @ w)'", "v w", lambda c, v, w: B.transpose_matvec(w, B.sum_columns(v)), "inverse"),
        ),
    }


def sut() -> dict[str, tuple[Strategy, ...]]:
    act, com = "Activity", "Commodity"
    level = {"a": act, "c": com}

    def extract(of: str, rows: str | None, columns: str | None) -> Strategy:
        return Strategy("extract", f"part of {of}", (of,), lambda c, x: B.keep(x, rows and c.ids(rows), columns and c.ids(columns)))

    def joined(*needs: str) -> Strategy:
        return Strategy("concat", " + ".join(needs), needs, lambda c, *b: B.concat(*b))

    def product_based(make: Make) -> Make:
        def guarded(c: Context, *b: DataFrame) -> DataFrame:
            if c.tech != "product":
                raise NotComputable("only under the product technology assumption")
            return make(c, *b)

        return guarded

    def supply(c: Context, s: DataFrame, xc: DataFrame, *xa: DataFrame) -> DataFrame:
        if c.tech == "product":
            return B.transpose(B.scale_columns(K.rectangular_inverse(s, c.ids(act), c.ids(com)), xa[0]))
        return B.scale_columns(s, xc)

    def market(c: Context, s: DataFrame, xc: DataFrame, *xa: DataFrame) -> DataFrame:
        if c.tech == "product":
            return K.rectangular_inverse(B.scale_columns(B.transpose(s), B.inverse_vector(xa[0])), c.ids(com), c.ids(act))
        return B.scale_columns(s, B.inverse_vector(xc))

    us, su = (lambda u, s, *_: B.matmul(u, s)), (lambda u, s, *_: B.matmul(s, u))
    bubs, bsbu = (lambda u, s, *_: B.matmul(u, s)), (lambda u, s, *_: B.matmul(s, u))
    direct_a = lambda u, va, vc: B.add(va, B.matmul(vc, u))  # noqa: E731  what an activity causes itself and by the commodities it uses
    direct_c = lambda s, va, vc: B.add(B.matmul(va, s), vc)
    out: dict[str, tuple[Strategy, ...]] = {
        "Z": (joined("U", "S"),), "z": (joined("u", "s"),), "w": (joined("wcc", "wca", "wac", "waa"),), "Y": (joined("Ya", "Yc"), joined("Yc")), "X": (joined("Xa", "Xc"),), "p": (joined("pa", "pc"),),
        "b": (joined("bu", "bs"),), "g": (joined("gcc", "gca", "gac", "gaa"),),
        "wcc": (extract("w", com, com), solved("solve(I - u s, I)", "u s", com, us, lambda c, u, s: B.identity(c.ids(com))), inverse_of("inverse(I - u s)", "u s", com, us)),
        "wca": (extract("w", com, act), solved("solve(I - u s, u)", "u s", com, us, lambda c, u, s: u), formula("wcc @ u", "wcc u", lambda c, w, u: B.matmul(w, u), "inverse")),
        "wac": (extract("w", act, com), solved("solve(I - s u, s)", "u s", act, su, lambda c, u, s: s), formula("waa @ s", "waa s", lambda c, w, s: B.matmul(w, s), "inverse")),
        "waa": (extract("w", act, act), solved("solve(I - s u, I)", "u s", act, su, lambda c, u, s: B.identity(c.ids(act))), inverse_of("inverse(I - s u)", "u s", act, su)),
        "Xa": (
            extract("X", act, None), formula("S.sum + Ya.sum", "S Ya", lambda c, s, y: total(B.concat(s, y))), formula("S.sum", "S", lambda c, s: total(s)), formula("s @ Xc", "s Xc", lambda c, s, x: B.matmul(s, x)),
        ),
        "Xc": (
            extract("X", com, None), formula("U.sum + Yc.sum", "U Yc", lambda c, u, y: total(B.concat(u, y))),
            solved("solve(I - u s, Yc.sum)", "u s Yc", com, us, lambda c, u, s, y: total(y)), formula("wcc @ Yc.sum", "wcc Yc", lambda c, w, y: B.matmul(w, total(y)), "inverse"),
        ),
        "U": (extract("Z", com, act), flow("u", "Xa")), "u": (extract("z", com, act), share("U", "Xa")),
        "c": (
            formula("S' @ diag(1/Xa)", "S Xa", product_based(lambda c, s, x: B.scale_columns(B.transpose(s), B.inverse_vector(x)))),
            formula("inverse(s)", "s", product_based(lambda c, s: K.rectangular_inverse(s, c.ids(act), c.ids(com))), "inverse"),
        ),
        "S": (
            extract("Z", act, com), formula("s @ diag(Xc), or (inverse(s) @ diag(Xa))'", "s Xc Xa", supply),
            formula("(c @ diag(Xa))'", "c Xa", product_based(lambda c, m, x: B.transpose(B.scale_columns(m, x)))),
        ),
        "s": (extract("z", act, com), formula("S @ diag(1/Xc), or inverse(S' @ diag(1/Xa))", "S Xc Xa", market)),
        "EY": (), "VY": (formula("0", "V Yc", lambda c, v, y: B.empty(v)),), "Ya": (extract("Y", act, None),), "Yc": (extract("Y", com, None),),
        "bu": (extract("b", com, act), row_share("Xc", "U")), "bs": (extract("b", act, com), row_share("Xa", "S")),
        "gcc": (extract("g", com, com), inverse_of("inverse(I - bu bs)", "bu bs", com, bubs)), "gca": (extract("g", com, act), formula("gcc @ bu", "gcc bu", lambda c, g, b: B.matmul(g, b), "inverse")),
        "gaa": (extract("g", act, act), inverse_of("inverse(I - bs bu)", "bu bs", act, bsbu)), "gac": (extract("g", act, com), formula("gaa @ bs", "gaa bs", lambda c, g, b: B.matmul(g, b), "inverse")),
        "pc": (
            extract("p", com, None),
            solved("solve((I - u s)', s' va.sum' + vc.sum')", "u s va vc", com, us, lambda c, u, s, va, vc: B.add(B.transpose_matvec(s, B.sum_columns(va)), B.sum_columns(vc)), True),
            formula("wac' va.sum' + wcc' vc.sum'", "wac wcc va vc", lambda c, wac, wcc, va, vc: B.add(B.transpose_matvec(wac, B.sum_columns(va)), B.transpose_matvec(wcc, B.sum_columns(vc))), "inverse"),
        ),
        "pa": (
            extract("p", act, None),
            solved("solve((I - s u)', va.sum' + u' vc.sum')", "u s va vc", act, su, lambda c, u, s, va, vc: B.add(B.sum_columns(va), B.transpose_matvec(u, B.sum_columns(vc))), True),
            formula("waa' va.sum' + wca' vc.sum'", "waa wca va vc", lambda c, waa, wca, va, vc: B.add(B.transpose_matvec(waa, B.sum_columns(va)), B.transpose_matvec(wca, B.sum_columns(vc))), "inverse"),
        ),
    }
    for big, small, multiplier, foot in (("V", "v", "m", "M"), ("E", "e", "f", "F")):
        for name in (big, small, multiplier, foot):
            out[name] = (joined(f"{name}a", f"{name}c"),)
        for side in "ac":
            out[f"{big}{side}"] = (extract(big, None, level[side]), flow(f"{small}{side}", f"X{side}"))
            out[f"{small}{side}"] = (extract(small, None, level[side]), share(f"{big}{side}", f"X{side}"))
        va, vc, ma, mc = f"{small}a", f"{small}c", f"{multiplier}a", f"{multiplier}c"
        out[ma] = (
            extract(multiplier, None, act),
            solved(f"solve((I - s u)', ({va} + {vc} u)')'", f"u s {va} {vc}", act, su, lambda c, u, s, a, b: B.transpose(direct_a(u, a, b)), True, True),
            formula(f"({va} + {vc} u) @ waa", f"u waa {va} {vc}", lambda c, u, w, a, b: B.matmul(direct_a(u, a, b), w), "inverse"),
        )
        out[mc] = (
            extract(multiplier, None, com),
            solved(f"solve((I - u s)', ({va} s + {vc})')'", f"u s {va} {vc}", com, us, lambda c, u, s, a, b: B.transpose(direct_c(s, a, b)), True, True),
            formula(f"({va} s + {vc}) @ wcc", f"s wcc {va} {vc}", lambda c, s, w, a, b: B.matmul(direct_c(s, a, b), w), "inverse"),
        )
        out[f"{foot}c"] = (extract(foot, None, com), formula(f"{mc} @ diag(Yc.sum)", f"{mc} Yc", lambda c, m, y: B.scale_columns(m, total(y))))
        out[f"{foot}a"] = (extract(foot, None, act), formula(f"{ma} @ diag(s @ Yc.sum)", f"{ma} s Yc", lambda c, m, s, y: B.scale_columns(m, B.matmul(s, total(y)))))
    return out


CATALOG = {"IOT": iot(), "SUT": sut()}
