"""Labels matched in stages, against a slow walk through the stages."""

import random

import pytest
from small import REGIONS, array, iot, iot_arrays

from sectora.functions import concordance as C
from sectora.operators import structure
from sectora.schema import WrongInput


def slow(labels, names, groups, order):
    fold = lambda s: " ".join(s.split()).lower()
    out = set()
    for label in {x for x in labels if x is not None}:
        members = {c for a, c in groups if fold(a) == fold(label)}
        if members:
            out |= {(label, "group", None, c) for c in members}
            continue
        for k in order:
            exact = {c for q, n, c in names if q == k and n == label}
            near = {c for q, n, c in names if q == k and fold(n) == fold(label)}
            stage, codes = ("exact", exact) if exact else ("folded", near)
            if codes:
                out.add((label, stage, k, *codes) if len(codes) == 1 else (label, "ambiguous", k, None))
                break
        else:
            out.add((label, "unmatched", None, None))
    return out


def test_stages_like_a_slow_walk(spark):
    r = random.Random(3)
    words = ["a", "A", " a", "b  c", "B C", "b c ", "d", "D", "e", "x", "", "All"]
    for _ in range(4):
        names = [(r.choice("pqr"), r.choice(words), r.choice("1234")) for _ in range(14)]
        groups = [(r.choice(["all", "x", "Z"]), r.choice("1234")) for _ in range(3)]
        labels = [*words, "nowhere", None, "a"]
        for order in (["q", "p"], ["p", "q", "r"]):
            got = C.match_labels(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(names, C.NAMES), spark.createDataFrame(groups, C.GROUPS), order)
            assert {tuple(x) for x in got.collect()} == slow(labels, names, groups, order)
            assert got.count() == len(slow(labels, names, groups, order))
        free = C.match_labels(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(names, C.NAMES))
        assert {tuple(x) for x in free.collect()} == slow(labels, names, [], sorted({q for q, _, _ in names}))


def test_empty_tables(spark):
    none = C.match_labels(spark.createDataFrame([], "label string"), spark.createDataFrame([], C.NAMES))
    assert none.count() == 0 and C.coverage(none).count() == 0
    alone = C.match_labels(spark.createDataFrame([("a",)], "label string"), spark.createDataFrame([], C.NAMES), spark.createDataFrame([], C.GROUPS))
    assert [tuple(x) for x in alone.collect()] == [("a", "unmatched", None, None)]


def test_presets_and_clusters(spark):
    model = iot(spark)
    names = spark.createDataFrame([("iso", "R1", "one"), ("iso", "R2", "two")], C.NAMES)
    facts = spark.createDataFrame([("one", "continent", "East"), ("two", "continent", "East"), ("one", "club", "club"), ("three", "club", "club")], C.FACTS)
    matches = C.match_labels(model.index("Region").withColumnRenamed("item", "label"), names)
    assert [tuple(x) for x in C.coverage(matches).collect()] == [("folded", 2, 2)]
    assert C.clusters_of(matches, facts) == {"all": REGIONS, "continent:East": REGIONS, "club": ("r1",)}
    out = structure.aggregate(model, {"Region": C.groups_of(matches, facts, "Continent")})
    z = array(out, out.resolve("Z"), [("East", "Sector", f"s{k}") for k in (1, 2, 3)], [("East", "Sector", f"s{k}") for k in (1, 2, 3)])
    a = iot_arrays()["Z"]
    assert z == pytest.approx(a[:3, :3] + a[:3, 3:] + a[3:, :3] + a[3:, 3:])
    club = structure.aggregate(model, {"Region": C.groups_of(matches, facts, "club")})
    assert {r.item for r in club.index("Region").collect()} == {"club", "r2"}
    with pytest.raises(WrongInput):
        C.groups_of(matches, facts, "ocean")
    with pytest.raises(WrongInput):
        C.groups_of(matches, spark.createDataFrame([("one", "half", "a"), ("one", "half", "b")], C.FACTS), "half")
