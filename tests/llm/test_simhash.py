import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import DOC_SCHEMA, frame

from sectora.llm import simhash
from sectora.llm.components import roots


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, radius):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= radius:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def near_texts(seed=3):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(r.randint(1, 150))] for _ in range(40)]
    out = []
    for words in base:
        for _ in range(r.randint(1, 5)):
            copy = list(words)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = "new"
            out.append(" ".join(copy).title() if r.random() < 0.3 else "\n".join(copy))
    return out + [None, "", " \t", "one", "ONE", "one two three", "w " * 9000, "w " * 9001]


def test_fingerprints():
    for text in [*near_texts(), "É é ß word", "a b c d"]:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_components_like_brute_force(spark):
    df = frame(spark, near_texts(), [(3, "a repeated id", *[None] * 6), (None, "no id", *[None] * 6), (500, "no id", *[None] * 6)])
    rows = df.collect()
    up = slow_roots({slow_fingerprint(r.text) for r in rows}, 4)
    low = {}
    for r in rows:
        if r.doc_id is not None:
            root = up[slow_fingerprint(r.text)]
            low[root] = min(low.get(root, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{slow_fingerprint(r.text):016x}", low[up[slow_fingerprint(r.text)]]) for r in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    kept = simhash.near_dedup(df).collect()
    assert sorted(up[slow_fingerprint(r.text)] for r in kept) == sorted(set(up.values()))
    assert all(r.doc_id == low[up[slow_fingerprint(r.text)]] for r in kept)


@pytest.mark.parametrize(("most", "part_bits"), [(1 << 22, 0), (5000, 2), (700, 9)])
def test_every_link_of_a_place_is_found_in_parts_too(most, part_bits):
    r = np.random.default_rng(4)
    centre = np.uint64(0x5A5A5A5A5A5A5A5A)
    fps = np.array([centre ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False))) for _ in range(60)], np.uint64)
    fps = np.unique(np.concatenate([fps, r.integers(0, 1 << 63, 40).astype(np.uint64)]))
    found = []
    flips = simhash.masks(4, 2)
    places = {}
    for f in fps:
        for p in (f >> np.uint64(60)) ^ flips:
            places.setdefault(int(p), []).append(f)
    for place, members in places.items():
        for part in range(1 << part_bits):
            u, v = simhash.place_links(np.array(members, np.uint64), place, 4, 4, part, part_bits, most)
            found += zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist(), strict=True)
    want = slow_roots(sorted(fps.tolist()), 4)
    up = {f: f for f in fps.tolist()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in up} == want


def test_heavy_places_are_split(spark):
    r = random.Random(1)
    fps = [(1 << 40 | 1 << b | 1 << r.randrange(62)) for b in range(62)] + [r.getrandbits(62) for _ in range(50)]
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    links = simhash.fingerprint_links(df, place_variants=2000)
    got = {x.node: x.root for x in roots(links).collect()}
    want = slow_roots(sorted(set(fps)), 4)
    assert len({got.get(f, f) for f in fps}) == len(set(want.values()))
    assert all((got.get(a, a) == got.get(b, b)) == (want[a] == want[b]) for a in fps for b in fps)


def test_a_group_of_near_copies_is_dealt_evenly(spark):
    r = np.random.default_rng(9)
    flips = simhash.masks(64, 3)
    group = np.uint64(0x123456789ABCDEF) ^ r.choice(flips, 3000, replace=False)
    fps = np.concatenate([group, r.integers(0, 1 << 63, 3000).astype(np.uint64)])
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fingerprint long")
    sizes = []
    own = simhash.place_links
    dealt = simhash.fingerprint_links(df, place_variants=50_000)
    plan = dealt._jdf.queryExecution().toString()
    assert "place" in plan and "part" in plan
    got = {x.node: x.root for x in roots(dealt).collect()}
    near = [v for v in group.view(np.int64).tolist()]
    assert len({got.get(f, f) for f in near}) == 1
    # what a part makes is its own variants only
    for k in (0, 3, 7):
        u = [len(np.unique(own(group, int(group[0] >> np.uint64(60)), 4, 4, part, k)[0])) for part in range(1 << k)]
        sizes.append(max(u))
    assert sizes[0] >= sizes[1] >= sizes[2]


def test_parities_are_linear():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 1 << 63, 1000).astype(np.uint64), r.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (simhash.parities(a ^ b, 20) == simhash.parities(a, 20) ^ simhash.parities(b, 20)).all()
    counts = np.bincount(simhash.parities(simhash.masks(64, 2), 5).astype(int), minlength=32)
    assert counts.max() < 2 * counts.mean()


def test_roots_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)] + [(-7, 2000)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1100)}, 2000: -7}
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert simhash.near_duplicates(df).count() == 0 and simhash.near_dedup(df).columns == df.columns
