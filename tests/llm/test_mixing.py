import random
from collections import Counter, defaultdict

import pytest
from fixtures import DOC_SCHEMA, frame

from sectora.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes by source; sources take shares of what is left by weight until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_ones, left = {}, set(order), share * sum(sizes.values())
    while open_ones:
        per = left / sum(weight[s] for s in open_ones)
        above = {s for s in open_ones if per * weight[s] >= most * sizes[s]}
        if not above:
            return out | {s: per * weight[s] for s in open_ones}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        open_ones -= above
    return out


def documents(spark, n=900, seed=1, sources=("b", "a", "é", "Z", None, "hot", "hot", "hot")):
    r = random.Random(seed)
    rows = [(i, r.choice([" ", "\n", " \t"]).join(["w"] * int(r.lognormvariate(3, 1.2))), "en", r.choice(sources), 1, "own", 7, "w") for i in range(n)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def by_source(rows):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    return sizes, taken, target


def test_targets_and_what_is_taken(spark):
    df = documents(spark)
    rows = mixing.copies_of(df).collect()
    words = {r.doc_id: len((r.text or "").split()) for r in df.collect()}
    assert {r.doc_id: r.size for r in rows} == words and len(rows) == len(words)
    sizes, taken, target = by_source(rows)
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    assert target == pytest.approx(targets(sizes))
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(w.size for w in rows if w.source == s) / 2
    assert all(r.taken == r.copies * r.size and r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) for r in rows)
    assert all(r.taken <= 2 * r.size for r in rows)


def test_reruns_agree_whatever_the_order_of_rows(spark):
    df = documents(spark, 500)
    runs = [sorted((r.doc_id, r.taken) for r in mixing.copies_of(x).collect()) for x in (df.repartition(7, "text"), df.orderBy("text").coalesce(1))]
    assert runs[0] == runs[1]
    assert runs[0] != sorted((r.doc_id, r.taken) for r in mixing.copies_of(df, seed=1).collect())


def test_levels_of_the_tree_keep_expected_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "KEPT", 1)
    df = documents(spark, 300, sources=("a", "b")).select("doc_id", "text", "source").cache()
    mean = defaultdict(list)
    for seed in range(2):
        rows = mixing.copies_of(df, weights=(1, 2), share=1.2, seed=seed).collect()
        sizes, taken, target = by_source(rows)
        for s in sizes:
            assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) / 2
            some = [r.copies for r in rows if r.source == s and r.size]
            mean[s].append((sum(some) / len(some), target[s] / sizes[s]))
    for pairs in mean.values():  # about as many documents as words: neither long nor short ones are preferred
        assert sum(a for a, _ in pairs) / len(pairs) == pytest.approx(pairs[0][1], abs=0.1)


def test_rows_that_repeat_and_nulls(spark):
    more = [(7, "x y z", "en", "rep", 1, "o", 1, "w")] * 400 + [(None, "q r", "en", None, 1, "o", 1, "w")] * 300 + [(None, None, "en", "none", 1, "o", 1, "w")] * 3
    df = frame(spark, ["a b", "", None]).unionByName(spark.createDataFrame(more, DOC_SCHEMA)).repartition(6)
    rows = mixing.copies_of(df, share=1.3).collect()
    sizes, taken, target = by_source(rows)
    assert len(rows) == 706 and target == pytest.approx(targets(sizes, share=1.3))
    assert abs(taken["rep"] - target["rep"]) <= 1.5 and abs(taken[None] - target[None]) <= 1
    assert target["none"] == 0 and sizes["none"] == 0


def test_repeated_rows_written_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 7)
    df = spark.createDataFrame([(1, "a b", "s")] * 100 + [(2, "c", "t")] * 50, "doc_id long, text string, source string")
    rows = mixing.copies_of(df).collect()
    assert Counter(r.doc_id for r in rows) == {1: 100, 2: 50}


def test_the_mix_itself(spark):
    df = documents(spark, 200).unionByName(spark.createDataFrame([(7, f"t{k} x", "en", "b", k, "o", 1, "w") for k in range(9)], DOC_SCHEMA))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = Counter()
    for r in mixing.copies_of(df).collect():
        want[(r.source, r.doc_id, r.size)] += r.copies
    got = Counter((r.source, r.doc_id, len((r.text or "").split())) for r in mixed.collect())
    assert got == +want


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert mixing.copies_of(empty).count() == 0 and mixing.mix(empty).count() == 0
