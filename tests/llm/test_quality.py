import random

import numpy as np
from fixtures import DOC_SCHEMA, frame

from sectora.llm.quality import NAMES, Trees, fit, keep_good, quality_scores, statistics


def test_statistics():
    s = dict(zip(NAMES, statistics("Ab ab! 12\nAb | é".encode()), strict=True))
    assert s["log_words"] == np.float32(np.log1p(6)) and abs(s["digit_share"] - 2 / 17) < 1e-6 and abs(s["bar_share"] - 1 / 17) < 1e-6
    assert abs(s["distinct_word_share"] - 5 / 6) < 1e-6 and abs(s["top_word_share"] - 2 / 6) < 1e-6 and s["distinct_line_share"] == 1
    assert not statistics(b"").any() and np.isfinite(statistics(b"\n \n")).all() and np.isfinite(statistics(b"x" * 200_000)).all()


def slow_score(m, row):
    total = m.base
    for feature, threshold, value in zip(m.feature, m.threshold, m.value, strict=True):
        node = 0
        for _ in range(m.depth):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - (2**m.depth - 1)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_walk_is_the_tree_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(int)
    m = fit(x[:2000], y[:2000], trees=60)
    assert (m.score(x[2000:]).round() == y[2000:]).mean() > 0.93
    assert np.allclose(m.score(x[:50]), [slow_score(m, row) for row in x[:50]])
    constant = fit(x, np.ones(3000, int))
    assert constant.score(x).min() > 0.99 and fit(x[:0], y[:0]).score(x)[0] == 0.5
    assert isinstance(constant, Trees) and len(constant.score(x[:0])) == 0


def texts(n=400):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["stone", "river", "walks", "under", "the", "old"]) for _ in range(r.randint(20, 80))).capitalize() + "."
    bad = lambda: " | ".join(r.choice(["BUY", "NOW", "!!"]) for _ in range(r.randint(20, 80)))
    return [good() if i % 3 else bad() for i in range(n)]


def test_scores_and_filter(spark):
    docs = frame(spark, [*texts(), None, ""], [(7, "a repeated id", *[None] * 6), (None, "no id", *[None] * 6)])
    labels = spark.createDataFrame([*((i, int(i % 3 > 0), 0) for i in range(400)), (9999, 1, 0), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id): r for r in quality_scores(docs, labels).collect()}
    assert quality_scores(docs, labels).count() == docs.count()
    held = [r for i, r in got.items() if i is not None and i < 400 and i != 7 and r.held_out]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 3 > 0) == int(r.score >= 0.7) for r in held)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 3 and i != 7}


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(frame(spark, ["a", None]), none).collect()} == {0.5}
    assert quality_scores(spark.createDataFrame([], DOC_SCHEMA), none).count() == 0
