import random
from collections import Counter

import numpy as np
from fixtures import DOC_SCHEMA, frame

from sectora.llm.toxicity import EXPONENTS, PAIR_DISCOUNTS, START, WORD_DISCOUNTS, KneserNey, bounded_sample, counted, least_loss, logistic, toxicity_scores, words_of

MARKS = ["vrakk", "snorg", "blefh"]


def texts(n=1200):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["ba", "lo", "ti", "re", "mu"]) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(MARKS).title())
        out.append(", ".join(words))
    return out


def slow_counts(samples):
    """Continuation counts by class of words and of pairs."""
    triples = [set(), set()]
    for y, text in samples:
        w = words_of(text.encode())
        triples[y] |= set(zip([START, START, *w], [START, *w], w, strict=False))
    pairs = [Counter((b, w) for _, b, w in t) for t in triples]
    return pairs, [Counter(w for _, w in p) for p in pairs]


def slow_ratios(text, pairs, words, d1, d2):
    """The definition, with dictionaries."""
    shared = Counter(w for _, w in {*pairs[0], *pairs[1]})
    base = lambda w: (shared.get(w, 0) + 0.5) / (sum(shared.values()) + 0.5 * (len(shared) + 1))
    left = [{w: n - d1 for w, n in c.items() if n > d1} for c in words]
    lost = sum(min(n, d1) for c in words for n in c.values()) / max(1, sum(sum(c.values()) for c in words))
    single = lambda w, k: (1 - lost) * left[k].get(w, 0) / sum(left[k].values()) + lost * base(w) if left[k] else base(w)
    known = {w for c in left for w in c} | {w for w in shared if max(c.get(w, 0) for c in words) > min(WORD_DISCOUNTS)}
    out, before = [], START
    for w in words_of(text.encode()):
        after = [{x: n - d2 for (b, x), n in c.items() if b == before and n > d2 and x in known} for c in pairs]
        seen = sum(n for c in pairs for (b, _), n in c.items() if b == before)
        weight = 1 - sum(sum(a.values()) for a in after) / max(1, seen)
        p = [(1 - weight) * after[k].get(w, 0) / sum(after[k].values()) + weight * single(w, k) if after[k] else single(w, k) for k in (0, 1)]
        out.append(np.log(p[1] / p[0]))
        before = w if w in known else None
    return out


def power_mean(x, t):
    if not x:
        return 0.0
    return np.log(np.mean(np.exp(t * np.array(x)))) / t if t else np.mean(x)


def test_counts_and_models_are_the_definition(spark):
    r = random.Random(4)
    samples = [(int(i % 3 == 0), " ".join(r.choice("a a a b b c d e f g".split()) + ("!" if r.random() < 0.1 else "") for _ in range(r.randint(0, 40)))) for i in range(40)]
    samples += [(1, "rare " * 3), (0, "")]
    got = counted(spark.createDataFrame(samples, "y int, text string").repartition(3))
    pairs, words = slow_counts(samples)
    assert {w: tuple(n) for w, n in zip(got.words, got.contexts.tolist(), strict=True)} == {w: (words[0][w], words[1][w]) for w in {*words[0], *words[1]} if max(words[0][w], words[1][w]) > 1}
    some = [t for _, t in samples[:12]] + ["", "zz a b zz", "rare rare a"]
    for d1 in WORD_DISCOUNTS:
        for d2 in PAIR_DISCOUNTS:
            m = KneserNey(got, {w: i for i, w in enumerate(got.words)}, d1, d2)
            means = m.means([t.encode() for t in some], EXPONENTS)
            for i, t in enumerate(some):
                x = slow_ratios(t, pairs, words, d1, d2)
                assert np.allclose(means[i], [power_mean(x, e) for e in EXPONENTS]), (t, d1, d2)


def test_the_choice_is_the_least_loss():
    r = np.random.default_rng(3)
    x = r.normal(size=300)
    y = (r.random(300) < 1 / (1 + np.exp(-4 * x))).astype(np.int64)
    means = r.normal(size=(300, 3, len(EXPONENTS)))
    means[:, 1, 2] = x
    best = least_loss(y, means, ["a", "b", "c"], {0: int((y == 0).sum()), 1: int(y.sum())})
    assert best.model == "b" and best.exponent == EXPONENTS[2] and best.slope > 2
    assert least_loss(np.zeros(300, np.int64), means, ["a"], {0: 300}).model == "a"


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10_000 if i == 3 else 10)) for i in range(100)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, y int")
    got = bounded_sample(docs, known, 30, 100).collect()
    assert Counter(r.y for r in got) == {0: 10, 1: 10} and 3 not in {r.doc_id for r in got}
    assert bounded_sample(docs, known, 7, 1 << 20).count() == 14


def test_logistic_line():
    r = np.random.default_rng(1)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, offset = logistic(x, y, np.ones(4000))
    assert abs(slope - 2) < 0.3 and abs(offset + 1) < 0.2


def test_held_out_accuracy(spark):
    n = 1200
    docs = frame(spark, [*texts(n), None, ""], [(7, "repeated id", *[None] * 6), (None, "no id", *[None] * 6)])
    labels = spark.createDataFrame([*((i, 1, int(i % 4 == 0)) for i in range(n)), (99999, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < n and r.doc_id != 7]
    assert len(held) > 150 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.98
    assert [r.predicted for r in rows if r.doc_id in (n, n + 1)] == [0, 0]


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity_scores(frame(spark, ["a", None]), none).collect()} == {0.5}
    assert toxicity_scores(spark.createDataFrame([], DOC_SCHEMA), none).count() == 0


def test_labels_of_one_class_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "word " * 300_000)], "doc_id string, text string")
    one = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "doc_id string, toxic int")
    assert {round(r.score, 3) for r in toxicity_scores(docs, one).collect()} == {1.0}
    two = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "doc_id string, toxic int")
    rows = toxicity_scores(docs, two).collect()
    assert sorted(r.doc_id for r in rows) == ["a", "b", "c"] and all(0 <= r.score <= 1 for r in rows)


def test_texts_far_out_dont_choose_the_exponent():
    r = np.random.default_rng(3)
    y = np.repeat([0, 1], 500)
    clear = np.where(y == 1, r.normal(1.1, 0.15, 1000), r.normal(0.2, 0.1, 1000))
    clear[::20] += 8.0  # some of both classes
    dim = r.normal(0.0, 0.06, 1000) + 0.08 * y
    means = np.repeat(dim[:, None, None], len(EXPONENTS), 2)
    means[:, 0, 1] = clear
    assert least_loss(y, means, ["model"], {0: 9000, 1: 1000}).exponent == EXPONENTS[1]


def test_ratios_stay_within_their_evidence(spark):
    samples = [(1, f"x{i} rare pair y{i}") for i in range(6)] + [(k % 2, f"x{k} pair") for k in range(40)] + [(k % 2, f"x{k} bad y{k}" if k % 2 else f"x{k} good y{k}") for k in range(80)]
    got = counted(spark.createDataFrame(samples, "y int, text string"))
    numbers = {w: i for i, w in enumerate(got.words)}
    free, held = (KneserNey(got, numbers, 1.0, 2.0, e) for e in (0.0, 4.0))
    at = lambda m, text: m.ratios([text])[0][-1]
    seen = dict(zip(got.words, got.contexts.tolist(), strict=True))
    word = at(held, b"? pair")
    assert at(free, b"rare pair") - word > np.log(10 / 4) + 0.3 and 0 < at(held, b"rare pair") - word <= np.log(10 / 4) + 1e-9
    for w in (b"bad", b"good", b"pair"):
        n0, n1 = seen[w]
        limit = np.log((n1 + 4) / (n0 + 4))
        assert abs(at(held, b"? " + w)) <= abs(limit) + 1e-9
    assert np.allclose(KneserNey(got, numbers, 1.0, 2.0).ratios([b"x1 bad y1 good"])[0], free.ratios([b"x1 bad y1 good"])[0])
