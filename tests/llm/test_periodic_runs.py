import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import DOC_SCHEMA, frame

from sectora.llm import periodic_runs as pr
from sectora.llm.contracts import run_report, with_planted_runs


def brute(words, shortest):
    """Every period by itself: stretches that agree with the words a period further on; of one stretch the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def report(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(seed, n=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            unit = [r.choice(["a", "b", "É", "漢字", "x" * 30]) for _ in range(r.randint(1, 9))]
            words += (unit * r.randint(1, 7))[: r.randint(1, 50)] + [r.choice("cdefgh") for _ in range(r.randint(0, 12))]
        out.append(r.choice([" ", "\n", " \t", "\x0b"]).join(words))
    return [*out, None, "", " \n", "w " * 500, "a b " * 400, "é", " a b " * 13]


@pytest.mark.parametrize("shortest", [2, 3, 4, 5, 7, 12])
def test_all_runs_of_texts_side_by_side(shortest):
    r = random.Random(shortest)
    for _ in range(150):
        texts = [[r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 50))] + [r.randrange(3) for _ in range(r.randint(1, 9))] * r.randint(0, 5) for _ in range(r.randint(1, 4))]
        numbers, group = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).tolist()
        s, e, q = pr.find_runs(numbers, group, shortest)
        want = sorted((a + at[k], n, p) for k, t in enumerate(texts) for a, n, p in brute(t, shortest))
        assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == want


@pytest.mark.parametrize("numbers", [[bin(i).count("1") % 2 for i in range(1 << 12)], [0] * 3000, [i % 7 for i in range(3000)]])
def test_sequences_that_mislead_hashes_and_long_runs(numbers):
    x = np.array(numbers, np.int64)
    plain = pr.main_lorentz(x, np.zeros(1, np.int64), np.array([len(x)]), 4)
    exact = pr.main_lorentz(x, np.zeros(1, np.int64), np.array([len(x)]), 4, exact=True)
    assert all(np.array_equal(a, b) for a, b in zip(plain, exact, strict=True))
    short = numbers[:700]
    s, e, q = pr.find_runs(np.array(short, np.int64), np.zeros(700, np.int64), 4)
    assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == brute(short, 4)


def test_masking_leaves_only_what_repeats_near_by():
    r = random.Random(3)
    passage = [r.randrange(10_000) for _ in range(200)]
    numbers = np.array(passage + [20_000 + i for i in range(50)] + passage + [1, 2, 3] * 10, np.int64)
    starts, ends = pr.survivors(numbers, np.zeros(len(numbers), np.int64), 12)
    assert (starts.tolist(), ends.tolist()) == ([450], [480])  # the two copies of the passage drop out


def test_report_like_brute_force(spark):
    more = [(3, "a b c " * 9, *[None] * 6), (3, "a b c " * 9, *[None] * 6), (None, "a b c " * 9, *[None] * 6), (None, None, *[None] * 6), (-10, "k " * 40, *[None] * 6)]
    df = frame(spark, repetitive(1), more).repartition(5)
    got = sorted([tuple(r) for r in run_report(df).collect()], key=str)
    assert got == sorted([report(r.doc_id, r.text) for r in df.collect()], key=str)
    assert sum(r[1] > 0 for r in got) > 40


def test_planted_words(spark):
    df = frame(spark, [" ".join(f"w{i}" for i in range(k)) for k in range(80)])
    got = {r.doc_id: (r.text or "").split() for r in with_planted_runs(df).collect()}
    assert got == {r.doc_id: [w.decode() for w in planted(r.doc_id, r.text.encode().split())] for r in df.collect()}


def test_runs_and_text_of_the_general_operator(spark):
    df = spark.createDataFrame([("x", "one two " * 6 + "end"), ("y", "a  b")], "name string, body string")
    got = {r.doc_id: r for r in pr.collapse_runs(df, 12, "name", "body").collect()}
    assert [tuple(x) for x in got["x"].runs] == [(0, 12, 2)] and got["x"].text == "one two end" and got["x"].n_words == 13
    assert got["y"].runs == [] and got["y"].text == "a b"


def test_empty_table(spark):
    assert run_report(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
