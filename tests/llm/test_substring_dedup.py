import random
from collections import Counter

import numpy as np
import pytest
from fixtures import DOC_SCHEMA, frame

from sectora.llm import substring_dedup as sd


def brute(rows, k):
    split = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    least = {}
    for d, w in split:
        if d is not None:
            for a in range(len(w) - k + 1):
                s = tuple(w[a : a + k])
                least[s] = min(least.get(s, d), d)
    out = Counter()
    for d, w in split:
        gone = set()
        if d is not None:
            for a in range(len(w) - k + 1):
                if least[tuple(w[a : a + k])] < d:
                    gone |= set(range(a, a + k))
        out[(d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())] += 1
    return out


def documents(seed, n=80):
    r = random.Random(seed)
    common = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(5, 40))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [r.choice(common) if r.random() < 0.5 else " ".join(r.choice(["x", "yy", "É", "z z", "漢", "q"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        out.append(r.choice(["\n", " ", " \t "]).join(parts))
    return out + [None, "", " ", "w " * 3000, "w " * 2000, out[5], out[5]]


@pytest.mark.parametrize(("k", "gram", "run_bytes"), [(13, 3, 16 << 20), (13, 1, 2000), (4, 2, 500), (3, 3, 1)])
def test_like_brute_force(spark, k, gram, run_bytes):
    df = frame(spark, documents(k), [(3, " ".join("abcdefghij" * 3), *[None] * 6), (3, documents(k)[7], *[None] * 6), (3, documents(k)[7], *[None] * 6), (None, documents(k)[7], *[None] * 6)])
    got = Counter(tuple(r) for r in sd.remove_repeats(df.repartition(5), k, gram, run_bytes=run_bytes, bucket_bytes=5000).collect())
    assert got == brute(df.collect(), k)


def test_unique_ids_need_no_text_key(spark):
    df = frame(spark, documents(9))
    assert Counter(tuple(r) for r in sd.remove_repeats(df.repartition(3), 5).collect()) == brute(df.collect(), 5)


def test_rolling_covers_each_window_whole():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 50).astype(np.uint64)
    for k in range(1, 20):
        got = sd.rolling(h, k)
        assert len(got) == 51 - k
        for p in range(len(got)):
            assert got[p] == sd.rolling(h[p : p + k].copy(), k)[0]
        assert len(np.unique(got)) == len(got)


def test_windows_that_share_a_hash_are_told_apart():
    r = np.random.default_rng(2)
    words = [b"abc"[i : i + 1] for i in r.integers(0, 3, 200)]
    text, k = b" ".join(words) + b" ", 3
    place, _ = sd.word_hashes(text)
    at, doc = np.arange(198), r.integers(0, 20, 198)
    least = {}
    for a in at:
        least[tuple(words[a : a + k])] = min(least.get(tuple(words[a : a + k]), 99), doc[a])
    got = sd.later_windows(text, place, np.zeros(200, np.uint64), at, doc, k)
    assert got.tolist() == [bool(doc[a] > least[tuple(words[a : a + k])]) for a in at]


def test_word_hashes_depend_on_the_word_alone():
    r = random.Random(6)
    words = [bytes(r.choice(b"abc\xc3\xa9") for _ in range(r.choice([1, 2, 5, 30]))) for _ in range(2000)] + [b"x" * 5000, b"y" * 3_000_000, b"x" * 5000, b"z" * 4096] + [b"q" * 4000] * 600
    place, digest = sd.word_hashes(b" ".join(words) + b" ")
    alone = {}
    for w, d, a in zip(words, digest.tolist(), place.tolist(), strict=False):
        assert alone.setdefault(w, d) == d == sd.word_hashes(w + b" ")[1][0]
    assert len(set(alone.values())) == len(alone) and len(digest) == len(words)


def test_a_frequent_pair_draws_no_share_of_the_windows(spark):
    r = random.Random(8)
    texts = []
    for _ in range(300):
        words = [f"w{r.randrange(3000)}" for _ in range(120)]
        for at in range(0, 120, 6):
            words[at : at + 2] = ["of", "the"]  # a third of all words
        texts.append(" ".join(words))
    hot = sd.mixed(sd.rolling(sd.word_hashes(b"of the ")[1], 2))[0]
    sizes = {}
    for name, tiers in (("plain", np.zeros(sd.SLOTS, np.uint64)), ("ranked", sd.slot_tiers(frame(spark, texts), 2))):
        if name == "plain":  # as if the pair's hash were the smallest
            tiers = np.ones(sd.SLOTS, np.uint64)
            tiers[int(hot >> np.uint64(48))] = 0
        rows, _ = sd.super_kmers(list(range(300)), [0] * 300, [t.encode() for t in texts], 13, 2, 64, tiers)
        sizes[name] = sorted(len(places) + len(strings) for _, strings, places in rows)
    assert sizes["plain"][-1] > 10 * sizes["ranked"][-1]
    assert sizes["ranked"][-1] < 2 * np.median(sizes["ranked"])


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
