import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import DOC_SCHEMA, frame

from sectora.llm import maxent as M


def texts(n=900, seed=2):
    r = random.Random(seed)
    pools = [["die", "der", "und", "Haus", "über"], ["the", "of", "and", "house", "Over"]]
    out = []
    for _ in range(n):
        pool = r.choice(pools)
        out.append(" ".join(r.choice(pool) if r.random() < 0.8 else "".join(r.choice("abc") for _ in range(r.randint(3, 7))) for _ in range(r.randint(5, 60))))
    return out


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def split(text):
    return [*bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split(), M.END]


@pytest.mark.parametrize("head", [1 << 16, 5])
def test_base_is_brute_force_and_the_model_beats_it(spark, head):
    df = frame(spark, [*texts(), None, "", " \t", "zebra " * 3000], [(7, "again again", *[None] * 6), (7, "again again", *[None] * 6), (None, "the house", *[None] * 6)])
    rows = df.collect()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in split(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = split(r.text)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[(r.doc_id, held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6))] += 1
    got = M.score_documents(df, head=head).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    some = [r for r in got if r.held_out and r.n_tokens > 3 and r.doc_id is not None and r.doc_id < 900]
    assert len(some) > 50 and all(np.isfinite(r.score) for r in got)
    if head > 100:
        assert sum(r.score for r in some) > sum(r.base_score for r in some) + 0.1 * sum(r.n_tokens for r in some)


def model():
    counts = Counter(w for t in texts() for w in split(t))
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    members = 40
    tail_n, tail_v = np.zeros(M.TAILS), np.zeros(M.TAILS)
    for w, c in top[members:]:
        tail_n[M.tail_class(w)] += c
        tail_v[M.tail_class(w)] += 1
    head = top[:100]
    lexicon = M.Lexicon([w for w, _ in head], np.array([c for _, c in head]), members, tail_n, tail_v)
    return counts, lexicon, M.Weights(lexicon)


def test_probabilities_of_the_next_word_sum_to_one():
    counts, lexicon, w = model()
    M.learn(w, tuple(np.full(len(t), 1e-2, np.float32) for t in w.tables()), lexicon, [t.encode() for t in texts(300, 5)])
    for history in ("the", "die und", "zzzz of"):
        logs = {}
        for x in counts:
            _, _, _, model_log, beyond = M.scored(w, lexicon, [(history + " " + x.decode()).encode() if x else history.encode()])
            logs[x] = model_log[0] + sum(math.log10(counts[b] + 1) for b in beyond[0])
            if x:  # less what stands before and after the word
                logs[x] -= after(w, lexicon, history, x.decode())
        whole = prefix(w, lexicon, counts, history)
        total = sum(10 ** (v - whole) for v in logs.values())
        unseen = sum(10 ** class_log(w, lexicon, history, k) / (lexicon.tail_n[k] + lexicon.tail_v[k] + 1) for k in range(M.TAILS))
        assert abs(total + unseen - 1) < 1e-4


def class_log(w, lexicon, history, k):
    _, _, _, _, before, ahead = lexicon.coded([history.encode()])
    rows = lexicon.features(before[-1:], ahead[-1:])
    return float(M.log_at(M.class_logits(w, rows), np.array([M.CLASSES + k]))[0]) / math.log(10)


def last_log(w, lexicon, raw):
    """The log10 probability of the end token after raw."""
    _, _, number, cls, before, ahead = lexicon.coded([raw])
    rows = lexicon.features(before[-1:], ahead[-1:])
    c, out = cls[-1:], 0.0
    out += float(M.log_at(M.class_logits(w, rows), c)[0])
    if c[0] < M.CLASSES:
        out += float(M.log_at(M.slot_logits(w, M.inner_rows(w, rows, c), c), number[-1:] // M.CLASSES)[0])
        return out / math.log(10)
    return out / math.log(10) + lexicon.logs[number[-1]] - math.log10(lexicon.tail_n[c[0] - M.CLASSES] + lexicon.tail_v[c[0] - M.CLASSES] + 1)


def after(w, lexicon, history, x):
    return last_log(w, lexicon, (history + " " + x).encode())


def prefix(w, lexicon, counts, history):
    """The log10 probability of the words of the history alone."""
    found = M.scored(w, lexicon, [history.encode()])
    return found[3][0] + sum(math.log10(counts[b] + 1) for b in found[4][0]) - last_log(w, lexicon, history.encode())


def test_without_training_documents_or_any(spark):
    only = next(i for i in range(100) if held(i))
    got = M.score_documents(spark.createDataFrame([(only, "a b", *[None] * 6)], DOC_SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and np.isfinite(got[0].score)
    assert M.score_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
