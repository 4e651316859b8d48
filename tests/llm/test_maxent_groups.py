import math
import random
import zlib

import numpy as np
from fixtures import frame

from sectora.llm import maxent as M


def test_words_beyond_the_members_follow_their_history(spark):
    r = random.Random(4)
    texts = [" ".join(f"a{i}x b{i}x" for i in r.choices(range(40), k=60)) for _ in range(600)]
    for head in (1 << 16, 10):  # counts broadcast, or met in the groups' tasks
        got = [x for x in M.score_documents(frame(spark, texts), head=head, members=1).collect() if x.held_out]
        assert len(got) > 50 and sum(x.score for x in got) > sum(x.base_score for x in got) + 0.2 * sum(x.n_tokens for x in got)


def test_group_sums_to_one():
    r = np.random.default_rng(5)
    m, n = 30, 3000
    word, before, ahead = r.integers(0, m, n), r.integers(0, 9, n).astype(np.uint32), r.integers(0, 9, n).astype(np.uint32)
    teach = np.ones(n + m + 1, bool)
    teach[n:] = False
    asked = np.arange(m + 1)  # the last is an unseen word
    history = lambda x, v: np.concatenate([x, np.full(m + 1, v, np.uint32)])
    for old in (3, 77):
        logs = M.Group(np.sort(np.bincount(word, minlength=m))[::-1]).logs(np.concatenate([word, asked]), history(before, 3), history(ahead, old), teach)
        assert abs(sum(10 ** logs[n:]) - 1) < 1e-4


def test_groups_of_a_class_sum_to_one_and_follow_the_vocabulary(spark):
    words = [f"w{i}x".encode() for i in range(3000)]
    often = {w: 3 + max(0, 60 - i) for i, w in enumerate(words)}
    counts = spark.createDataFrame(list(often.items()), "word binary, n long")
    old = M.GROUP_WORDS, M.BRANCHES
    M.GROUP_WORDS, M.BRANCHES = 4, 8
    try:
        lexicon = M.lexicon_of(counts, 100, 50)
    finally:
        M.GROUP_WORDS, M.BRANCHES = old
    assert lexicon.levels == 3 and M.TAILS * lexicon.groups * 4 >= 2950
    own = np.ones_like(lexicon.mass)
    for w in words:
        if lexicon.number.get(w, lexicon.members) >= lexicon.members:
            own[M.tail_class(w), zlib.crc32(w) % lexicon.groups] += often[w] + 1
    assert (own == lexicon.mass).all()
    w = M.Weights(lexicon)
    M.learn(w, tuple(np.full(len(t), 1e-2, np.float32) for t in w.tables()), lexicon, [b" ".join(words)])
    codes = np.arange(lexicon.groups, dtype=np.uint32)
    tail = np.full(lexicon.groups, M.tail_class(words[0]))
    rows = np.repeat(lexicon.features(np.array([7]), np.array([5])), lexicon.groups, axis=1)
    logs = sum(M.log_at(M.branch_logits(w, M.branch_rows(w, rows, node), node), branch) for node, branch in lexicon.steps(tail, codes))
    assert abs(math.fsum(np.exp(logs)) - 1) < 1e-4


def test_scores_hardly_depend_on_the_partitions(spark):
    r = random.Random(6)
    texts = [" ".join(f"a{i}x b{i}x" for i in r.choices(range(40), k=60)) for _ in range(400)]
    of = lambda n: {x.doc_id: (x.score / x.n_tokens, x.base_score, x.n_known) for x in M.score_documents(frame(spark, texts).repartition(n), members=8).collect()}
    one, seven = of(1), of(7)
    for i, (score, base, known) in one.items():
        assert abs(score - seven[i][0]) < 0.1 and math.isclose(base, seven[i][1]) and known == seven[i][2]
    assert abs(np.mean([x[0] for x in one.values()]) - np.mean([x[0] for x in seven.values()])) < 0.03


def test_batches_without_words_of_a_kind():
    w = np.zeros((4, 2), np.float32)
    M.step(w, np.ones(4, np.float32), np.zeros(0, np.int64), np.zeros((0, 2), np.float32))
    assert not w.any()


def test_sums_of_runs():
    r = np.random.default_rng(1)
    rows, x = np.minimum(r.zipf(1.3, 5000), 900), r.normal(size=(5000, 3)).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) != 0)))
    assert np.allclose(M.summed(x, order, starts), [x[rows == k].sum(0) for k in np.unique(rows)], atol=1e-3)


def test_packed_numbers():
    a, b, c = np.arange(-5, 95, dtype="<i4"), np.linspace(0, 1, 100).astype("<f4"), np.arange(100, dtype="<i8") << 40
    for x, y in zip((a, b, c), M.unpacked(M.packed(a, b, c), "<i4", "<f4", "<i8"), strict=True):
        assert (x == y).all()
    assert [len(x) for x in M.unpacked(M.packed(a[:0], c[:0]), "<i4", "<i8")] == [0, 0]


def test_many_batches_travel_in_few_arrow_batches():
    lexicon = M.Lexicon([], np.zeros(0, np.int64), 0, np.ones(M.TAILS), np.ones(M.TAILS), 1, 4, np.ones((M.TAILS, 4)))
    rows = []
    for base in (9, 3, 5, 7):
        raws = [b"one two three", b"", b"four one"]
        coded = lexicon.coded(raws)
        rows += M.to_groups(lexicon, 2, base, coded, lexicon.codes(coded[0], coded[2]), np.zeros(len(raws), bool))
    batch = M.moved(rows)
    assert batch.num_rows == len(rows) == 8
    found = list(M.inside_groups(lexicon, iter([batch])))
    assert len(found) == 1 and found[0].column(1).to_pylist() == [3, 5, 7, 9]
    for ints in found[0].column(3).to_pylist():
        text, _, seen = M.unpacked(ints, "<i4", "<f4", "<i8")
        assert np.bincount(text).tolist() == [4, 1, 3] and not seen.any()


def test_tokens_are_those_of_a_plain_split_each_held_once():
    r = random.Random(3)
    raws = [b"", b" ", b"\t a\r\nB\x0bb\x0cB ", "Über x \x1cz\x85 über".encode(), b"a", *(bytes(r.choice(b"aB \n\xff") for _ in range(r.randint(0, 30))) for _ in range(300))]
    flat, lengths = M.tokens(raws)
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    want = [[*x.translate(lower).split(), M.END] for x in raws]
    assert lengths.tolist() == [*map(len, want)] and flat.to_pylist() == [w for x in want for w in x]
    assert len(flat.dictionary) == len({w for x in want for w in x})
    assert [len(x) for x in M.tokens([])] == [0, 0]


def small_model():
    counts = np.arange(300, 0, -1)
    lexicon = M.Lexicon([f"w{i}".encode() for i in range(300)], counts, 200, np.full(M.TAILS, 500.0), np.full(M.TAILS, 9.0), 1, 4, np.ones((M.TAILS, 4)), 64, 64, 64)
    r = random.Random(8)
    return lexicon, M.Weights(lexicon), [" ".join(f"w{r.randrange(320)}" for _ in range(20000)).encode()]


def test_exps_follow_the_tables_not_the_tokens(monkeypatch):
    lexicon, w, raws = small_model()
    seen = []
    monkeypatch.setattr(np, "exp", lambda x, *a, f=np.exp, **b: (seen.append(x.size), f(x, *a, **b))[1])
    assert M.scored(w, lexicon, raws)[0].tolist() == [20001]
    assert sum(seen) < 3 * sum(t.size for t in w.tables()) < 20001 * 40 / 2  # one for each class and token before


def test_products_of_exps_are_exps_of_sums_and_large_weights_go_by_their_logits():
    lexicon, w, raws = small_model()
    M.learn(w, tuple(np.full(len(t), 1e-2, np.float32) for t in w.tables()), lexicon, raws)
    e, r = M.exps(w), np.random.default_rng(2)
    rows, cls = r.integers(0, 64, (3, 500)), r.integers(0, M.CLASSES, 500)
    for logits, at, k in ((M.class_logits, [rows], 40), (M.slot_logits, [rows[0], cls], 6), (M.branch_logits, [rows, r.integers(0, 8, 500)], 4)):
        target = r.integers(0, k, 500)
        assert np.allclose(M.shares(w, e, logits, *at), M.softmax(logits(w, *at)), rtol=1e-4, atol=1e-9)
        assert np.allclose(M.log_shares(w, e, target, logits, *at), M.log_at(logits(w, *at), target), atol=1e-4)
    w.of_class *= 1e4
    assert M.exps(w) is None
    assert np.isfinite(M.scored(w, lexicon, raws)[3]).all() and np.isfinite(M.shares(w, None, M.class_logits, rows)).all()


def test_rows_of_their_own_for_keys_that_teach():
    r = np.random.default_rng(4)
    keys, teach = r.integers(0, 50, 400).astype(np.uint64) << np.uint64(40), r.random(400) < 0.2
    rows, n = M._own_rows(keys, teach)
    own = {*keys[teach].tolist()}
    assert n == len(own) + 1 and len({*zip(keys[teach].tolist(), rows[teach].tolist(), strict=True)}) == len(own) == len({*rows[teach].tolist()})
    assert all((row == n - 1) == (key not in own) for key, row in zip(keys.tolist(), rows.tolist(), strict=True))
    assert M._own_rows(keys, np.zeros(400, bool))[1] == 1
