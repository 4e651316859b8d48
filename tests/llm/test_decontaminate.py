import random
import re
import tracemalloc

import pytest
from fixtures import DOC_SCHEMA, frame, random_texts

from sectora.llm.decontaminate import SuffixAutomaton, decontaminate, find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    sought = []
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        sought += [(i, tuple(w[a : a + k])) for a in range(len(w) - k + 1) if k]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, s in sought:
            for a in range(len(w) - len(s) + 1):
                if tuple(w[a : a + len(s)]) == s:
                    hit |= set(range(a, a + len(s)))
                    found.add(i)
        out.append((d, len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return sorted(out)


@pytest.mark.parametrize(("window", "block_words"), [(2, 1000), (3, 40), (10, 1)])
def test_like_brute_force(spark, window, block_words):
    texts = random_texts(60, 3) + [None, "", "...", "A b C", "zz " * 5000 + "a b c d e f g1 a b c d e f"]
    items = [*enumerate(random_texts(12, 4, most=14)), (90, None), (91, "zz"), (92, "a B, c"), (92, "a b c"), (93, "A b c d e f g1 a b c d e f")]
    docs, bench = frame(spark, texts), spark.createDataFrame([*items, (None, "d d")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sorted({x for s in r.spans for x in range(s.start, s.end)}), r["items"]) for r in find_contamination(docs, bench, window=window, block_words=block_words).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [*items, (None, "d d")], window)


def test_ids_of_any_type_and_repeated_rows_over_many_blocks(spark):
    docs = spark.createDataFrame([("d1", "x a b c y", 1), ("d1", "x a b c y", 2), (None, "c d e", 3), ("d2", None, 4), ("d1", "other", 5)], "doc_id string, text string, items int")
    items = spark.createDataFrame([("i2", "a b c"), ("i1", "b c"), (None, "d e"), ("i3", "zz")], "item_id string, text string")
    for block_words in (1, 100):
        got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in find_contamination(docs, items, window=3, block_words=block_words).collect()), key=str)
        assert got == sorted([("d1", 5, [(1, 4)], ["i1", "i2"])] * 2 + [(None, 3, [(1, 3)], []), ("d2", 0, [], []), ("d1", 1, [], [])], key=str)
        cut = sorted(((r.doc_id, r.text, r["items"]) for r in decontaminate(docs, items, window=3, max_coverage=0.9, block_words=block_words).collect()), key=str)
        assert cut == sorted([("d1", "x  y", 1), ("d1", "x  y", 2), (None, "c ", 3), ("d2", None, 4), ("d1", "other", 5)], key=str)


def test_memory_of_an_automaton():
    r = random.Random(4)
    items = [(i, [b"%d" % r.randrange(20_000) for _ in range(200)]) for i in range(1000)]
    tracemalloc.start()
    automaton = SuffixAutomaton(items, 10)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 200 * 200_000, held  # bytes a word
    words = items[7][1][:40] + [b"zz"] + items[9][1][100:109]
    assert automaton.match(words) == ([(0, 40)], {7})


def test_cuts_spans_and_leaves_clean_documents(spark):
    item = "one two three four five six seven eight nine ten"
    docs = frame(spark, [f"Before, it. {item.upper()}! After all of that there is a lot of other text here to keep it in.", item, "clean text", None, ""])
    out = {r.doc_id: r.text for r in decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {0: "Before, it. ! After all of that there is a lot of other text here to keep it in.", 2: "clean text", 3: None, 4: ""}


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["a b", None])
    assert [(r.n_words, r.spans, r["items"]) for r in find_contamination(docs, none).orderBy("doc_id").collect()] == [(2, [], []), (0, [], [])]
    assert decontaminate(docs, none).columns == docs.columns
    assert find_contamination(spark.createDataFrame([], DOC_SCHEMA), none).count() == 0
