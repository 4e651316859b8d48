import hashlib
from collections import defaultdict

import pytest
from fixtures import DOC_SCHEMA, frame

from sectora.llm.common import texts as texts_of
from sectora.llm.exact_dedup import HOT, _dealt, _hashed, exact_dedup, mark_duplicates, text_classes


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = [x for x in groups[r.text or ""] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        out.append((r.doc_id, best, len(groups[r.text or ""]), r.doc_id == best, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hash_chars", [32, 2])
def test_marks_like_brute_force_even_when_hashes_collide(spark, keep, hash_chars):
    texts = [f"text {i % 40}" for i in range(300)] + [None, "", None, "Text 1", "x" * 100_000, "x" * 100_000, " text 1"]
    df = frame(spark, texts, [(5, "text 5", *[None] * 6), (None, "text 6", *[None] * 6), (None, "alone", *[None] * 6), (None, "alone", *[None] * 6)])
    got = sorted([tuple(r) for r in mark_duplicates(df, keep=keep, hash_chars=hash_chars).collect()], key=str)
    assert got == brute(df.collect(), keep)


@pytest.mark.parametrize("hash_chars", [32, 1])
def test_one_text_in_a_third_of_all_rows_is_spread(spark, hash_chars):
    texts = ["hot"] * 500 + [f"text {i % 700}" for i in range(1000)]
    df = frame(spark, texts).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted([tuple(r) for r in mark_duplicates(df, keep="max", hash_chars=hash_chars).collect()], key=str)
        kept = sorted(r.doc_id for r in exact_dedup(df, keep="max").collect())
        classes, hot, _ = text_classes(texts_of(df))
        shares = _dealt(_hashed(texts_of(df), 32), hot).filter("shares > 1 and text = 'hot'").groupBy("salt").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute(df.collect(), "max") and kept == sorted(r[0] for r in got if r[3])
    assert len(shares) > HOT // 8 and max(r["count"] for r in shares) < 12


def test_a_map_stage_run_again_in_another_order_gives_the_same_classes(spark):
    df = frame(spark, ["hot"] * 300 + [f"text {i % 300}" for i in range(900)])
    found = [sorted(map(tuple, mark_duplicates(x, keep="max").collect()), key=str) for x in (df.repartition(3, "text"), df.orderBy("text").repartition(7))]
    assert found[0] == found[1] == brute(df.collect(), "max")


def test_keeps_one_whole_row_of_each_text(spark):
    df = frame(spark, ["a", "b", "a", None, "", "c"], [(0, "a", *[None] * 6), (5, "c", *[None] * 6)])
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "a"), (1, "b"), (3, None), (5, "c")]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert mark_duplicates(df).count() == 0 and exact_dedup(df).count() == 0
