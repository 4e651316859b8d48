import hashlib
import random

import pytest
from fixtures import DOC_SCHEMA, rows
from test_decontaminate import brute as slow_hits
from test_simhash import slow_fingerprint, slow_roots

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sectora.llm.quality import quality_scores  # noqa: E402


def texts():
    r = random.Random(12)
    good = lambda n: " ".join("".join(r.choice(["ba", "lo", "ti", "re", "mu"]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."
    items = [good(14) for _ in range(5)]
    out = [good(r.randint(30, 90)) for _ in range(150)] + [" | ".join(["BUY", "NOW!!"] * r.randint(10, 30)) for _ in range(80)]
    out += [out[3], out[3], out[9]]
    out += [" ".join([*out[i].split()[:20], "changed", *out[i].split()[20:]]) for i in range(20, 25)]
    out += [good(40) + "\n" + items[0].upper() + "\n" + good(30), items[1], None, ""]
    return out, items


def test_like_brute_force(spark, tmp_path):
    some, items = texts()
    docs = [(*x[:5],) for x in rows(some)]
    schema = ",".join(DOC_SCHEMA.split(",")[:5])
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("|" not in (t or "|")), 0) for i, t in enumerate(some)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    scores = {r.doc_id: r.score for r in quality_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    kept = {d: t or "" for d, t, *_ in docs if scores[d] >= 0.7}
    assert not any("|" in t for t in kept.values()) and len(kept) > 150
    kept = {max(d for d, u in kept.items() if u == t): t for t in kept.values()}
    up = slow_roots(sorted({slow_fingerprint(t) for t in kept.values()}), 4)
    groups = {}
    for d, t in kept.items():
        groups.setdefault(up[slow_fingerprint(t)], []).append(d)
    kept = {min(g): kept[min(g)] for g in groups.values()}
    hits = {d: (n, hit) for d, n, hit, _ in slow_hits(list(kept.items()), list(enumerate(items)), 10)}
    clean = {}
    for d, t in kept.items():
        n, hit = hits[d]
        if len(hit) <= 0.5 * n:
            clean[d] = t if not hit else None
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) and any(t is None for t in clean.values())
    for d, t in clean.items():
        if t is not None:
            assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = ",".join(DOC_SCHEMA.split(",")[:5])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
