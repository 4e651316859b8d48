import hashlib
import random

import numpy as np
import pytest
from fixtures import DOC_SCHEMA, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from sectora.llm.bpe import Codec, Vocabulary, encode_decode, merge_alone, merge_in_step  # noqa: E402
from sectora.llm.queries import tokenize  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "!", "'s", "'re", " '", "\x85", "\xa0", " ", "\x1c", "<|endoftext|>", "漢", "🎉", "\r\n", "  \n x", "the", " of", "　", "²", "Ⅷ", "á", "\x00", "​"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return Codec(Vocabulary.load(PATH), cache_entries=500)


def test_like_the_library(library, codec):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["x" * 500, "ab" * 3000, "!?" * 400, " " * 300]
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        for text, ids, want in zip(some, codec.encode(some), library.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
            assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_trees_in_step_and_alone_agree():
    v = Vocabulary.load(PATH)
    r = random.Random(2)
    pieces = [bytes(r.choice(b" aehinorst") for _ in range(r.randint(1, 64))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in merge_in_step(pieces, v)] == [merge_alone(p, v) for p in pieces]


def test_frame(spark, library):
    texts = ["", None, "Hello  world", "é" * 2000, "a b\n\nc"]
    docs = frame(spark, texts, [(0, "again", *[None] * 6), (None, "no id", *[None] * 6)])
    for r in encode_decode(docs, PATH).collect():
        assert r.ids == library.encode(r.decoded, add_special_tokens=False).ids
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in tokenize(docs, PATH).collect()}
    assert got == {(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert tokenize(spark.createDataFrame([], DOC_SCHEMA), PATH).count() == 0
