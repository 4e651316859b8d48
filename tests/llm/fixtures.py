"""Small documents with the odd cases: nulls, empty texts, repeated rows, long words, clashing column names."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, spans int, word string"


def rows(texts, first=0):
    return [(first + i, t, "en", "src0", None if t is None else len(t), "own", 7, "w") for i, t in enumerate(texts)]


def frame(spark, texts, more=()):
    return spark.createDataFrame([*rows(texts), *more], DOC_SCHEMA)


def random_texts(n, seed=1, vocabulary=("a", "b", "c", "d", "E", "f", "é", "g1", "漢字"), most=60):
    r = random.Random(seed)
    return [r.choice([" ", "  ", "\n", ", ", "\t", " ", "-"]).join(r.choice(vocabulary) for _ in range(r.randint(0, most))) for _ in range(n)]
