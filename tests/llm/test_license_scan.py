import random
import re
from collections import Counter

from fixtures import DOC_SCHEMA, frame

from sectora.llm.license_scan import NOTICES, PHRASES, scan, template_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, out = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(a, label) for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p]
    return len(w), len(out), min((a for a, _ in out), default=None), max((a for a, _ in out), default=None), ",".join(sorted({x for _, x in out}))


def test_base_places_like_brute_force(spark):
    texts = [
        "The MIT License; mit-license, MIT\nLICENSE mit license", "GNU General Public License GNU general public license gnu general public", "CC BY", "cc by cc by cc", "CC", "é Apache License é",
        "apache licenses mitlicense", None, "", "...", "word " * 20_000 + "mit license", *NOTICES, "CC BY cc",
    ]
    df = frame(spark, texts, [(1, "MIT license", *[None] * 6), (1, "MIT license", *[None] * 6), (None, "cc by", *[None] * 6)])
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(df).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in df.collect())


def test_notices_with_added_and_lost_words(spark):
    mit = next(t for t, label in NOTICES.items() if label == "mit" and t.startswith("permission"))
    texts = [mit, mit.replace("free of charge", "free of any charge"), mit.replace("a copy of", "copy of"), " ".join(mit.split()[:6]), "All rights\nreserved.", "all rights", "x " + mit.upper() + " y " + mit]
    got = {r.doc_id: (r.labels, r.score) for r in scan(frame(spark, texts)).collect()}
    assert [got[i][0] for i in range(7)] == ["mit", "mit", "mit", "", "all-rights-reserved", "", "mit"]
    assert got[0][1] == 1.0 and 0.75 <= got[1][1] < 1 and got[3][1] == 0.0 and all(0 <= s <= 1 for _, s in got.values())


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def verified(text, gram=2, drift=2, least=0.75):
    """Labels and best share of the notices of a text, by loops."""
    w, best, found = words(text), 0.0, set()
    for notice, label in NOTICES.items():
        t = template_words(notice)
        grams = [t[q : q + gram] for q in range(len(t) - gram + 1)]
        hits = sorted((p - q, q, p) for p in range(len(w) - gram + 1) for q, g in enumerate(grams) if w[p : p + gram] == g)
        runs = []
        for hit in hits:
            if not runs or hit[0] - runs[-1][-1][0] > drift:
                runs.append([])
            runs[-1].append(hit)
        for run in runs:
            n, far = 0, -1
            for q in sorted({q for _, q, _ in run}):
                p = min(p for _, k, p in run if k == q)
                n, far = n + (p > far), max(far, p)
            if n / len(grams) >= least:
                found.add(label)
                best = max(best, n / len(grams))
    return found, best


def test_spans_like_brute_force(spark):
    r = random.Random(5)
    notices = [template_words(t) for t in NOTICES]
    texts = ["rights reserved rights reserved", "all rights all rights", "under the under the under the", "reserved rights all", "all rights reserved all rights reserved", "rights all rights reserved"]
    for _ in range(120):  # pieces of notices, doubled, swapped, with words added and lost
        out = []
        for _ in range(r.randint(1, 4)):
            t = r.choice(notices)
            a = r.randint(0, len(t) - 1)
            out += [x for x in t[a : r.randint(a, len(t)) + 1] for x in [x] * r.choice([0, 1, 1, 1, 1, 1, 1, 2])] + r.choice([[], ["x"], t])
        texts.append(" ".join(out))
    got = {x.doc_id: (x.labels, x.score) for x in scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        found, best = verified(text)
        _, n, _, _, phrases = base(text)
        assert got[i] == (",".join(sorted(found | set(filter(None, phrases.split(","))))), 1.0 if n else best), text
    assert got[0] == ("", 0.0) and got[2] == ("", 0.0) and got[4] == ("all-rights-reserved", 1.0)


def test_templates_are_a_parameter(spark):
    got = scan(frame(spark, ["Use it as you like, my friend", "x"]), phrases={"as you": "own"}, notices={"use it as you like": "free"}).orderBy("doc_id").collect()
    assert [(x.n_base, x.first_word, x.base_labels, x.labels, x.score) for x in got] == [(1, 2, "own", "free,own", 1.0), (0, None, "", "", 0.0)]


def test_rows_that_repeat_often(spark):
    df = frame(spark, ["mit license"]).crossJoin(spark.range(9000)).select("doc_id", "text")
    assert [tuple(x) for x in scan(df).groupBy("doc_id", "n_base", "labels").count().collect()] == [(0, 1, "mit", 9000)]
