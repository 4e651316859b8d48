"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney models of word pairs, one of toxic and one of ordinary training texts. All counts are continuation counts: in how many different
contexts an expression stands, so that copies of a text teach no more than the text. A pair's discounted share among those of its first word in the class
backs off to the class's discounted share of the word, and that to the word's share over both classes. The weights of the backoff are shared too: they
are the mass that discounts take from the counts of both classes together. So an expression that neither class has often enough to outlive the discount
is as likely under both, and rare ones favour neither.

Ratios of shares know nothing of how often an expression was seen: a preceding word with one kept pair in one class gives that pair all of its mass, and a
word seen ten times has nearly the ratio of one seen a thousand times. So no log ratio goes beyond what its counts bear out: log((a + e) / (b + e)) of the
greater and the lesser count, for a pair beyond that of its word. e is chosen with the discounts; 0 sets no limit.

Every word after its predecessor has a likelihood under both models, and a text is compared by the mean of their ratio over its words, so that its length
doesn't count: the power mean of some exponent (0: the mean of the log ratios, the usual mean log-likelihood). A few insults in a long text are as clear
in the mean of ratios as they are invisible among the log ratios of thousands of ordinary words, which is why the exponent is chosen with the discounts:
from a small grid, by the loss of a logistic line on labelled training texts that the counts haven't seen.

The models learn from a bounded sample: at most `sample_rows` labelled rows of each class, those whose id hashes lowest, and of these the first that have
`sample_bytes` of text together (a longer one is passed over); three in four are counted, the rest choose and set the line. Counting is a Spark
aggregation; only words and pairs that outlive the least discount reach the driver and are broadcast, which the sample bounds.

Nulls and empty texts have no words and get the score of a difference of zero. Without labels of both classes the score is their share (0.5 without any).
Repeated rows give repeated results; an empty table gives an empty one. Words are runs of letters, digits and non-ASCII characters, A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BYTES, as_bytes, fold, parts, stored, with_id

START = b" "
#: The grid that the labelled texts kept from counting choose from: discounts of words and of pairs, exponents of the mean; on equal losses the first.
WORD_DISCOUNTS, PAIR_DISCOUNTS, EXPONENTS = (1.5, 1.0, 2.0), (4.0, 8.0, 2.0), (3.0, 2.0, 4.0, 1.0, 0.0)
#: What is added to both counts where these limit a ratio, from the same grid.
EVIDENCE = (8.0, 2.0, 0.0)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def seen_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different triples of adjacent words and the classes they stand in (0 or 1 each), from (y, text)."""
    for part in parts(batches):
        seen: dict[tuple[bytes, bytes, bytes], int] = {}
        for y, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            words = words_of(raw)
            for k in set(zip([START, START, *words], [START, *words], words, strict=False)):
                seen[k] = seen.get(k, 0) | 1 << y
        columns = [pa.array([k[i] for k in seen], pa.binary()) for i in range(3)]
        columns += [pa.array([v >> c & 1 for v in seen.values()], pa.int64()) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["ahead", "before", "word", "n0", "n1"])


@dataclass
class Counts:
    """What the models are made of. words and pairs that outlive the least discount with their counts by class; shared: a word's contexts over both classes;
    of all words: total (counts by class), lost (by discount of words, the mass it takes from both), shared_total, different; follow: by preceding word of a
    kept pair, the counts of all its pairs by class."""

    words: list[bytes]
    contexts: np.ndarray
    shared: np.ndarray
    total: np.ndarray
    lost: dict[float, float]
    shared_total: float
    different: int
    follow: dict[bytes, np.ndarray]
    before: list[bytes]
    after: list[bytes]
    pairs: np.ndarray


def _shares(kept: np.ndarray) -> np.ndarray:
    """Columns over their sums; zeros stay."""
    return kept / np.where(kept.sum(0) > 0, kept.sum(0), 1)


def _within(ratio: np.ndarray, counts: np.ndarray, evidence: float) -> np.ndarray:
    """Log ratios held within what counts by class bear out; evidence 0: as they are."""
    if not evidence or not len(ratio):
        return ratio
    most = np.log((counts.max(1) + evidence) / (counts.min(1) + evidence))
    return np.clip(ratio, -most, most)


class KneserNey:
    """Log-likelihood ratios of words and word pairs, toxic against ordinary, ready for lookup."""

    def __init__(self, counts: Counts, numbers: dict[bytes, int], word_discount: float, pair_discount: float, evidence: float = 0.0):
        """numbers: counts.words, numbered from 0; others count as unknown. evidence: limits ratios, 0 doesn't."""
        self.numbers = numbers
        v = len(numbers)
        unknown, start = v, v + 1
        base = (np.append(counts.shared, 0) + 0.5) / (counts.shared_total + 0.5 * (counts.different + 1))
        kept = np.maximum(np.vstack([counts.contexts, [[0, 0]]]) - word_discount, 0)
        weight = np.where(kept.sum(0) > 0, counts.lost[word_discount] / max(1.0, counts.total.sum()), 1.0)
        word = (1 - weight) * _shares(kept) + weight * base[:, None]  # P(word | class)
        self.word = np.log(word[:, 1] / word[:, 0])
        self.word[(kept == 0).all(1)] = 0.0
        self.word = _within(self.word, np.vstack([counts.contexts, [[0, 0]]]), evidence)
        first = np.array([start if b == START else numbers.get(b, -1) for b in counts.before], np.int64)
        second = np.array([numbers.get(w, -1) for w in counts.after], np.int64)
        pair = np.maximum(counts.pairs - pair_discount, 0).reshape(-1, 2)
        some = (first >= 0) & (second >= 0) & (pair > 0).any(1)
        first, second, pair, heads = first[some], second[some], pair[some], [b for b, k in zip(counts.before, some.tolist(), strict=True) if k]
        found = counts.pairs.reshape(-1, 2)[some]
        taken = np.stack([np.bincount(first, pair[:, c], v + 2) for c in (0, 1)], 1)
        seen = np.zeros((v + 2, 2))
        for at, b in zip(first.tolist(), heads, strict=True):
            seen[at] = counts.follow[b]
        weight = np.where(taken > 0, (1 - taken.sum(1) / np.maximum(1, seen.sum(1)))[:, None], 1.0)  # of the backoff from a preceding word
        self.backoff = _within(np.log(weight[:, 1] / weight[:, 0]), seen, evidence)
        both = (1 - weight[first]) * pair / np.where(taken[first] > 0, taken[first], 1) + weight[first] * word[second]
        keys = first * (v + 2) + second
        order = np.argsort(keys)
        ratio = self.word[second] + _within(np.log(both[:, 1] / both[:, 0]) - self.word[second], found, evidence)
        self.keys, self.pair = keys[order], ratio[order]

    def ratios(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of each word's likelihoods after its predecessor, and the text it stands in."""
        split = [words_of(x) for x in raws]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        v = len(self.numbers)
        get, flat = self.numbers.get, []
        for words in split:
            flat.append(v + 1)
            flat += [get(w, v) for w in words]
        flat = np.array(flat, np.int64)
        first, second = flat[:-1], flat[1:]
        inner = second != v + 1
        first, second = first[inner], second[inner]
        value = self.backoff[first] + self.word[second]
        if len(self.keys):
            keys = first * (v + 2) + second
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            value[found] = self.pair[at[found]]
        return value, np.repeat(np.arange(len(raws)), lengths)

    def means(self, raws: list[bytes], exponents: tuple[float, ...]) -> np.ndarray:
        """By text and exponent, the log of the power mean of its words' ratios; 0 without words."""
        value, row = self.ratios(raws)
        n = np.maximum(1, np.bincount(row, minlength=len(raws)))
        out = np.zeros((len(raws), len(exponents)))
        some = np.unique(row)
        for k, t in enumerate(exponents):
            if t:
                out[some, k] = np.log((np.bincount(row, np.exp(np.clip(t * value, -500, 500)), len(raws)) / n)[some]) / t
            else:
                out[:, k] = np.bincount(row, value, len(raws)) / n
        return out


class Detector:
    """A model and the logistic line over its means; without a model a constant."""

    def __init__(self, model: KneserNey | None, exponent: float, slope: float, offset: float):
        self.model, self.exponent, self.slope, self.offset = model, exponent, slope, offset

    def score(self, raws: list[bytes]) -> np.ndarray:
        x = self.model.means(raws, (self.exponent,))[:, 0] if self.model else np.zeros(len(raws))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, slightly ridged."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (weight * (y - p)) - 1e-2 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def bounded_sample(docs: DataFrame, known: DataFrame, sample_rows: int, sample_bytes: int) -> DataFrame:
    """doc_id, y, text, line (kept from counting); known: doc_id, y. The limits hold for each class."""
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 x sample_rows ids
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(picked, "doc_id").filter(F.col("size") <= sample_bytes)
    in_turn = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sizes.withColumn("so_far", F.sum("size").over(in_turn)).filter(F.col("so_far") <= sample_bytes).select("doc_id", "y").distinct()
    return docs.join(F.broadcast(held), "doc_id").withColumn("line", F.pmod(F.xxhash64("doc_id", F.lit("line")), F.lit(4)) == 0)


def counted(sample: DataFrame) -> Counts:
    """sample: y, text."""
    triples = sample.select("y", "text").mapInArrow(seen_triples, "ahead binary, before binary, word binary, n0 long, n1 long")
    triples = triples.groupBy("ahead", "before", "word").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    pairs = stored(triples.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-pairs")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    words = stored(pairs.groupBy("word").agg(seen("n0"), seen("n1"), F.count("*").alias("contexts")), "toxicity-words")
    lost = [F.sum(F.least("n0", F.lit(d)) + F.least("n1", F.lit(d))).alias(f"lost{k}") for k, d in enumerate(WORD_DISCOUNTS)]
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "contexts")], F.count("*").alias("v"), *lost).first()
    most = F.greatest("n0", "n1")
    some = words.filter(most > min(WORD_DISCOUNTS)).toArrow()
    kept = pairs.filter(most > min(PAIR_DISCOUNTS)).toArrow()
    follow = pairs.groupBy("before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max(most).alias("most")).filter(F.col("most") > min(PAIR_DISCOUNTS)).toArrow()
    by_class = lambda t: np.stack([t.column(c).to_numpy() for c in ("n0", "n1")], 1).astype(float)
    return Counts(
        some.column("word").to_pylist(), by_class(some), some.column("contexts").to_numpy().astype(float),
        np.array([total["n0"], total["n1"]], float), {d: total[f"lost{k}"] or 0.0 for k, d in enumerate(WORD_DISCOUNTS)}, float(total["contexts"]), total["v"],
        dict(zip(follow.column("before").to_pylist(), by_class(follow), strict=True)), kept.column("before").to_pylist(), kept.column("word").to_pylist(), by_class(kept),
    )


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 4_000, sample_bytes: int = 64 << 20, id_col: str = "doc_id") -> Detector:
    """docs: doc_id, text of the training documents."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        p = np.clip(next(iter(total), 0.5), 1e-6, 1 - 1e-6)
        return Detector(None, 0.0, 0.0, float(np.log(p / (1 - p))))
    sample = stored(bounded_sample(docs, known, sample_rows, sample_bytes), "toxicity-sample")
    counts = counted(sample.filter("not line"))
    numbers = {w: i for i, w in enumerate(counts.words)}
    return chosen(sample.filter("line"), [KneserNey(counts, numbers, w, p, e) for e in EVIDENCE for w in WORD_DISCOUNTS for p in PAIR_DISCOUNTS], total)


def chosen(sample: DataFrame, models: list[KneserNey], total: dict[int, int]) -> Detector:
    """The model and exponent with the least loss on the sample (y, text), and the line fitted there; each class weighs as its labels do."""
    sent = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            raws = as_bytes(part.column(1))
            found = np.concatenate([m.means(raws, EXPONENTS) for m in sent.value], 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], ["y", "means"])

    got = sample.select("y", "text").mapInArrow(run, "y int, means array<double>").toArrow()  # a few numbers a row of the bounded sample
    y = got.column("y").to_numpy().astype(np.int64)
    return least_loss(y, np.array(got.column("means").to_pylist()).reshape(len(y), len(models), len(EXPONENTS)), models, total)


def least_loss(y: np.ndarray, means: np.ndarray, models: list, total: dict[int, int]) -> Detector:
    """means: by text, model and exponent. The line is fitted to means held between the lower quartile of ordinary and the upper one of toxic texts: a few
    texts of either class whose means are far out would else flatten the line of every exponent that they show in."""
    held = np.bincount(y, minlength=2)
    if not held.all():
        return Detector(models[0], EXPONENTS[0], 4.0, -4.0)
    weight = np.array([total[k] / held[k] for k in (0, 1)])[y]
    weight *= len(y) / weight.sum()
    best = None
    for i, model in enumerate(models):
        for k, exponent in enumerate(EXPONENTS):
            low, high = np.sort([np.quantile(means[y == 0, i, k], 0.25), np.quantile(means[y == 1, i, k], 0.75)])
            x = np.clip(means[:, i, k], low, high)
            slope, offset = logistic(x, y, weight)
            z = np.clip(slope * x + offset, -50, 50)
            loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
            if best is None or loss < best[0] - 1e-9:
                best = loss, Detector(model, exponent, slope, offset)
    return best[1]


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, threshold: float = 0.5, sample_rows: int = 4_000, sample_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Labels teach only from rows outside the held-out fold; nothing of docs is shuffled but ids."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    detector = train(rows.filter(~F.col("held_out")).select("doc_id", "text"), labels, label, sample_rows, sample_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(detector)  # within the bounded sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            score = sent.value.score(as_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, with_id(rows, "held_out boolean, score double, predicted int"))
