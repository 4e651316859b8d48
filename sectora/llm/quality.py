"""Quality classifier: histogram gradient-boosted trees over document statistics.

`statistics` makes one fixed-length vector per whole text. `fit` bins each statistic at quantiles and grows trees level by level from histograms of
gradients. The labelled sample it is given is bounded (`labelled_sample`: at most `fit_rows` rows of each class, those whose id hashes lowest; weights
restore the classes' true shares), so fitting runs on the driver. The trees are then flattened into arrays (heap order, every tree equally deep) that numpy
walks for a whole batch at once.

Nulls and empty texts have all-zero statistics and are scored like any other. Labels that are null, or whose document is missing, teach nothing. Without
labels of both classes the score is the share of good labels (0.5 where there are none). Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .common import as_bytes, fold, parts, stored

NAMES = (
    "log_bytes log_words mean_word_length log_longest_word upper_share digit_share space_share newline_share high_byte_share control_share stop_share comma_share "
    "other_mark_share bracket_share bar_share bang_share distinct_word_share top_word_share same_as_before_share distinct_line_share log_mean_line byte_entropy "
    "capital_word_share mark_end_share"
).split()
_BYTES = np.arange(256)
_CLASSES = np.zeros((256, 12))
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
for _k, _members in enumerate(
    [range(65, 91), range(48, 58), [32], [10], range(128, 256), [*range(9), *range(11, 32), 127], [46, 63], [44], [b for b in _MARKS if chr(b) not in ".?,()[]{}<>|!"], [ord(c) for c in "()[]{}<>"], [124], [33]]
):
    _CLASSES[list(_members), _k] = 1


def statistics(raw: bytes) -> np.ndarray:
    """The vector of NAMES for a UTF-8 text."""
    out = np.zeros(len(NAMES), np.float32)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    share = counts / len(raw)
    out[0] = np.log1p(len(raw))
    out[4:16] = share @ _CLASSES
    used = share[share > 0]
    out[21] = -(used * np.log2(used)).sum()
    lines = raw.split(b"\n")
    out[19], out[20] = len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines))
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        seen = Counter(words)
        out[1:4] = np.log1p(n), lengths.mean(), np.log1p(lengths.max())
        out[16], out[17] = len(seen) / n, max(seen.values()) / n
        out[18] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[22] = sum(map(bytes.isupper, words)) / n
        out[23] = len([w for w in words if w[-1] < 128 and not w[-1:].isalnum()]) / n
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """docs with an array<float> column of the document statistics."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = np.stack([statistics(x) for x in as_bytes(part.column(at))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(NAMES)), pa.int32()), pa.array(found.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(FloatType()))]))


@dataclass
class Trees:
    """Flattened trees of one depth: node k of a tree has children 2k+1 and 2k+2; a value above its threshold goes to the second."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x."""
        total = np.full(len(x), self.base)
        if len(x):
            rows = np.arange(len(x))
            for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
                total += value[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for the log-odds of y (0 or 1). least: the smallest number of rows on each side of a split."""
    weight = np.ones(len(y)) if weight is None else weight
    total = weight.sum()
    share = float(np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)) if total else 0.5
    if len(np.unique(y)) < 2:
        none = np.zeros((0, 1))
        return Trees(float(np.log(share / (1 - share))), depth, none.astype(np.int64), none, none)
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for k in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    leaves, inner = 1 << depth, (1 << depth) - 1
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    columns = np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            slot = (node[:, None] * (f * bins) + columns + binned).ravel()
            hist = np.stack([np.bincount(slot, np.repeat(v, f), nodes * f * bins).reshape(nodes, f, bins) for v in (g, h, np.ones(n))])
            left = hist.cumsum(-1)
            whole = left[..., -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[2] < least) | (right[2] < least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            feature, cut = np.divmod(best, bins)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            for k in np.flatnonzero(good):
                features[t, first + k], thresholds[t, first + k] = feature[k], cuts[feature[k]][cut[k]]
            node = 2 * node + (good[node] & (binned[np.arange(n), feature[node]] > cut[node]))
        sums = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        values[t] = -rate * sums[0] / (sums[1] + ridge)
        margin += values[t][node]
    return Trees(base, depth, features, thresholds, values)


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, fit_rows: int, columns: list[str], id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most fit_rows rows of each class, with y, and how many labelled rows each class has. rows: doc_id and columns, training documents only."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])
    joined = rows.select("doc_id", *columns).join(known, "doc_id")
    counts = {r["y"]: r["n"] for r in joined.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [joined.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    return picked[0].union(picked[1]), counts


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 10_000, **params) -> Trees:
    """Trees from the labelled training rows (doc_id, statistics)."""
    sample, counts = labelled_sample(rows, labels, label, fit_rows, ["statistics"])
    got = sample.select("y", "statistics").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    x = np.array(got.column("statistics").to_pylist(), np.float32).reshape(len(y), len(NAMES))
    held = np.bincount(y, minlength=2)
    weight = np.array([counts.get(k, 0) / max(1, held[k]) for k in (0, 1)])[y] if len(y) else np.zeros(0)
    return fit(x, y, weight * len(y) / max(1, weight.sum()), **params)


def scored(rows: DataFrame, model: Trees, drop: str = "statistics", name: str = "score") -> DataFrame:
    """rows with the model's probability in place of their statistics."""
    at = rows.columns.index(drop)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # arrays of a size that the parameters fix
    fields = [f for f in rows.schema.fields if f.name != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = part.column(at).flatten().to_numpy().reshape(part.num_rows, len(NAMES))
            kept = [c for k, c in enumerate(part.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sent.value.score(x))], [f.name for f in fields] + [name])

    return rows.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, fit_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Labels teach only from rows outside the held-out fold; texts are read once."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = stored(with_statistics(rows).drop("text"), "statistics").withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    model = train(rows.filter(~F.col("held_out")), labels, label, fit_rows)
    return scored(rows, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, fit_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    known = labels.select(labels[id_col].alias("doc_id")).filter("doc_id is not null").distinct()
    teach = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter(fold(F.col("doc_id"), folds) != held)
    teach = stored(with_statistics(teach).drop("text").join(known, "doc_id", "left_semi"), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(train(teach, labels, label, fit_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            score = sent.value.score(np.stack([statistics(x) for x in as_bytes(part.column(at))]))
            yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
