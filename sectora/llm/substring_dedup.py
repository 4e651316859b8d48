"""Substring deduplication by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the first of the `gram`-word sequences inside it, rare ones before frequent ones and by hash among
the like: sequences are counted over all texts first, in `SLOTS` slots by hash, and each slot gets a tier by how far it is above the mean. A frequent
sequence so draws only windows that hold nothing rarer, not a fixed share of the corpus. Consecutive windows of a document that share a minimiser form a super-k-mer and travel as one packed string to the bucket of that minimiser, so equal windows meet in one bucket while each
word is moved only about three times instead of once per window. In a bucket the windows are sorted (by a rolling hash; windows that share a hash are
compared byte by byte) and the smallest id of each is found.

Combining before the shuffle: within a run of rows, windows that a smaller id of the same run has too are decided on the spot and aren't sent. A passage
that stands in a third of all documents thus reaches its bucket once per run, not once per document. Decided windows ride along as word spans.

Packed strings of one run and bucket are one zstd-compressed row; the number of buckets follows the size of the input, so a bucket is about
`bucket_bytes` of text whatever the corpus. Spans come back by document (ids, plus a hash of the text where ids repeat) and are joined to the texts.

Nulls: a null text has no words; a row with a null id loses nothing and takes nothing from others. Rows that repeat an id don't take from each other, as
neither id is smaller. Texts shorter than a window lose nothing. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, parts, texts

#: Slots that word sequences are counted in, and tiers of slots: each holds those twice as frequent as the one before.
SLOTS, TIERS = 1 << 16, 16
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPANS = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4")])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, and well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k consecutive entries; by doubling, so in log k passes."""
    power, done, out, size = np.array([P2]), None, h, 1  # an array, as its products are meant to overflow
    total = 0
    while True:
        if k & size:
            if done is None:
                done, total = out, size
            else:  # `done` covers the `total` entries from its place on; append the next `size`
                n = len(h) - total - size + 1
                done = done[:n] * power + out[total : total + n]
                total += size
            if total == k:
                return done
        n = len(out) - size
        if n <= 0:
            return h[:0]
        out = out[:n] * power + out[size : size + n]
        power = power * power
        size *= 2


#: Words of more bytes than this are hashed one by one.
LONG_WORD, PIECE = 4096, 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _powers(of: int) -> np.ndarray:
    """1, of, of squared and so on, modulo 2^64."""
    factors = np.full(PIECE + LONG_WORD + 1, of, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS, _INVERSE = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """text: words, each followed by one space. The place of each word's first byte (and the end of the text), and a 64-bit hash of each word.

    A word's hash is a polynomial in its bytes, cut from the running sum over a piece of the text, so no word is handled by itself."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 32)
    place = np.concatenate(([0], ends + 1))
    out = np.zeros(len(ends), np.uint64)
    for w in np.flatnonzero(ends - place[:-1] > LONG_WORD).tolist():
        out[w] = xxhash.xxh64_intdigest(text[place[w] : ends[w]])
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, place[first] + PIECE)))
        low, high = int(place[first]), int(ends[last - 1])
        if high - low <= PIECE + LONG_WORD:
            total = np.concatenate(([np.uint64(0)], np.cumsum((raw[low:high] + np.uint64(1)) * _POWERS[: high - low])))
            a, b = place[first:last] - low, ends[first:last] - low
            out[first:last] = np.where(b - a > LONG_WORD, out[first:last], (total[b] - total[a]) * _INVERSE[a])
        first = last
    return place, mixed(out)


def later_windows(text: bytes, place: np.ndarray, digest: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For windows starting at the words `at` (in documents `doc`): whether a window with the same words starts in a document with a smaller id."""
    if not len(at):
        return np.zeros(0, bool)
    width = np.uint64(max(1, int(len(at) - 1).bit_length()))
    key = mixed(rolling(digest, k)[at]) >> width << width | np.arange(len(at), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    key >>= width
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(at)))
    several = np.repeat(sizes > 1, sizes)
    out = np.zeros(len(at), bool)
    if not several.any():
        return out
    members, sizes = order[several], sizes[sizes > 1]
    docs, starts = doc[members], np.cumsum(sizes) - sizes
    out[members] = docs > np.repeat(np.minimum.reduceat(docs, starts), sizes)
    words = [text[a:b] for a, b in zip(place[at[members]].tolist(), place[at[members] + k].tolist(), strict=True)]
    lead = np.repeat(starts, sizes).tolist()
    unlike = [i for i, j in enumerate(lead) if words[i] != words[j]]
    if unlike:  # different windows with one hash: those groups are taken apart by their words
        group = np.repeat(np.arange(len(sizes)), sizes)
        for g in np.unique(group[unlike]):
            some = np.flatnonzero(group == g)
            least: dict[bytes, int] = {}
            for i in some:
                least[words[i]] = min(least.get(words[i], docs[i]), docs[i])
            out[members[some]] = [docs[i] > least[words[i]] for i in some]
    return out


def runs(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of maximal runs of set flags without a break inside; breaks[i] parts i-1 from i."""
    before = np.concatenate(([False], flag[:-1]))
    begins = flag & (~before | breaks)
    after = np.concatenate((flag[1:], [False]))
    ends = flag & (~after | np.concatenate((breaks[1:], [True])))
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, as differences for zstd to shorten."""
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype), dtype=dtype)


def ranks(digest: np.ndarray, gram: int, tiers: np.ndarray) -> np.ndarray:
    """The order of minimisers: of the `gram` words from each place on, the tier and then the hash."""
    code = mixed(rolling(digest, gram))
    return tiers[code >> np.uint64(48)] << np.uint64(60) | code & np.uint64((1 << 60) - 1)


def slot_counts(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """slot, n of the word sequences of a column of texts."""
    total = np.zeros(SLOTS, np.int64)
    for part in parts(batches):
        text = b" ".join(filter(None, (b" ".join(x.split()) for x in as_bytes(part.column(0))))) + b" "
        if len(text) > 1:
            code = mixed(rolling(word_hashes(text)[1], gram))
            total += np.bincount((code >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def slot_tiers(docs: DataFrame, gram: int) -> np.ndarray:
    """The tier of each slot; docs: text. At most SLOTS sums reach the driver."""
    counts = docs.select("text").mapInArrow(lambda batches: slot_counts(batches, gram), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS)
    n[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    above = np.maximum(n, 1) / max(1.0, n.mean())
    return np.clip(np.ceil(np.log2(above)), 0, TIERS - 1).astype(np.uint64)


def super_kmers(doc_ids: list, keys: list, raws: list[bytes], window: int, gram: int, buckets: int, tiers: np.ndarray) -> tuple[list[tuple[int, bytes, bytes]], np.ndarray]:
    """Rows (bucket, packed strings, their places) for a run of documents, and the spans decided within the run."""
    order = sorted((i for i, d in enumerate(doc_ids) if d is not None), key=lambda i: doc_ids[i])
    plain = [b" ".join(raws[i].split()) for i in order]
    lengths = np.array([x.count(b" ") + 1 if x else 0 for x in plain], np.int64)
    text = b" ".join(filter(None, plain)) + b" "
    n = int(lengths.sum()) - window + 1
    if n <= 0:
        return [], np.zeros(0, SPANS)
    place, digest = word_hashes(text)
    row = np.repeat(np.arange(len(order), dtype=np.int32), lengths)
    doc, key = np.array([doc_ids[i] for i in order], np.int64), np.array([keys[i] for i in order], np.int64)
    first = np.cumsum(lengths) - lengths
    inside = row[:n] == row[window - 1 :]
    at = np.flatnonzero(inside)
    later = np.zeros(n, bool)
    later[at] = later_windows(text, place, digest, at, doc[row[at]], window)
    new_row = np.concatenate(([True], row[1:n] != row[: n - 1]))
    a, b = runs(later, new_row)
    spans = np.zeros(len(a), SPANS)
    spans["doc"], spans["key"], spans["start"], spans["end"] = doc[row[a]], key[row[a]], a - first[row[a]], b - 1 + window - first[row[a]]
    # super-k-mers of the windows that are left
    low = ranks(digest, gram, tiers)
    reach, have = window - gram + 1, 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    a, b = runs(inside & ~later, new_row | np.concatenate(([True], low[1:n] != low[: n - 1])))
    if not len(a):
        return [], spans
    bucket = (mixed(low[a] + P1) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    a, b, bucket = a[by], b[by] + window - 1, bucket[by]
    cut = [text[x:y] for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True)]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    pack = zstandard.ZstdCompressor(level=5).compress
    out = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        r = row[a[x:y]]
        places = _packed(doc[r]) + _packed(key[r]) + (a[x:y] - first[r]).astype("<i4").tobytes() + (b[x:y] - a[x:y]).astype("<i4").tobytes()
        out.append((int(bucket[x]), pack(b"".join(cut[x:y])), pack(places)))
    return out, spans


def bucket_spans(strings: list[bytes], places: list[bytes], window: int) -> np.ndarray:
    """Spans of the windows of a bucket's packed strings that a smaller id has too."""
    unpack = zstandard.ZstdDecompressor().decompress
    docs, keys, starts, counts = [], [], [], []
    for p in places:
        raw = unpack(p)
        n = len(raw) // 24
        docs.append(_unpacked(raw[: 8 * n], "<i8"))
        keys.append(_unpacked(raw[8 * n : 16 * n], "<i8"))
        starts.append(np.frombuffer(raw[16 * n : 20 * n], "<i4"))
        counts.append(np.frombuffer(raw[20 * n :], "<i4"))
    if not docs:
        return np.zeros(0, SPANS)
    text = b"".join(map(unpack, strings))
    place, digest = word_hashes(text)
    doc, key, start, count = map(np.concatenate, (docs, keys, starts, counts))
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    n = len(row) - window + 1
    inside = row[:n] == row[window - 1 :]
    at = np.flatnonzero(inside)
    later = np.zeros(n, bool)
    later[at] = later_windows(text, place, digest, at, doc[row[at]], window)
    a, b = runs(later, np.concatenate(([True], row[1:n] != row[: n - 1])))
    first = (np.cumsum(count) - count)[row[a]]
    spans = np.zeros(len(a), SPANS)
    spans["doc"], spans["key"], spans["start"], spans["end"] = doc[row[a]], key[row[a]], start[row[a]] + (a - first), start[row[a]] + (b - 1 - first) + window
    return spans


def repeated_spans(docs: DataFrame, window: int = 13, gram: int = 2, bucket_bytes: int = 10 << 20, run_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, key, spans (array of packed [start, end) word numbers as binary) of rows (doc_id, text, key) that have repeated windows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-3 * size // bucket_bytes))
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    tiers = docs.sparkSession.sparkContext.broadcast(slot_tiers(docs, gram))  # SLOTS numbers

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for part in parts(gathered(batches, run_bytes), run_bytes):
            rows, spans = super_kmers(part.column(0).to_pylist(), part.column(2).to_pylist(), as_bytes(part.column(1)), window, gram, buckets, tiers.value)
            if len(spans):  # decided already: they ride along, to any bucket
                turn += 1
                rows.append(((int(spans["doc"][0]) + turn) % buckets, b"", spans.tobytes()))
            for at in range(0, len(rows), 256):
                b, s, p = zip(*rows[at : at + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.binary()), pa.array(p, pa.binary())], ["bucket", "strings", "places"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sent = [len(s) == 0 for s in group["strings"]]
        some = [(s, p) for s, p, decided in zip(group["strings"], group["places"], sent, strict=True) if not decided]
        found = bucket_spans([s for s, _ in some], [p for _, p in some], window)
        found = np.concatenate([found, *(np.frombuffer(p, SPANS) for p, decided in zip(group["places"], sent, strict=True) if decided)])
        found = found[np.lexsort((found["start"], found["key"], found["doc"]))]
        edges = np.flatnonzero(np.concatenate(([True], (found["doc"][1:] != found["doc"][:-1]) | (found["key"][1:] != found["key"][:-1]), [True]))) if len(found) else np.zeros(1, np.int64)
        pairs = np.stack([found["start"], found["end"]], 1).astype("<i4")
        lead = edges[:-1]
        return pd.DataFrame({"doc_id": found["doc"][lead], "key": found["key"][lead], "spans": [pairs[a:b].tobytes() for a, b in zip(lead.tolist(), edges[1:].tolist(), strict=True)]})

    dealt = docs.select("doc_id", "text", "key").mapInArrow(deal, "bucket int, strings binary, places binary")
    found = dealt.groupBy("bucket").applyInPandas(meet, "doc_id long, key long, spans binary")
    return found.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to about most_bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def covered(n: int, spans: list[bytes] | None) -> np.ndarray:
    """Which of n words lie in a span."""
    if not spans:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 2, id_col: str = "doc_id", text_col: str = "text", row: Callable | None = None, schema: str = "doc_id long, n_words long, n_removed long, text string", bucket_bytes: int = 10 << 20, run_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and the words that stay, joined by one space; or what `row(doc_ids, n_words, n_removed, kept)`
    makes of a batch under `schema`."""
    rows = texts(docs, id_col, text_col)
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null")
    rows = rows.withColumn("key", F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text"))
    spans = repeated_spans(rows, window, gram, bucket_bytes, run_bytes)
    joined = rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            split = [x.split() for x in as_bytes(part.column(1))]
            gone = [covered(len(w), s) for w, s in zip(split, part.column(2).to_pylist(), strict=True)]
            kept = [b" ".join([w for w, g in zip(ws, c.tolist(), strict=True) if not g] if c.any() else ws) for ws, c in zip(split, gone, strict=True)]
            yield (row or whole)(part.column(0), [len(w) for w in split], [int(c.sum()) for c in gone], kept)

    return joined.mapInArrow(apply, schema)


def whole(doc_ids: pa.Array, n_words: list[int], n_removed: list[int], kept: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept])], ["doc_id", "n_words", "n_removed", "text"])
