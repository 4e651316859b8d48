"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit word lies within r bits of both. So every distinct fingerprint stands for all its
variants within half the radius, variants are shuffled, and fingerprints that meet on one are verified and linked.

A fingerprint has 2,081 variants for radius 4; they are not moved one by one. Variants are dealt by their leading bits, and those of one fingerprint that go
to the same place travel as the fingerprint: with b leading bits it is sent to 1 + b + b(b-1)/2 places, and each place makes just the variants that
belong there. b follows the number of fingerprints, so that a place holds about `place_variants` variants whatever the input. A place where more meet
(a large group of near copies) is split by k parities of the variant's other bits, as many as it needs. Parities are linear: a fingerprint's variants that
go to one part are those whose mask has the parities of part and fingerprint together, so a part makes just its own variants, and a fingerprint goes only
to parts that it has variants for. All work is in proportion to the variants, whether or not they are near copies of each other.

At a place, variants are sorted; runs of equal ones link their fingerprints after their distance is verified, and a place reports a spanning forest of
its links, never all pairs. Copies share a fingerprint and are one node throughout. Components are found by `components.roots`.

Nulls: a null text is empty; texts without words have fingerprint zero, linked like any other. A null id never becomes a component's id unless
all its ids are null. Repeated rows share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER_ASCII, as_bytes, parts, stored, texts
from .components import roots


#: Tasks that a large component's fingerprints are spread over where they meet its first row.
SALTS = 32


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text over its word shingles, repeats included."""
    words = raw.translate(LOWER_ASCII).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = np.array(hashes[at : at + (1 << 15)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs with a long column: the fingerprint's bits as a signed number."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = np.array([fingerprint(x, shingle, seed) for x in as_bytes(part.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def masks(bits: int, most: int) -> np.ndarray:
    """All words of `bits` bits with at most `most` ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def place_bits(fingerprints: int, half: int, place_variants: int) -> int:
    variants = sum(math.comb(64, k) for k in range(half + 1))
    return min(20, max(4, math.ceil(math.log2(max(1, fingerprints * variants / place_variants)))))


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _parity_tables() -> np.ndarray:
    """For each byte of a word and each of its values, the parities (32 of them) of the bits that are set."""
    x = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)
    out = np.zeros((8, 256), np.uint64)
    for value in range(256):
        for bit in range(8):
            if value >> bit & 1:
                out[:, value] ^= x[bit::8]
    return out


_PARITIES = _parity_tables()


def parities(words: np.ndarray, k: int) -> np.ndarray:
    """k parities of the bits of each word; those of x ^ y are those of x and of y, xored."""
    out = np.zeros(len(words), np.uint64)
    for byte in range(8):
        out ^= _PARITIES[byte][(words >> np.uint64(8 * byte)) & np.uint64(255)]
    return out & np.uint64((1 << k) - 1)


def place_links(fps: np.ndarray, place: int, bits: int, radius: int, part: int = 0, part_bits: int = 0, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints whose variants meet at this place (leading `bits` bits equal to place) in this part (`part_bits` parities of the
    others equal to part), as node, root: a spanning forest."""
    half, low_bits = radius // 2, 64 - bits
    fps = np.unique(fps)
    n = len(fps)
    width = max(1, int(n - 1).bit_length())
    away = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(place))
    low = fps & np.uint64((1 << low_bits) - 1)
    by_distance = [(np.flatnonzero(away == d), masks(low_bits, half - d)) for d in range(half + 1)]
    total = sum(len(i) * len(m) for i, m in by_distance) >> part_bits
    turn_bits = max(0, math.ceil(math.log2(max(1, total / most))))  # a share of the variants at a time, so that memory is bounded however many meet here
    k = part_bits + turn_bits
    own = parities(low, k)
    ranked = []
    for index, mask in by_distance:
        code = parities(mask, k)
        order = np.argsort(code, kind="stable")
        ranked.append((index, mask[order], code[order]))
    us, vs = [], []
    for turn in range(1 << turn_bits):
        target = np.uint64(part | turn << part_bits)
        keys = []
        for index, mask, code in ranked:
            want = own[index] ^ target
            first = np.searchsorted(code, want)
            count = np.searchsorted(code, want, "right") - first
            held = np.repeat(index, count)
            at = np.arange(len(held)) - np.repeat(np.cumsum(count) - count - first, count)
            key = (low[held] ^ mask[at]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            keys.append((key >> np.uint64(width) << np.uint64(width)) | held.astype(np.uint64))
        key = np.sort(np.concatenate(keys))
        group, node = key >> np.uint64(width), (key & np.uint64((1 << width) - 1)).astype(np.int64)
        same = group[1:] == group[:-1]
        a, b = node[:-1][same], node[1:][same]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        us.append(a[near])
        vs.append(b[near])
        for g in np.unique(group[1:][same][~near]):  # unlike variants with one hash: every two of them are compared
            lo, hi = np.searchsorted(group, [g, g + np.uint64(1)])
            members = node[lo:hi]
            for i, m in enumerate(members[:-1]):
                rest = members[i + 1 :]
                rest = rest[np.bitwise_count(fps[rest] ^ fps[m]) <= radius]
                us.append(np.full(len(rest), m))
                vs.append(rest)
        # joined as it goes, so that links don't pile up
        label = _forest(np.concatenate(us), np.concatenate(vs), n)
        linked = np.flatnonzero(label != np.arange(n))
        us, vs = [linked], [label[linked]]
    linked, label = us[0], vs[0]
    return fps[linked].view(np.int64), fps[label].view(np.int64)


def fingerprint_links(fingerprints: DataFrame, column: str = "fingerprint", radius: int = 4, place_variants: int = 2_000_000) -> DataFrame:
    """u, v: links that connect any two of the distinct fingerprints in `column` that differ in at most `radius` bits (directly or over others)."""
    spark = fingerprints.sparkSession
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius is split in two halves: give an even one")
    nodes = fingerprints.filter(F.col(column).isNotNull()).select(F.col(column).alias("fp")).distinct()
    bits = place_bits(nodes.count(), half, place_variants)
    flips = masks(bits, half)
    flipped = np.bitwise_count(flips).astype(np.int64)
    weight = np.array([sum(math.comb(64 - bits, k) for k in range(half - d + 1)) for d in flipped.tolist()], np.int64)

    def places(part: pa.RecordBatch) -> np.ndarray:
        return (np.asarray(part.column(0)).view(np.uint64) >> np.uint64(64 - bits))[:, None] ^ flips

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in batches:
            for at in range(0, part.num_rows, 10_000):
                some = places(part.slice(at, 10_000))
                total += np.bincount(some.ravel().astype(np.int64), np.tile(weight, len(some)), 1 << bits).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "variants"])

    # there are at most 2^20 places, whatever the input
    heavy = nodes.mapInArrow(weigh, "place int, variants long").groupBy("place").agg(F.sum("variants").alias("variants")).filter(F.col("variants") > 4 * place_variants)
    split = spark.sparkContext.broadcast({r["place"]: min(30, math.ceil(math.log2(r["variants"] / (2 * place_variants)))) for r in heavy.collect()})

    def dealt(place: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(fp)], ["place", "part", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_bits = np.zeros(1 << bits, np.int64)
        for place, k in split.value.items():
            split_bits[place] = k
        codes = {(k, d): np.unique(parities(masks(64 - bits, half - d), k)) for k in {*split.value.values()} for d in range(half + 1)}
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                some = batch.slice(at, 10_000)
                place = places(some).ravel().astype(np.int64)
                fp, away = np.repeat(np.asarray(some.column(0)), len(flips)), np.tile(flipped, some.num_rows)
                k = split_bits[place]
                yield dealt(place[k == 0], np.zeros(int((k == 0).sum()), np.int32), fp[k == 0])
                for (parts_bits, d), code in codes.items():
                    rows = np.flatnonzero((k == parts_bits) & (away == d))
                    step = max(1, (1 << 18) // len(code))
                    for first in range(0, len(rows), step):
                        turn = rows[first : first + step]
                        part = parities(fp[turn].view(np.uint64) & np.uint64((1 << (64 - bits)) - 1), parts_bits)[:, None] ^ code
                        yield dealt(np.repeat(place[turn], len(code)), part.ravel(), np.repeat(fp[turn], len(code)))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        place, part = map(int, key)
        u, v = place_links(group["fp"].to_numpy().view(np.uint64), place, bits, radius, part, split.value.get(place, 0))
        return pd.DataFrame({"u": u, "v": v})

    return nodes.mapInArrow(deal, "place int, part int, fp long").groupBy("place", "part").applyInPandas(meet, "u long, v long")


def _hashed(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    rows = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return stored(with_fingerprint(rows, shingle=shingle, seed=seed).select("doc_id", "text_key", "fingerprint"), "fingerprints")


def _components(hashed: DataFrame, radius: int) -> DataFrame:
    """fp and, of its component, the smallest id and the row that comes first (by id, then by hash of the text), for every distinct fingerprint of hashed.

    Sums go from rows to fingerprints to components, so that no join or group holds the rows of a large component together. Joins are merge joins at every size."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = hashed.groupBy(F.col("fingerprint").alias("fp")).agg(first.alias("low"))
    up = roots(fingerprint_links(hashed, radius=radius))
    linked = nodes.join(up.hint("merge"), nodes["fp"] == up["node"]).select("fp", "low", "root")
    tops = nodes.join(up.select(F.col("root").alias("fp")).distinct().hint("merge"), "fp").select("fp", "low", F.col("fp").alias("root"))
    linked = linked.unionByName(tops)
    lowest = linked.groupBy("root").agg(F.min("low").alias("first"))
    # a component may hold a third of all fingerprints: it meets its first row in SALTS tasks
    told = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["root", "salt"])
    placed = nodes.join(told.select("fp", "first").hint("merge"), "fp", "left").select("fp", F.coalesce("first", "low").alias("first"))
    return stored(placed.select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key")), "near-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links, itself included)."""
    hashed = _hashed(docs, id_col, text_col, shingle, seed)
    by_fp = _components(hashed, radius)
    found = hashed.join(by_fp, hashed["fingerprint"] == by_fp["fp"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row with the smallest id; of rows that repeat that id the one
    whose text hashes lowest; of rows that repeat id and text, one. Only ids, hashes and the list of rows to leave out are shuffled by component."""
    hashed = _hashed(docs, id_col, text_col, shingle, seed)
    by_fp = _components(hashed, radius)
    judged = hashed.join(by_fp, hashed["fingerprint"] == by_fp["fp"])
    judged = judged.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    gone = stored(judged.filter("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "near-gone")
    twice = judged.filter("stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    boxed = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    boxed = boxed.select("doc_id", F.xxhash64("text").alias("text_key"), "row")
    # whole rows meet the list of those that go by a merge join: one plan, and one measure of shuffle, for inputs of any size
    kept = boxed.join(gone.hint("merge"), boxed["doc_id"].eqNullSafe(gone["gone_id"]) & (boxed["text_key"] == gone["gone_key"]), "left_anti")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*")
