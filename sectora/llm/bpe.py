"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut where the tokenizer's pattern cuts it; each piece starts as its bytes. The leaves of a segment tree hold, for every position, the rank of
the pair that starts there (joined with the position, so the smaller of two equal ranks is the one further left); every inner node holds the smaller of
its children. The root is thus the leftmost lowest-rank merge. A merge changes three leaves, each updated along its path to the root, until the root says
that no mergeable pair remains. Short pieces, nearly all of a text, are run in step as rows of one numpy array of trees; long ones get a tree of their own.

Pieces are looked up in a cache first. The cache is bounded (`cache_entries`) and only saves time.

Nulls and empty texts have no tokens; their decoded text is empty. Repeated rows give repeated results. Lone surrogates can't occur in a Spark string.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import parts, texts

#: The piece pattern of byte-level BPE, a fixed value; white space as Unicode's White_Space property has it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of up to this many bytes are merged in step; longer ones alone.
IN_STEP = 64
NONE = np.int64(1) << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: bounded by the file, whatever the corpus."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(alphabet)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.first = np.array([ids[c] for c in alphabet], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        self.rank_of = {(a, b): r for r, (a, b) in reversed([*enumerate(zip(left.tolist(), right.tolist()))])}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)


def merge_alone(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The tokens of one piece, by a segment tree of its own; O(n log n) for n bytes."""
    n = len(piece)
    token = [int(vocabulary.first[b]) for b in piece]
    rank_of, into = vocabulary.rank_of, vocabulary.into
    none, width = 1 << 62, 1
    while width < n:
        width *= 2
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = rank_of.get((token[i], token[i + 1]))
        if r is not None:
            tree[width + i] = r * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
            i >>= 1

    def pair(i: int) -> int:
        r = rank_of.get((token[i], token[after[i]])) if after[i] >= 0 else None
        return none if r is None else r * width + i

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        token[i], token[j] = int(into[rank]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [t for t in token if t >= 0]


def merge_in_step(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The tokens of short pieces, as packed 32-bit ids: each row of the arrays is a piece with its own tree; a round takes every live row's root."""
    out: list[bytes] = [b""] * len(pieces)
    widths: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        widths.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
    for width, rows in widths.items():
        for at in range(0, len(rows), 1 << 15):
            some = rows[at : at + (1 << 15)]
            for k, ids in zip(some, _trees([pieces[k] for k in some], width, vocabulary), strict=True):
                out[k] = ids
    return out


def _trees(pieces: list[bytes], width: int, v: Vocabulary) -> Iterator[bytes]:
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    token = np.where(place < lengths[:, None], v.first[raw], -1)
    tree = np.full((n, 2 * width), NONE)
    ranks = v.pair_ranks(token[:, :-1], token[:, 1:])
    tree[:, width : 2 * width - 1] = np.where(ranks < NONE, ranks * width + place[:-1], NONE)
    for i in range(width - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
    after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    after[after >= lengths[:, None]] = -1

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[rows, i]
        r = v.pair_ranks(token[rows, i], np.where(j >= 0, token[rows, j], -1))
        return np.where(r < NONE, r * width + i, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        rank, i = np.divmod(tree[rows, 1], width)
        j = after[rows, i]
        token[rows, i], token[rows, j] = v.into[rank], -1
        beyond = after[rows, j]
        after[rows, i] = beyond
        more = beyond >= 0
        before[rows[more], beyond[more]] = i[more]
        put(rows, j, np.full(len(rows), NONE))
        put(rows, i, pair(rows, i))
        lead = before[rows, i]
        some = lead >= 0
        if some.any():
            put(rows[some], lead[some], pair(rows[some], lead[some]))
        rows = rows[tree[rows, 1] < NONE]
    kept = token >= 0
    flat, ends = token[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
    start = 0
    for end in ends:
        yield flat[start:end]
        start = end


#: A space that white space or nothing follows: only around these can a cut before a space be wrong.
ODD_SPACE = re.compile(r" [\s\x85]| \Z")


class Codec:
    """Encodes and decodes texts; keeps the ids of chunks it has seen, at most about cache_entries of them."""

    def __init__(self, vocabulary: Vocabulary, cache_entries: int = 400_000):
        self.v, self.most = vocabulary, cache_entries
        self.whole: dict[str, bytes] = {}  # chunks as they stand
        self.spaced: dict[str, bytes] = {}  # chunks by what follows their leading space
        self.piece = regex.compile(PIECE)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """The text as chunks that the pattern always parts: some as they stand, then some without the space they begin with.

        The pattern cuts before each space that something other than white space follows."""
        found = text.split(" ")
        if not ODD_SPACE.search(text):
            return found[:1], found[1:]
        joined: list[str] = [found[0]]
        for x in found[1:]:
            if x and not x[0].isspace() and x[0] != "\x85":
                joined.append(" " + x)
            else:
                joined[-1] += " " + x
        return joined, []

    def _with_specials(self, text: str) -> tuple[list[str], list[str]]:
        """As _cut, with the special tokens' strings as chunks of their own; `whole` always has these."""
        out: list[str] = []
        start = 0
        for m in self.special.finditer(text):
            out += [*self._chunks(text[start : m.start()]), m[0]]
            start = m.end()
        return out + self._chunks(text[start:]), []

    def _chunks(self, text: str) -> list[str]:
        as_is, spaced = self._cut(text) if text else ([], [])
        return [*as_is, *(" " + x for x in spaced)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self.whole) + len(self.spaced) > self.most:
            self.whole.clear()
            self.spaced.clear()
        for token, i in self.v.added.items():
            self.whole[token] = i.to_bytes(4, "little")
        cut = [self._with_specials(x) if self.special and any(s in x for s in self.v.added) else self._cut(x) for x in batch]
        self._learn(set().union(*(c[0] for c in cut)), self.whole, "")
        self._learn(set().union(*(c[1] for c in cut)), self.spaced, " ")
        whole, spaced = self.whole.__getitem__, self.spaced.__getitem__
        return [b"".join([*map(whole, a), *map(spaced, b)]) for a, b in cut]

    def _learn(self, chunks: set[str], known: dict[str, bytes], lead: str) -> None:
        """Adds the ids of chunks that aren't known."""
        new = [x for x in chunks if x not in known]
        if not new:
            return
        findall = self.piece.findall
        pieces = [[p.encode() for p in findall(lead + x)] for x in new]
        short = list({p for row in pieces for p in row if len(p) <= IN_STEP})
        ids = dict(zip(short, merge_in_step(short, self.v), strict=True))
        for x, row in zip(new, pieces, strict=True):
            known[x] = b"".join([ids[p] if len(p) <= IN_STEP else np.array(merge_alone(p, self.v), "<u4").tobytes() for p in row])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer_path: str, digest: Callable[[list[int | None], list[bytes], list[str]], pa.RecordBatch] | None = None, schema: str = "doc_id long, ids array<int>, decoded string", id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 400_000) -> DataFrame:
    """Per row of docs its token ids and the text decoded from them (doc_id, ids, decoded), or what `digest` makes of a batch of them under `schema`.

    The tokenizer file is read on the driver only; its tables, of a size the file fixes, are broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    spec = {"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec.get("added_tokens", [])}
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(sent.value), cache_entries)
        for part in parts(batches):
            ids = codec.encode(part.column(1).to_pylist())
            decoded = [codec.decode(x) for x in ids]
            yield (digest or full)(part.column(0).to_pylist(), ids, decoded)

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def full(doc_ids: list[int | None], ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
