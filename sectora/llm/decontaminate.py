"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton has one state for each class of item substrings with the same ends. The words of each document are streamed through it: the state and the
longest matching length after each word tell the longest item substring that ends there. Where that length reaches an item's window (`window` words, or
the whole item where it has fewer), the window occurs and its words are hit. Pairs of adjacent words that no item has reset the stream, so only runs of
known pairs as long as the shortest window are followed.

The items are taken in blocks of at most `block_words` words (an item is never parted), each with its own automaton: arrays by state, with dictionaries only for
the states that several words lead on from. One block is built, broadcast and matched at a time: where there are more, each is a pass over the documents
whose hits are stored, and at the end hits (not texts) are put together by document. So driver and workers hold one block whatever the benchmark's size.

Nulls: a null or empty text has no words; a null item_id's windows count as hits but add no id to the list. Repeated items count once by id. Ids may be of
any type. With no items nothing is contaminated; with no documents the result is empty. Other columns are not read by `find_contamination` and are kept by
`decontaminate`.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import WORD_BYTES, as_bytes, parts, stored, texts

#: Hit words as [start, end) word numbers.
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; windows that end in a state are listed by length at that state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        #: by state: the word that leads on and the state it leads to; further ones are in `more`
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [(item, array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])) for item, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(window, len(words)) for _, words in coded), default=0)
        pairs = [np.frombuffer(words, np.int32).astype(np.int64) for _, words in coded]
        self.pairs = np.unique(np.concatenate([x[:-1] * len(self.ids) + x[1:] for x in pairs])) if pairs else np.zeros(0, np.int64)
        self._list_windows(coded, window)

    def _list_windows(self, coded: list, window: int) -> None:
        #: the items' ids; by state: the length of a window that ends there and the item that has it; further ones are in `windows`
        self.items = [item for item, _ in coded]
        self.width, self.item = array("i", [-1]) * len(self.link), array("i", [-1]) * len(self.link)
        self.windows: dict[int, dict[int, set[int]]] = {}
        for number, (_, words) in enumerate(coded):
            state, width = 0, min(window, len(words))
            for at, w in enumerate(words):
                state = self.step(state, w)
                if at + 1 >= width:
                    s = state
                    while self.length[self.link[s]] >= width:
                        s = self.link[s]
                    if self.width[s] < 0:
                        self.width[s], self.item[s] = width, number
                    elif (self.width[s], self.item[s]) != (width, number):
                        self.windows.setdefault(s, {}).setdefault(width, set()).add(number)
        #: by state: the nearest state along the suffix links, itself included, where a window ends
        self.ends = array("i", [-1]) * len(self.link)
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            self.ends[s] = s if self.width[s] >= 0 else self.ends[self.link[s]]

    def step(self, state: int, w: int) -> int:
        """The state that w leads to, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, link: int, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that w leads to from p, cut in two if it also stands for longer strings."""
        q = self.step(p, w)
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.link[q], self.length[p] + 1)
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.step(p, w) == q:
            self._lead(p, w, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if self.step(last, w) >= 0:
            return self._split(last, w)
        new, p = self._state(0, self.length[last] + 1), last
        while p >= 0 and self.step(p, w) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def runs(self, coded: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the runs of words that may hold a window: known words, and known pairs where windows have two words or more."""
        known = coded >= 0
        if self.shortest > 1:
            pair = coded[:-1].astype(np.int64) * len(self.ids) + coded[1:]
            pair[~(known[:-1] & known[1:])] = -1
            known = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + (self.shortest > 1)
        long = stops - starts >= self.shortest
        return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words [start, end), in order and apart from each other, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        get = self.ids.get
        coded = np.array([get(w, -1) for w in words], np.int32)
        word, to, more, link, length, ends, width, item = self.word, self.to, self.more, self.link, self.length, self.ends, self.width, self.item
        for start, stop in self.runs(coded):
            state = matched = 0
            for at, w in enumerate(coded[start:stop].tolist(), start):
                while True:
                    if word[state] == w:
                        state = to[state]
                        break
                    if state in more and w in more[state]:
                        state = more[state][w]
                        break
                    state = link[state]
                    matched = length[state]
                matched += 1
                end = ends[state]
                if end < 0:
                    continue
                longest, most = 0, matched
                while end >= 0:
                    if width[end] <= most:
                        found.add(item[end])
                        longest = max(longest, width[end])
                    for k, items in self.windows.get(end, {}).items():
                        if k <= most:
                            found |= items
                            longest = max(longest, k)
                    up = link[end]
                    end, most = (ends[up], length[up]) if up > 0 else (-1, 0)
                if longest:
                    begin = at + 1 - longest
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, {self.items[i] for i in found}


def item_blocks(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> Iterator[SuffixAutomaton]:
    """Automata of the items, block by block; the driver holds one block's items at a time."""
    block: list[tuple[object, list[bytes]]] = []
    held = 0
    for row in items.select(items[id_col].alias("item"), F.coalesce(items[text_col], F.lit("")).alias("text")).toLocalIterator():
        words = row["text"].encode().translate(WORD_BYTES).split()
        block.append((row["item"], words))
        held += len(words)
        if held >= block_words:
            yield SuffixAutomaton(block, window)
            block, held = [], 0
    if block:
        yield SuffixAutomaton(block, window)


def _hits(part: pa.RecordBatch, text_at: int, automaton: SuffixAutomaton) -> tuple[list, list, list, list]:
    """Texts as bytes, their words, spans and items."""
    raw = as_bytes(part.column(text_at))
    split = [x.translate(WORD_BYTES).split() for x in raw]
    matched = [automaton.match(words) for words in split]
    return raw, split, [s for s, _ in matched], [sorted((x for x in f if x is not None), key=str) for _, f in matched]


def _stored_hits(docs: DataFrame, id_col: str, text_col: str, sent, ids: ArrayType) -> DataFrame:
    """hit_id, hit_key (hash of the text), spans, items of the documents with hits in one block, as a table."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = StructType([StructField("hit_id", rows.schema["doc_id"].dataType), StructField("hit_key", LongType()), StructField("spans", SPANS), StructField("items", ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            _, _, spans, found = _hits(part, 2, sent.value)
            at = pa.array([i for i, s in enumerate(spans) if s], pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), span_array([s for s in spans if s]), pa.array([f for f, s in zip(found, spans, strict=True) if s], to_arrow_type(ids))], schema.names)

    return stored(rows.mapInArrow(run, schema), "benchmark-hits")


def span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], to_arrow_type(SPANS))


def _matched(docs: DataFrame, items: DataFrame, window: int, block_words: int, id_col: str, text_col: str, item_id: str, item_text: str, row: Callable, schema: StructType) -> DataFrame:
    """mapInArrow of `row(columns of docs, names, texts as bytes, words, spans by text, items by text)`."""
    context = docs.sparkSession.sparkContext
    ids = ArrayType(items.schema[item_id].dataType)
    text_at, names = docs.columns.index(text_col), docs.columns
    blocks = item_blocks(items, window, block_words, item_id, item_text)
    first, second = next(blocks, SuffixAutomaton([], window)), next(blocks, None)
    if second is None:
        sent = context.broadcast(first)

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                yield row(part.columns, names, *_hits(part, text_at, sent.value))

        return docs.mapInArrow(one_pass, schema)
    hits = None
    for block in _chained(first, second, blocks):
        sent = context.broadcast(block)
        some = _stored_hits(docs, id_col, text_col, sent, ids)
        sent.unpersist()
        hits = some if hits is None else hits.union(some)
    hits = hits.groupBy("hit_id", "hit_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at_id, at_text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = numbered.withColumn("key", F.xxhash64(F.coalesce(at_text.cast("string"), F.lit(""))))
    whole = keyed.join(hits, at_id.eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").select(*numbered.columns, "spans", "items")

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            raw = as_bytes(part.column(text_at))
            spans = [united([(x["start"], x["end"]) for x in s or []]) for s in part.column(len(names)).to_pylist()]
            found = [sorted(f or [], key=str) for f in part.column(len(names) + 1).to_pylist()]
            yield row(part.columns[: len(names)], names, raw, [x.translate(WORD_BYTES).split() for x in raw], spans, found)

    return whole.mapInArrow(last_pass, schema)


def _chained(first: SuffixAutomaton, second: SuffixAutomaton, rest: Iterator[SuffixAutomaton]) -> Iterator[SuffixAutomaton]:
    yield first
    yield second
    yield from rest


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (hit words as [start, end) word numbers), items (ids of the items with occurring windows)."""
    rows, ids = texts(docs, id_col, text_col), ArrayType(items.schema[item_id].dataType)
    schema = StructType([rows.schema["doc_id"], StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ids)])

    def row(columns, names, raw, split, spans, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0], pa.array(list(map(len, split)), pa.int64()), span_array(spans), pa.array(found, to_arrow_type(ids))], schema.names)

    return _matched(rows, items, window, block_words, "doc_id", "text", item_id, item_text, row, schema)


def cut_words(raw: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit words: from the first byte of a span's first word to the last of its last; the rest is unchanged."""
    low, at, starts = raw.translate(WORD_BYTES), 0, []
    for w in words:
        at = low.index(w, at)
        starts.append(at)
        at += len(w)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = starts[b - 1] + len(words[b - 1])
    return b"".join([*kept, raw[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """docs with hit spans cut out of the text; documents of whose words more than the share max_coverage is hit are left out. All columns are kept."""
    frame = docs.select(*[docs[c] for c in docs.columns])
    at = docs.columns.index(text_col)

    def row(columns, names, raw, split, spans, found) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in s) for s in spans]
        keep = [h <= max_coverage * len(w) for h, w in zip(hit, split, strict=True)]
        new = pa.array([cut_words(r, w, s).decode() if s else None for r, w, s in zip(raw, split, spans, strict=True)], pa.string())
        kept = [c if k != at else pa.compute.if_else(pa.array([bool(s) for s in spans]), new, columns[at].cast(pa.string())) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(kept, names).filter(pa.array(keep))

    return _matched(frame, items, window, block_words, id_col, text_col, item_id, item_text, row, docs.schema)
