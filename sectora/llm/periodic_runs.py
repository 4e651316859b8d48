"""Periodic runs: stretches of words that repeat with some period, found exactly, and their repetitions taken out.

A run is a stretch of consecutive words with smallest period q, at least max(shortest, 2q) words long, that no neighbouring word extends keeping that
period. Two steps find all runs of a text:

1. Masking. A run of length n and period q holds its first n - q words twice, and n - q is at least k = ceil(shortest / 2). So each of its words lies in a
   sequence of k words that stands in the text again. Words outside such sequences are masked; between them lie segments, and no run leaves its segment.
   Inside a segment the same is asked again of the segment alone, until nothing more is masked, so passages copied far apart drop out as well.
2. Main-Lorentz on the segments that survive: each is halved over and over; at a middle and for each period the common extension to the right and to the
   left of two places a period apart tells the run that touches the middle. Extensions reach to the segment's ends, so each run is found whole.

All middles of one depth, of all segments of a batch, are handled at once in numpy. Extensions are found by doubling over a polynomial hash of word numbers;
every run is then compared word by word, and where a hash misled, the batch is done again with exact numbers of the sequences of 1, 2, 4, 8 ... words.

Each text is handled by itself: no shuffle, and a lost task is done again alone. What a task holds follows its batch, or the longest single text.

Nulls: a null text has no words and no runs, a null id is carried along. Rows that repeat are each judged by themselves. An empty table gives an empty
result. Words are cut at bytes 0x20 and 0x09-0x0D and never changed; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, parts, texts, with_id
from .substring_dedup import mixed, rolling

#: Odd, 5 modulo 8: its powers modulo 2^64 repeat only after 2^62.
BASE = 0x9E3779B97F4A7C15
#: Pairs of a middle and a period that are looked at in one array.
CHUNK = 1 << 20
#: Times that segments are masked again at most; what is left unmasked then only costs time.
PASSES = 16


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    return np.fromiter((number(w, len(seen)) for w in words), np.int64, len(words))


def survivors(numbers: np.ndarray, group: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments [start, end) of words in sequences of k words that stand at least twice in their segment. group: the text of each word, ascending."""
    k = -(-shortest // 2)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(group)) if len(starts) else starts
    grams = rolling(mixed(numbers.astype(np.uint64) + np.uint64(1)), k)
    for _ in range(PASSES):
        some = ends - starts >= shortest
        starts, ends = starts[some], ends[some]
        if not len(starts):
            break
        at = _ranges(starts, ends - k + 1)
        segment = np.repeat(np.arange(len(starts)), ends - k + 1 - starts)
        own = mixed(grams[at] ^ mixed(segment.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(numbers) + 1, np.int32)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + k, -1)
        live = np.cumsum(edge[:-1]) > 0
        words, label = _ranges(starts, ends), np.repeat(np.arange(len(starts)), ends - starts)
        stay = live[words]
        words, label = words[stay], label[stay]
        if not len(words):
            return words, words
        first = np.concatenate(([True], (words[1:] != words[:-1] + 1) | (label[1:] != label[:-1])))
        new_starts = words[first]
        new_ends = words[np.append(np.flatnonzero(first)[1:] - 1, len(words) - 1)] + 1
        if len(new_starts) == len(starts) and np.array_equal(new_starts, starts) and np.array_equal(new_ends, ends):
            break
        starts, ends = new_starts, new_ends
    return starts, ends


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, start + 1, ... end - 1 of each range, one after the other."""
    sizes = ends - starts
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Extensions:
    """How far the words from two places on agree, for many pairs of places at once."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = numbers
        powers = np.full(len(numbers) + 1, BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(numbers.astype(np.uint64) + np.uint64(7)) * self.powers[:-1])))

    def _alike(self, i: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether size words from i on hash like those q further on."""
        t = self.total
        return (t[i + size] - t[i]) * self.powers[q] == t[i + q + size] - t[i + q]

    def right(self, i: np.ndarray, q: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most words from i on that equal those q further on, none of them at `high` or beyond."""
        room, n = np.maximum(high - i - q, 0), np.zeros(len(i), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            could = np.flatnonzero(n + step <= room)
            could = could[self._alike(i[could] + n[could], q[could], step)]
            n[could] += step
            step >>= 1
        return n

    def left(self, i: np.ndarray, q: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The most words before i that equal those q further on, none of them before `low`."""
        room, n = np.maximum(i - low, 0), np.zeros(len(i), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            could = np.flatnonzero(n + step <= room)
            could = could[self._alike(i[could] - n[could] - step, q[could], step)]
            n[could] += step
            step >>= 1
        return n


class ExactExtensions(Extensions):
    """The same without a hash: sequences of 1, 2, 4, 8 ... words are numbered, which takes a table for each of these sizes."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.tables = {1: np.unique(numbers, return_inverse=True)[1].astype(np.int64)}

    def _alike(self, i: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        if size not in self.tables:
            half = size // 2
            self._alike(i[:0], q[:0], half)
            t = self.tables[half]
            self.tables[size] = np.unique(t[: len(t) - half] * (len(t) + 1) + t[half:], return_inverse=True)[1].astype(np.int64)
        t = self.tables[size]
        return t[i] == t[i + q]


def _first_of_alike(runs: np.ndarray) -> np.ndarray:
    """Of neighbouring rows (start, end, period) with one start and end, those whose period isn't a multiple of the first one's, and the first."""
    lead = np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))
    period = runs[np.maximum.accumulate(np.where(lead, np.arange(len(runs)), 0)), 2]
    return runs[lead | (runs[:, 2] % period != 0)]


def main_lorentz(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs inside the segments [start, end), by start."""
    reach = (ExactExtensions if exact else Extensions)(numbers)
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    low, high, a, b = starts, ends, starts, ends  # segment and part of it
    while True:
        some = b - a >= shortest
        low, high, a, b = low[some], high[some], a[some], b[some]
        if not len(a):
            break
        m = (a + b) // 2
        for before in (0, 1):  # periods that start at the middle, then periods that end there
            count = np.minimum((b - a) // 2, (m - a) if before else (b - m))
            done = np.concatenate(([0], np.cumsum(count)))
            for first in range(0, int(done[-1]), CHUNK):
                pick = np.arange(first, min(first + CHUNK, int(done[-1])))
                node = np.searchsorted(done, pick, side="right") - 1
                q = pick - done[node] + 1
                i = m[node] - q * before
                lo, hi = low[node], high[node]
                near = (i + q < hi) & (numbers[i] == numbers[np.minimum(i + q, len(numbers) - 1)])
                near |= (i > lo) & (numbers[np.maximum(i, 1) - 1] == numbers[i + q - 1])
                i, q, lo, hi = i[near], q[near], lo[near], hi[near]
                n_right, n_left = reach.right(i, q, hi), reach.left(i, q, lo)
                size = n_left + q + n_right
                run = size >= np.maximum(2 * q, shortest)
                s = (i - n_left)[run]
                if len(s):
                    found.append(_first_of_alike(np.stack([s, s + size[run], q[run]], 1)))
        low, high, a, b = np.concatenate([low, low]), np.concatenate([high, high]), np.concatenate([a, m]), np.concatenate([m, b])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # of one start and end the smallest period comes first; all others are its multiples, or a hash misled
        lead = np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))
        misled = len(_first_of_alike(runs)) > lead.sum()
        runs = runs[lead]
        misled = misled or any((numbers[s : e - q] != numbers[s + q : e]).any() for s, e, q in runs.tolist())
        if misled and not exact:
            return main_lorentz(numbers, starts, ends, shortest, exact=True)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def find_runs(numbers: np.ndarray, group: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of texts laid one after the other."""
    starts, ends = survivors(numbers, group, shortest)
    return main_lorentz(numbers, starts, ends, shortest)


#: A row of a result: id, words, runs as rows of start, length and period, words that stay.
Row = tuple[object, int, np.ndarray, bytes]


def _texts_of(batch: pa.RecordBatch, shortest: int) -> Iterator[Row]:
    words = [x.split() for x in as_bytes(batch.column(1))]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    numbers = np.concatenate([np.zeros(0, np.int64), *map(word_numbers, words)])
    start, end, period = find_runs(numbers, np.repeat(np.arange(len(words)), sizes), shortest)
    owner = np.searchsorted(first, start, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(words) + 1))
    for k, (doc, own) in enumerate(zip(batch.column(0).to_pylist(), words, strict=True)):
        a, b = cut[k], cut[k + 1]
        runs = np.stack([start[a:b] - first[k], end[a:b] - start[a:b], period[a:b]], 1)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        if len(runs):
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            kept = b" ".join(compress(own, (np.cumsum(edge[:-1]) == 0).tolist()))
        else:
            kept = b" ".join(own)
        yield doc, len(own), runs, kept


def _plain(rows: list[Row]) -> list[pa.Array]:
    as_structs = [[{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()] for _, _, runs, _ in rows]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return [pa.array([n for _, n, _, _ in rows], pa.int64()), pa.array(as_structs, kind), pa.array([kept.decode() for *_, kept in rows])]


def collapse_runs(
    docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text", columns: Callable[[list[Row]], list[pa.Array]] = _plain,
    schema: str = "n_words long, runs array<struct<start: long, length: long, period: long>>, text string",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, all runs by start and period, and the text whose runs keep their first period only, its words joined by one space;
    or the columns that `columns` makes of the rows of a batch, under `schema`."""
    rows = texts(docs, id_col, text_col)
    whole = with_id(rows, schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            judged = list(_texts_of(part, shortest))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns(judged)], names=whole.names)

    return rows.mapInArrow(apply, whole)
