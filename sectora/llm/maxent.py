"""Language-model scoring with a hashed maximum-entropy model.

Words are counted over all training documents, without a cap. The softmax over the next word is factored by classes: P(word | history) =
P(class | history) P(word | class, history). The `members` most frequent words are dealt to `CLASSES` classes and scored inside theirs by a second softmax;
all others, unseen ones included, fall into `TAILS` classes by their last byte, and inside these into groups by a hash, as many as the vocabulary and the
tokens ask for (`GROUP_WORDS`, `GROUP_TOKENS`); a group is found by softmaxes along the digits of its number, a word in its group by two more. The features
of a history are the word before, the pair of words before, and the word before that alone (a skip); for the classes they are hashed into tables of fixed
size, inside a group each one that occurs has a row of its own. Inside a class the word before is joined with the class into one hashed feature.

The groups' words, counts and weights are nowhere together: each token of theirs goes to the task that has its group, which learns from those of the training
documents in order and scores all; what it finds goes back to the token's batch of documents. Every group keeps one place for words never seen.

Training makes one pass over all training documents in `ROUNDS` rounds, each on another share of them: every task starts from the broadcast weights, makes
Adagrad steps on its share in sparse numpy batches and sends its change; changes are averaged by tokens on the executors, block by block as they stream in,
and the driver gets one set of weights a round. So the weights, and a little of every score, depend on how the training documents are dealt to tasks.

Scoring reads each text once. Counts of the `head` most frequent words are broadcast (a fixed number of words); all others meet their tokens in the groups'
tasks, so the table of counts can be of any size. No word there is frequent among the training documents: frequent ones are among the members.

Nulls and empty texts are one end token. A null id counts as the empty text in its fold. Repeated rows are scored each by itself. Without training
documents every word is unseen. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, as_bytes, fold, parts, stored, texts, with_id

END = b""
#: The mark of what stands before a text.
START = (1 << 31) - 1
CLASSES, TAILS, SLOTS = 32, 8, 64
ROUNDS, BATCH, RATE = 3, 32768, 0.1
ONE, PAIR, INNER = 1 << 11, 1 << 12, 1 << 12
BLOCK = 1024
#: Words and training tokens of a group, branches of a softmax over groups, training tokens of a task that has groups, tokens of a step inside a group.
GROUP_WORDS, GROUP_TOKENS, BRANCHES, TASK_TOKENS, GROUP_BATCH = 4096, 1 << 17, 64, 1 << 20, 8192
#: Words whose counts a task gathers before it sends them to their groups: a few words for each group at a time cost more on the way than they hold.
COUNTS_SENT = 200_000
#: Sums of weights up to here either way leave float32 room for the exps of the offsets.
REACH = 50
#: Tokens that a training task should at least learn from in a round, as each sends its changes of the tables, a few MB.
LESSONS = 4 << 20


#: What parts words, and each byte's being in a word.
SPACES = b" \t\n\r\x0b\x0c"
IN_WORD = bytes(b not in SPACES for b in range(256))


def tokens(raws: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All tokens of the texts, each different one held once, and how many each text has. No Python object is made for a token."""
    whole = b" ".join([b"", *raws, b""])
    inside = np.frombuffer(whole.translate(IN_WORD), bool)
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    sizes = np.flatnonzero(inside[1:] < inside[:-1]) - starts
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    last = np.searchsorted(starts, ends - 1) + np.arange(len(raws))  # where the texts' end tokens stand, of no bytes
    offsets = np.zeros(len(starts) + len(raws) + 1, np.int64)
    word = np.ones(len(offsets) - 1, bool)
    word[last] = False
    offsets[1:][word] = sizes
    np.cumsum(offsets, out=offsets)
    bytes_of = pa.py_buffer(whole.translate(LOWER_ASCII, SPACES))
    flat = pa.Array.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(offsets), bytes_of])
    return flat.dictionary_encode(), np.diff(last, prepend=-1)


def listed(words: pa.Array) -> list[bytes]:
    """The bytes of an array; several times as fast as to_pylist, which goes by way of a scalar each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts (word, n) of a column of texts."""
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for part in parts(batches):
        flat, _ = tokens(as_bytes(part.column(0)))
        n = np.bincount(flat.indices, minlength=len(flat.dictionary))
        seen.update(dict(zip(listed(flat.dictionary), n.tolist(), strict=True)))
        if len(seen) > 300_000:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def tail_class(word: bytes) -> int:
    return word[-1] % TAILS if word else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


@dataclass
class Lexicon:
    """The head words by frequency with their counts, and the classes of all words."""

    words: list[bytes]
    counts: np.ndarray
    members: int
    tail_n: np.ndarray
    tail_v: np.ndarray
    levels: int = 0  # of softmaxes over the groups of a tail class, each of `branch` branches; without levels its words have their share of it
    branch: int = 1
    mass: np.ndarray | None = None  # of the groups, by tail class
    one_rows: int = ONE  # of the class table's features: words, and pairs of words
    pair_rows: int = PAIR
    inner_rows: int = INNER  # of the table inside classes, and of the one between classes and groups

    def __post_init__(self):
        self.crc = np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words))
        self.groups = self.branch**self.levels  # of a tail class
        self.tail_mass = self.tail_n + self.tail_v + 1.0 if self.mass is None else self.mass.sum(1)
        self.nodes = TAILS * sum(self.branch**i for i in range(self.levels))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.head = pa.array(self.words, pa.large_binary())
        k = len(self.words)
        rank = np.arange(k)
        self.tail = np.array([tail_class(w) for w in self.words], np.int64)
        self.cls = np.where(rank < self.members, rank % CLASSES, CLASSES + self.tail)
        self.logs = np.log10(self.counts + 1.0)
        ids = np.arange(k + TAILS + 1)  # words beyond the head count as their class; the last stands before a text
        own = self.one_rows * 3 // 4  # words with a row of their own; the others share what is left
        self.one = np.where(ids < own, ids, own + _mix(ids.astype(np.uint64)) % np.uint64(self.one_rows - own)).astype(np.int64)

    def coded(self, raws: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens and how many each text has; per token its number (-1 beyond the head), class, and the numbers of the one and two words before."""
        flat, lengths = tokens(raws)
        words, k = listed(flat.dictionary), len(self.words)
        number = np.asarray(pc.index_in(flat.dictionary, self.head).fill_null(-1)).astype(np.int64)
        cls = np.zeros(len(number), np.int64)
        known = number >= 0
        if k:
            cls[known] = self.cls[number[known]]
        cls[~known] = [CLASSES + tail_class(words[i]) for i in np.flatnonzero(~known).tolist()]
        own = np.where(known, number, k + cls - CLASSES)
        at = np.asarray(flat.indices)
        number, cls, own = number[at], cls[at], own[at]
        first = np.cumsum(lengths) - lengths
        before, ahead = np.empty_like(own), np.empty_like(own)
        before[1:], ahead[2:] = own[:-1], own[:-2]
        before[first] = ahead[first] = k + TAILS
        second = first[lengths > 1] + 1
        ahead[second] = k + TAILS
        return flat, lengths, number, cls, before, ahead

    def codes(self, flat: pa.DictionaryArray, number: np.ndarray) -> np.ndarray:
        """A hash of each token."""
        at = np.asarray(flat.indices)
        own = np.empty(len(flat.dictionary), np.int64)
        own[at] = number
        out = np.zeros(len(own), np.uint32)
        known = own >= 0
        if len(self.words):
            out[known] = self.crc[own[known]]
        out[~known] = [*map(zlib.crc32, listed(flat.dictionary.filter(pa.array(~known))))]
        return out[at]

    def steps(self, tail: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By level, the node and the branch that lead to the group of words of these tail classes and hashes."""
        group, base = (codes % np.uint32(self.groups)).astype(np.int64), 0
        for level in range(self.levels):
            rest = self.branch ** (self.levels - level - 1)
            yield base + tail * self.branch**level + group // (rest * self.branch), group // rest % self.branch
            base += TAILS * self.branch**level

    def features(self, before: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Rows of the class table: word before, pair before, skip."""
        pair = _mix((before * 131071 + ahead).astype(np.uint64)) % np.uint64(self.pair_rows)
        return np.stack([self.one[before], self.one_rows + pair.astype(np.int64), self.one_rows + self.pair_rows + self.one[ahead]])


class Weights:
    """Tables of the two softmaxes; the offsets start at the words' shares and aren't trained further apart from the features."""

    def __init__(self, lexicon: Lexicon):
        self.of_class = np.zeros((2 * lexicon.one_rows + lexicon.pair_rows, CLASSES + TAILS), np.float32)
        self.inside = np.zeros((lexicon.inner_rows, SLOTS), np.float32)
        self.between = np.zeros((lexicon.inner_rows + 64 * lexicon.nodes if lexicon.levels else 0, lexicon.branch), np.float32)
        branches = [m.reshape(-1, lexicon.branch) for m in (lexicon.mass.reshape(TAILS * lexicon.branch ** (i + 1), -1).sum(1) for i in range(lexicon.levels))]
        self.branch_offset = np.concatenate([np.log(m / m.sum(1, keepdims=True)) for m in branches]).astype(np.float32) if branches else np.zeros((0, 1), np.float32)
        held = np.zeros((CLASSES, SLOTS))
        m = np.arange(min(lexicon.members, len(lexicon.words)))
        held[m % CLASSES, m // CLASSES] = lexicon.counts[m] + 1.0
        mass = np.concatenate([held.sum(1), lexicon.tail_mass])
        with np.errstate(divide="ignore"):
            self.class_offset = np.log(mass / mass.sum()).astype(np.float32)
            self.slot_offset = np.log(held / np.maximum(1e-30, held.sum(1, keepdims=True))).astype(np.float32)
        self.slot_offset[held.sum(1) == 0] = 0

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.of_class, self.inside, self.between


def inner_rows(w: Weights, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the inner table: the word before together with the class."""
    return (_mix((rows[0] * 64 + cls).astype(np.uint64)) % np.uint64(len(w.inside))).astype(np.int64)


def taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table; without numpy's bounds check, as rows are hashed into the table."""
    return table.take(rows, axis=0, mode="clip")


def class_logits(w: Weights, rows: np.ndarray, join: np.ufunc = np.add) -> np.ndarray:
    out = taken(w.of_class, rows[0])
    join(out, taken(w.of_class, rows[1]), out=out)
    join(out, taken(w.of_class, rows[2]), out=out)
    return join(out, w.class_offset, out=out)


def slot_logits(w: Weights, rows: np.ndarray, cls: np.ndarray, join: np.ufunc = np.add) -> np.ndarray:
    out = taken(w.inside, rows)
    return join(out, taken(w.slot_offset, cls), out=out)


def branch_rows(w: Weights, rows: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Rows of the table between classes and groups: the word before and the pair before, each together with the node."""
    return [(_mix(((feature << 32) + node).astype(np.uint64)) % np.uint64(len(w.between))).astype(np.int64) for feature in rows[:2]]


def branch_logits(w: Weights, rows: list[np.ndarray], node: np.ndarray, join: np.ufunc = np.add) -> np.ndarray:
    out = taken(w.between, rows[0])
    join(out, taken(w.between, rows[1]), out=out)
    return join(out, taken(w.branch_offset, node), out=out)


def _exp(logits: np.ndarray) -> np.ndarray:
    """exp of logits less a shift, in place, and the shift of each row: its largest logit, or nothing where none is large enough to matter."""
    shift = np.zeros(len(logits), np.float32)
    if len(logits) and logits.max() > 60 or len(logits) and logits[:, 0].min() < -60:
        shift = logits.max(1)
        logits -= shift[:, None]
    np.exp(logits, out=logits)
    return shift


def _totals(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", x)


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, in place."""
    _exp(logits)
    logits *= (1 / _totals(logits))[:, None]
    return logits


def log_at(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each row's target."""
    own = logits[np.arange(len(target)), target].astype(np.float64)
    shift = _exp(logits)
    return own - shift - np.log(_totals(logits))


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row moved as one item, which takes half the time."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(item).ravel()[at] = np.ascontiguousarray(rows, table.dtype).view(item).ravel()


def exps(w: Weights) -> Weights | None:
    """exp of all tables and offsets, whose products are the exps of the sums: a table has far fewer rows than a batch has tokens. None where a product might
    leave what float32 holds."""
    if any(len(t) and terms * max(t.max(), -t.min()) > REACH for t, terms in zip(w.tables(), (3, 1, 2), strict=True)):
        return None
    out = Weights.__new__(Weights)
    out.__dict__ |= {name: np.exp(x) for name, x in w.__dict__.items()}
    return out


def shares(w: Weights, e: Weights | None, logits: Callable, *at: np.ndarray) -> np.ndarray:
    """Probabilities by the logits of w, or by their exps e."""
    if e is None:
        return softmax(logits(w, *at))
    out = logits(e, *at, np.multiply)
    out *= (1 / _totals(out))[:, None]
    return out


def log_shares(w: Weights, e: Weights | None, target: np.ndarray, logits: Callable, *at: np.ndarray) -> np.ndarray:
    """The log-probability of each row's target, likewise."""
    if e is None:
        return log_at(logits(w, *at), target)
    out = logits(e, *at, np.multiply)
    return np.log(out[np.arange(len(target)), target].astype(np.float64)) - np.log(_totals(out))


def summed(x: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of x's rows taken in order; starts: where each run begins. Runs are added place by place while more of them are left than places are
    done, and the few long ones one by one: either is far quicker than a reduceat."""
    sizes = np.diff(np.append(starts, len(order)))
    out = taken(x, order[starts])
    more = np.flatnonzero(sizes > 1)
    if not len(more):
        return out
    falling = more[np.argsort(-sizes[more], kind="stable")]
    sizes, first = sizes[falling], starts[falling]
    sums, left, k = taken(out, falling), len(falling), 1
    while left > k:
        sums[:left] += taken(x, order[first[:left] + k])
        k += 1
        left = int(np.searchsorted(-sizes, -k))
    for i, a, b in zip(range(left), (first[:left] + k).tolist(), (first[:left] + sizes[:left]).tolist(), strict=True):
        sums[i] += taken(x, order[a:b]).sum(0)
    put_rows(out, falling, sums)
    return out


def step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """An Adagrad step, one rate a row, on the rows that a batch touches: example i's gradient goes to row rows[i]."""
    if not len(rows):
        return
    order = stable_order(rows, len(table))
    ranked = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    g = summed(gradient, order, starts)
    at = ranked[starts]
    squares[at] += np.einsum("ij,ij->i", g, g)
    g *= (RATE * np.sqrt(table.shape[1]) / np.sqrt(squares[at]))[:, None]
    new = taken(table, at)
    new -= g
    put_rows(table, at, new)


def learn(w: Weights, squares: tuple[np.ndarray, np.ndarray], lexicon: Lexicon, raws: list[bytes]) -> int:
    """Steps over the tokens of raws; how many there were."""
    flat, _, number, cls, before, ahead = lexicon.coded(raws)
    codes = lexicon.codes(flat, number) if lexicon.levels else number
    for at in range(0, len(cls), BATCH):
        c = cls[at : at + BATCH]
        rows = features = lexicon.features(before[at : at + BATCH], ahead[at : at + BATCH])
        e = exps(w)
        p = shares(w, e, class_logits, rows)
        p[np.arange(len(c)), c] -= 1
        for feature in rows:
            step(w.of_class, squares[0], feature, p)
        inner = np.flatnonzero(c < CLASSES)
        if len(inner):
            k = c[inner]
            rows = inner_rows(w, rows[:, inner], k)
            p = shares(w, e, slot_logits, rows, k)
            p[np.arange(len(k)), number[at : at + BATCH][inner] // CLASSES] -= 1
            step(w.inside, squares[1], rows, p)
        outer = np.flatnonzero(c >= CLASSES)
        for node, branch in lexicon.steps(c[outer] - CLASSES, codes[at : at + BATCH][outer]):
            two = branch_rows(w, features[:, outer], node)
            p = softmax(branch_logits(w, two, node))
            p[np.arange(len(node)), branch] -= 1
            for rows in two:
                step(w.between, squares[2], rows, p)
    return len(cls)


def scored(w: Weights, lexicon: Lexicon, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Per text: tokens, tokens in the head, sum of log10(c + 1) over these, the model's log10 probability but for log10(c + 1) of the words beyond the
    head, and those words."""
    coded = lexicon.coded(raws)
    return scored_codes(w, lexicon, coded, lexicon.codes(coded[0], coded[2]))


def scored_codes(w: Weights, lexicon: Lexicon, coded: tuple, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """`scored` of coded texts; where the lexicon has groups, the model's probability is that of the words' groups."""
    flat, lengths, number, cls, before, ahead = coded
    row = np.repeat(np.arange(len(lengths)), lengths)
    known = number >= 0
    logs = np.zeros(len(number))
    if len(lexicon.words):
        logs[known] = lexicon.logs[number[known]]
    value, e = np.zeros(len(number)), exps(w)
    for at in range(0, len(cls), BATCH):
        c = cls[at : at + BATCH]
        rows = lexicon.features(before[at : at + BATCH], ahead[at : at + BATCH])
        found = log_shares(w, e, c, class_logits, rows)
        inner = np.flatnonzero(c < CLASSES)
        if len(inner):
            k = c[inner]
            found[inner] += log_shares(w, e, number[at : at + BATCH][inner] // CLASSES, slot_logits, inner_rows(w, rows[:, inner], k), k)
        outer = np.flatnonzero(c >= CLASSES)
        for node, branch in lexicon.steps(c[outer] - CLASSES, codes[at : at + BATCH][outer]):
            found[outer] += log_shares(w, e, branch, branch_logits, branch_rows(w, rows[:, outer], node), node)
        value[at : at + BATCH] = found / np.log(10)
    n = len(lengths)
    beyond: list[list[bytes]] = [[] for _ in range(n)]
    far = np.flatnonzero(~known)
    if lexicon.levels:
        far = far[:0]
    else:
        outer = cls >= CLASSES
        value[outer] += logs[outer] - np.log10(lexicon.tail_mass)[cls[outer] - CLASSES]
    for word, r in zip(listed(flat.take(pa.array(far)).dictionary_decode()), row[far].tolist(), strict=True):
        beyond[r].append(word)
    return lengths, np.bincount(row[known], minlength=n), np.bincount(row, logs, n), np.bincount(row, value, n), beyond


def lexicon_of(counts: DataFrame, head: int, members: int, rows: tuple[int, int, int] = (ONE, PAIR, INNER)) -> Lexicon:
    """The head comes to the driver: a fixed number of words whatever the corpus; sums by class are made on the executors."""
    most = 0
    least = 0  # words seen more often than this are at most `head`
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():  # counts that occur: few, as their sum is the corpus
        most += r["words"]
        if most > head:
            least = r["n"]
            break
    top = sorted(((-r["n"], bytes(r["word"])) for r in counts.filter(F.col("n") > least).collect()))
    words, n = [w for _, w in top], np.array([-c for c, _ in top], np.int64)
    members = min(members, len(words), CLASSES * SLOTS)
    last = F.coalesce(F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int"), F.lit(0)) % TAILS
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy(last.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    for w, c in zip(words[:members], n[:members].tolist(), strict=True):
        tail_n[tail_class(w)] -= c
        tail_v[tail_class(w)] -= 1
    groups = int(np.ceil(max(tail_v.sum() / GROUP_WORDS, tail_n.sum() / GROUP_TOKENS) / TAILS))
    if not groups:
        return Lexicon(words, n, members, tail_n, tail_v, 0, 1, None, *rows)
    levels = branch = 1
    while BRANCHES**levels < groups:
        levels += 1
    while branch**levels < groups:
        branch += 1
    groups = branch**levels
    mass = np.ones((TAILS, groups))
    for r in counts.groupBy(last.alias("k"), (F.crc32("word") % groups).alias("j")).agg((F.sum("n") + F.count("*")).alias("m")).toLocalIterator():
        mass[r["k"], r["j"]] += r["m"]
    for w, c in zip(words[:members], n[:members].tolist(), strict=True):
        mass[tail_class(w), zlib.crc32(w) % groups] -= c + 1
    return Lexicon(words, n, members, tail_n, tail_v, levels, branch, mass, *rows)


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (block, weight, change) by block as they stream in."""
    total: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for block, weight, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            x = np.frombuffer(raw, "<f4").astype(np.float64)
            old = total.get(block, (0.0, 0.0))
            total[block] = old[0] + weight, old[1] + x
    if total:
        blocks = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([0] * len(blocks), pa.int32()), pa.array([total[b][0] for b in blocks]), pa.array([total[b][1].astype("<f4").tobytes() for b in blocks], pa.binary())], ["block", "share", "weight", "change"]
        )


CHANGES = "block int, share int, weight double, change binary"


def train(teach: DataFrame, lexicon: Lexicon, tokens: int, rounds: int = ROUNDS) -> Weights:
    """teach: key (deals documents to rounds), text; tokens: how many there are in all."""
    sc = teach.sparkSession.sparkContext
    w = Weights(lexicon)
    if not lexicon.words and not lexicon.levels:
        return w
    for turn in range(rounds):
        sent = sc.broadcast((w, lexicon))  # tables of a fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, lexicon = sent.value
            own = Weights.__new__(Weights)
            own.__dict__ |= start.__dict__ | {"of_class": start.of_class.copy(), "inside": start.inside.copy(), "between": start.between.copy()}
            squares = tuple(np.full(len(t), 1e-2, np.float32) for t in own.tables())
            n = 0
            for part in parts(batches, 2 << 20):
                n += learn(own, squares, lexicon, as_bytes(part.column(0)))
            if not n:
                return
            share, block = TaskContext.get().partitionId() % 64, 0
            for new, old in zip(own.tables(), start.tables(), strict=True):
                for at in range(0, len(new), BLOCK):
                    change = ((new[at : at + BLOCK] - old[at : at + BLOCK]) * n).astype("<f4")
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([share], pa.int32()), pa.array([float(n)]), pa.array([change.tobytes()], pa.binary())], ["block", "share", "weight", "change"])
                    block += 1

        share = teach.filter(F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds)) == turn).select("text")
        changes = share.coalesce(-(-tokens // (rounds * LESSONS)) or 1).mapInArrow(run, CHANGES)
        places = [(t.reshape(-1), at * t.shape[1]) for t in w.tables() for at in range(0, len(t), BLOCK)]
        blocks = len(places)
        summed = changes.repartition(2 * blocks, "block", "share").mapInArrow(averaged, CHANGES).repartition(blocks, "block").mapInArrow(averaged, CHANGES)
        for r in summed.toLocalIterator():
            table, at = places[r["block"]]
            change = np.frombuffer(r["change"], "<f4") / r["weight"]
            table[at : at + len(change)] += change
    return w


class Group:
    """The two softmaxes inside a group: over classes of its words, dealt by rank, and over the words of a class; the last word stands for unseen ones."""

    def __init__(self, counts: np.ndarray):
        mass = np.append(counts + 1.0, 1.0)
        m = np.arange(len(mass))
        self.classes = int(np.ceil(np.sqrt(len(mass))))
        held = np.zeros((self.classes, -(-len(mass) // self.classes)))
        held[m % self.classes, m // self.classes] = mass
        with np.errstate(divide="ignore"):
            self.class_offset = np.log(held.sum(1) / held.sum()).astype(np.float32)
            self.slot_offset = np.log(held / held.sum(1, keepdims=True)).astype(np.float32)

    def logs(self, word: np.ndarray, before: np.ndarray, ahead: np.ndarray, teach: np.ndarray) -> np.ndarray:
        """The log10 probability of each word (its rank) after steps over those that teach, in their order. Each feature of these has a row of its own."""
        cls, slot = word % self.classes, word // self.classes
        pair = before.astype(np.uint64) << np.uint64(32) | ahead
        one, pair, skip = (_own_rows(x, teach) for x in (before, pair, ahead))
        joined = _own_rows(before.astype(np.uint64) * np.uint64(self.classes) + cls.astype(np.uint64), teach)
        tables = [np.zeros((k, self.classes), np.float32) for _, k in (one, pair, skip)] + [np.zeros((joined[1], self.slot_offset.shape[1]), np.float32)]
        squares = [np.full(len(t), 1e-2, np.float32) for t in tables]
        features = [one[0], pair[0], skip[0]]

        def classes(at: np.ndarray) -> np.ndarray:
            out = taken(tables[0], features[0][at])
            for table, rows in zip(tables[1:3], features[1:], strict=True):
                out += taken(table, rows[at])
            out += self.class_offset
            return out

        def slots(at: np.ndarray) -> np.ndarray:
            out = taken(tables[3], joined[0][at])
            out += taken(self.slot_offset, cls[at])
            return out

        lessons = np.flatnonzero(teach)
        for start in range(0, len(lessons), GROUP_BATCH):
            at = lessons[start : start + GROUP_BATCH]
            p = softmax(classes(at))
            p[np.arange(len(at)), cls[at]] -= 1
            for table, square, rows in zip(tables, squares, features, strict=False):
                step(table, square, rows[at], p)
            p = softmax(slots(at))
            p[np.arange(len(at)), slot[at]] -= 1
            step(tables[3], squares[3], joined[0][at], p)
        out = np.zeros(len(word))
        for start in range(0, len(word), GROUP_BATCH):
            at = np.arange(start, min(len(word), start + GROUP_BATCH))
            out[at] = log_at(classes(at), cls[at]) + log_at(slots(at), slot[at])
        return out / np.log(10)


def _own_rows(keys: np.ndarray, teach: np.ndarray) -> tuple[np.ndarray, int]:
    """A row for each different key that teaches, and one that stays zero for all others; how many rows there are."""
    at = np.asarray(pa.array(keys).dictionary_encode().indices)
    row = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    row[at[teach]] = 1
    taught = np.cumsum(row)
    n = int(taught[-1]) if len(taught) else 0
    return np.where(row > 0, taught - 1, n)[at], n + 1


#: Kept, as making one anew takes a good part of the time that a short batch does.
SQUEEZE, SPREAD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Batches on their way: of texts (docs), of tokens to groups (ints, words), of counts to groups (a base of -1), of tokens back from groups (ints).
MOVED = "shard int, base long, docs binary, ints binary, words binary"


def moved(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (shard, base, docs, ints, words) in one Arrow batch: one for each row costs more than its contents."""
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["shard", "base", "docs", "ints", "words"])


def packed(*columns: np.ndarray) -> bytes:
    """Whole or floating numbers of one length, byte by byte of each column, compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T for x in columns]
    return SQUEEZE.compress(b"".join(x.tobytes() for x in planes))


def unpacked(raw: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(SPREAD.decompress(raw), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(sizes), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


def _joined(words: list[bytes]) -> bytes:
    return SQUEEZE.compress(b" ".join(words))


def _parted(raw: bytes) -> list[bytes]:
    return SPREAD.decompress(raw).split(b" ")


def _cuts(ranked: np.ndarray) -> Iterator[slice]:
    """Runs of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else []
    yield from (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))


def stable_order(x: np.ndarray, below: int) -> np.ndarray:
    """The stable order of whole numbers from 0 to below `below`: by radix where two bytes hold them."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def to_groups(lexicon: Lexicon, shards: int, base: int, coded: tuple, codes: np.ndarray, held: np.ndarray) -> list[tuple]:
    """Rows to be moved: the tokens of a batch that belong to groups, by shard: text and whether it is held out, group, number, marks of the two words before (numbers, or
    hashes beyond the head)."""
    flat, lengths, number, cls, _, _ = coded
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    marks = np.where(number >= 0, number, codes | np.uint32(1 << 31)).astype(np.uint32)
    before, ahead = np.empty_like(marks), np.empty_like(marks)
    before[1:], ahead[2:] = marks[:-1], marks[:-2]
    before[first] = ahead[first] = START
    ahead[first[lengths > 1] + 1] = START
    outer = np.flatnonzero(cls >= CLASSES)
    group = (cls[outer] - CLASSES) * lexicon.groups + codes[outer] % np.uint32(lexicon.groups)
    every = np.arange(TAILS * lexicon.groups)
    place = np.empty_like(every)
    place[np.lexsort((every, every % shards))] = every
    order = stable_order(place[group], len(every))
    group, outer = group[order], outer[order]
    table = [(row[outer] * 2 + held[row[outer]]).astype("<i4"), group.astype("<i4"), number[outer].astype("<i4"), before[outer], ahead[outer]]
    out = []
    words, at = flat.dictionary.to_numpy(zero_copy_only=False), np.asarray(flat.indices)
    for cut in _cuts(group % shards):
        far = outer[cut][number[outer[cut]] < 0]
        out.append((int(group[cut.start] % shards), base, None, packed(*[x[cut] for x in table]), _joined(words[at[far]].tolist())))
    return out


def inside_groups(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups whose counts and tokens are all here: per batch of texts its tokens' text, count (-1 in the head) and log10 probability in the group."""
    counts: dict[int, list] = defaultdict(list)
    tables = []
    for batch in batches:
        for shard, base, docs, ints, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs is not None:
                yield moved([(shard, base, docs, None, None)])
            elif base < 0:
                for group, n, word in zip(*(x.tolist() for x in unpacked(ints, "<i8", "<i8")), _parted(names), strict=True):
                    counts[group].append((-n, word))
            else:
                tables.append((base, ints, names))
    if not tables:
        return
    tables.sort(key=lambda t: t[0])  # a batch of texts has each group's tokens in one of them, in order
    bases, parts_of, far = sorted({t[0] for t in tables}), [], []
    turns = np.searchsorted(bases, [t[0] for t in tables])
    for _, ints, names in tables:
        parts_of.append(unpacked(ints, "<i4", "<i4", "<i4", "<u4", "<u4"))
        far += _parted(names) if (parts_of[-1][2] < 0).any() else []
    row, group, number, before, ahead = (np.concatenate(x) for x in zip(*parts_of, strict=True))
    turn = np.repeat(turns, [len(x[0]) for x in parts_of])
    del tables, parts_of
    word_at = np.cumsum(number < 0) - 1  # where in far the words beyond the head are
    order = stable_order(group, TAILS * lexicon.groups)
    row, group, number, before, ahead, turn, word_at = (x[order] for x in (row, group, number, before, ahead, turn, word_at))
    value, seen = np.zeros(len(row), "<f4"), np.zeros(len(row), "<i8")
    rank_of = np.zeros(len(lexicon.words) + 1, np.int64)
    for cut in _cuts(group):
        ranked = sorted(counts.pop(int(group[cut.start]), []))
        rank = {word: i for i, (_, word) in enumerate(ranked)}
        n = np.array([-c for c, _ in ranked], np.int64)
        head = [(lexicon.number[w], i) for w, i in rank.items() if w in lexicon.number]
        if head:
            numbers, ranks = np.array(head, np.int64).T
            rank_of[numbers] = ranks
        word = rank_of[number[cut]]
        beyond = np.flatnonzero(number[cut] < 0)
        word[beyond] = np.fromiter((rank.get(far[i], len(ranked)) for i in word_at[cut][beyond].tolist()), np.int64, len(beyond))
        value[cut] = Group(n).logs(word, before[cut], ahead[cut], row[cut] % 2 == 0)
        seen[cut] = np.append(n, 0)[word]
    seen[number >= 0] = -1
    order = stable_order(turn, len(bases))
    told = []
    for cut in _cuts(turn[order]):
        at = order[cut]
        told.append((0, bases[turn[at[0]]], None, packed(row[at] // 2, value[at], seen[at]), None))
        if len(told) == 64:
            yield moved(told)
            told = []
    if told:
        yield moved(told)


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, head: int = 1 << 17, members: int = CLASSES * SLOTS, rounds: int = ROUNDS, rows: tuple[int, int, int] = (ONE, PAIR, INNER), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. rows: of the class table's words and pairs, and of the
    tables inside classes and between classes and groups; of each, a task sends its changes in every round."""
    known = texts(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    teach = known.filter(~F.col("held_out"))
    counts = stored(teach.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    lexicon = lexicon_of(counts, head, members, rows)
    w = train(teach.select(F.col("doc_id").alias("key"), "text"), lexicon, n, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((w, lexicon))
    tasks = int(lexicon.tail_n.sum() // TASK_TOKENS) + 8
    shards = min(4 * tasks, TAILS * lexicon.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, lexicon = sent.value
        base = TaskContext.get().partitionId() << 40
        for part in parts(batches, 2 << 20):
            coded = lexicon.coded(as_bytes(part.column(1)))
            codes = lexicon.codes(coded[0], coded[2])
            lengths, known, logs, model, _ = scored_codes(w, lexicon, coded, codes)
            columns = [part.column(0), part.column(2), pa.array(lengths), pa.array(known), pa.array(logs), pa.array(model)]
            told = pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "base", "model"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, told.schema) as out:
                out.write_batch(told)
            more = to_groups(lexicon, shards, base, coded, codes, np.array(part.column(2).to_pylist(), bool)) if lexicon.levels else []
            yield moved([(base % shards, base, sink.getvalue().to_pybytes(), None, None), *more])
            base += part.num_rows

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, found = sent.value[1], []

        def rows() -> pa.RecordBatch:
            words, group, n = [x[2] for x in found], *np.array([x[:2] for x in found], "<i8").T
            order = np.argsort(group % shards, kind="stable")
            ranked = group[order] % shards
            return moved([(int(ranked[cut.start]), -1, None, packed(group[order[cut]], n[order[cut]]), _joined([words[i] for i in order[cut].tolist()])) for cut in _cuts(ranked)])

        for batch in batches:
            words = batch.column(0).to_pylist()
            found += [(tail_class(x) * lexicon.groups + zlib.crc32(x) % lexicon.groups, c, x) for x, c in zip(words, batch.column(1).to_pylist(), strict=True) if lexicon.number.get(x, lexicon.members) >= lexicon.members]
            if len(found) > COUNTS_SENT:
                yield rows()
                found.clear()
        if found:
            yield rows()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, pa.RecordBatch] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for base, docs, ints in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if docs is not None:
                    told[base] = pa.ipc.open_stream(docs).read_next_batch()
                    continue
                row, value, seen = unpacked(ints, "<i4", "<f4", "<i8")
                more = np.stack([np.bincount(row, value), np.bincount(row, np.log10(np.maximum(seen, 0) + 1.0)), np.bincount(row, seen > 0)])
                old = sums.get(base, np.zeros((3, 0)))
                if old.shape[1] < more.shape[1]:
                    old, more = more, old
                old[:, : more.shape[1]] += more
                sums[base] = old
        for base, batch in told.items():
            more = np.zeros((3, batch.num_rows))
            if base in sums:
                more[:, : sums[base].shape[1]] = sums[base]
            tokens, known, logs, model = (np.asarray(batch.column(i)) for i in range(2, 6))
            columns = [batch.column(0), batch.column(1), pa.array(tokens), pa.array(known + more[2].astype(np.int64)), pa.array(np.full(len(tokens), n)), pa.array(logs + more[1] - tokens * np.log10(n + v + 1)), pa.array(model + more[0])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = known.mapInArrow(run, MOVED)
    if lexicon.levels:
        found = found.union(counts.select("word", "n").mapInArrow(of_groups, MOVED)).repartition(tasks, "shard").mapInArrow(lambda batches: inside_groups(sent.value[1], batches), MOVED)
    return found.repartition("base").mapInArrow(together, with_id(known, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
