"""The trie of all conversations' prefixes: how many conversations share each sequence of first turns, where they end, and what sharing saves.

A node is a sequence of first turns. Its key is a 128-bit hash of its parent's key and the digest of its last turn, so that equal prefixes have equal keys
wherever they stand. Turns travel as digests (16 bytes) and lengths; their texts aren't moved.

1. Conversations are dealt to tasks by ranges of ids and sorted by id and turn. Each task walks them and emits a partial trie: a row for each node it met,
   with the number of members, the smallest one and the ids that end there, combined before anything is shuffled. A task holds `HELD` nodes at most and
   emits them when they are more, and no more than `PACKED` ids a node; a node may so have several rows.
2. Partial tries are merged in a tree: the rows of `FAN` neighbouring tasks meet by key, then `FAN` of these, until one is left. Members and their
   minima merge as numbers.
3. Lists of ends merge by key too. They are of disjoint ranges, so a list is read off its packed pieces in order, one at a time, however long it is.
4. Bottom-up rollup: each row has its ancestors 1, 2, 4, 8 ... turns up. Sums over the nearest 1, 2, 4, 8 ... levels below a node are added at these, so
   that a trie of depth d takes log d rounds rather than d, each an aggregation by key with partial sums before the shuffle.

A conversation is walked by one task, which holds 16 bytes for each of its turns.

Nulls: rows with a null conv_id are left out, as a null names no conversation. Null turns come first, null roles and texts count as empty. Turns of one
number are put in the order of their digests. Rows that repeat are turns of their own. An empty table gives an empty trie, without a root. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import looked_up, stored

#: Nodes that a task holds, ids in a packed piece, tasks (or merged tries) that meet in one of the next level.
HELD, PACKED, FAN = 100_000, 8_192, 64
#: The root's key.
ROOT = bytes(16)
PARTIAL = "part int, key binary, depth int, ups array<binary>, points long, n long, first long, ends binary, ends_from long"


@dataclass(frozen=True)
class Trie:
    """nodes: key, depth, parent (key), points (code points of the last text), n_convs, conv_id (smallest member), n_children, n_leaves, saved.
    ends: key, ends_from, ends: the ids of conversations that end at a node, ascending, as little-endian longs in pieces that follow each other."""

    nodes: DataFrame
    ends: DataFrame


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1, in the order of turns), digest (of role and text) and points (code points of the text)."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(conversations[id_col].isNotNull()).select(
        conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"),
        F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 32)).alias("digest"), F.length(text).cast("long").alias("points"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "points")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tries of conversations that come by id and position. A row without a digest only says that there is a conversation."""
    names = ["part", "key", "depth", "ups", "points", "n", "first", "ends", "ends_from"]
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    held: dict[bytes, list] = {}
    path, conv, part, points = bytearray(), None, 0, 0

    def packed(rows: dict[bytes, list]) -> pa.RecordBatch:
        columns = list(zip(*((part, k, d, ups, p, n, first, np.array(ends, "<i8").tobytes() if ends else None, ends[0] if ends else None) for k, (d, ups, p, n, first, ends) in rows.items()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def visit(points: int) -> None:
        """The conversation is a member of the node that `path` leads to."""
        depth = len(path) // 16 - 1
        key = bytes(path[-16:])
        node = held.get(key)
        if node is None:
            ups, up = [], 1
            while up <= depth:
                ups.append(bytes(path[16 * (depth - up) : 16 * (depth - up) + 16]))
                up *= 2
            node = held[key] = [depth, ups, points, 0, conv, []]
        node[3] += 1

    def ended() -> Iterator[pa.RecordBatch]:
        if conv is None:
            return
        key = bytes(path[-16:])
        if key not in held:  # emitted since the visit, which so has been counted
            visit(points)
            held[key][3] = 0
        held[key][5].append(conv)
        if len(held[key][5]) >= PACKED:
            yield packed({key: held.pop(key)})
        if len(held) >= HELD:
            yield packed(held)
            held.clear()

    for batch in batches:
        for c, digest, size, number in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            part = number
            if c != conv:
                yield from ended()
                conv, path, points = c, bytearray(ROOT), 0
                visit(points)
            if digest is None:
                continue
            points = size
            path += hashlib.blake2b(path[-16:] + digest, digest_size=16).digest()
            visit(points)
            if len(held) >= 2 * HELD:  # a long conversation
                yield packed(held)
                held.clear()
    yield from ended()
    if held:
        yield packed(held)


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of conversations given as conv_id, pos, digest and points (see `numbered_turns`), each with a row without a digest if it may have no turns."""
    dealt = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "points", F.spark_partition_id().alias("part"))
    partial = stored(dealt.mapInArrow(_walk, PARTIAL), "trie-partial")
    merged = _merged(partial)
    nodes = _rolled_up(merged)
    return Trie(nodes, partial.filter("ends is not null").select("key", "ends_from", "ends"))


def _merged(partial: DataFrame) -> DataFrame:
    """key, depth, ups, points, n_convs, conv_id."""
    width = (partial.agg(F.max("part")).first()[0] or 0) + 1
    nodes = partial.select("part", "key", "depth", "ups", "points", "n", "first")
    same = ["key", "depth", "ups", "points"]  # of one key all are one
    while True:
        width = -(-width // FAN)
        nodes = nodes.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", *same).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        if width == 1:
            return nodes.select(*same, F.col("n").alias("n_convs"), F.col("first").alias("conv_id"))


def _rolled_up(merged: DataFrame) -> DataFrame:
    merged = stored(merged, "trie-nodes")
    deepest = merged.agg(F.max("depth")).first()[0] or 0
    children = merged.filter("depth > 0").groupBy(F.col("ups")[0].alias("key")).agg(F.count("*").alias("n_children"))
    some = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    some = some.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("points"))
    k = 0
    while 1 << k <= deepest:
        some = stored(some, "trie-sums")
        below = some.filter(F.size("ups") > k).groupBy(F.col("ups")[k].alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = some.join(below, "key", "left")
        zero = F.lit(0).cast("long")
        added = added.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", zero)).withColumn("saved", F.col("saved") + F.coalesce("more_saved", zero))
        some, k = added.drop("more_leaves", "more_saved"), k + 1
    return stored(some.withColumn("parent", F.get("ups", F.lit(0))).drop("ups"), "trie-rolled")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id, the smallest member of a node's parent; the root's is null."""
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return looked_up(nodes, parents, "parent", "n_children", nodes.count())


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256, the SHA-256 of the ids that end at a node: decimal, ascending, joined by commas."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows])], ["key", "ends_sha256"])
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                told = ",".join(map(str, np.frombuffer(piece, "<i8").tolist())).encode()
                if k == key:
                    sha.update(b"," + told)
                else:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(told)
            if out:
                yield made(out)
        if key is not None:
            yield made([(key, sha.hexdigest())])

    return ends.repartition("key").sortWithinPartitions("key", "ends_from").select("key", "ends").mapInArrow(digest, "key binary, ends_sha256 string")


def node_texts(nodes: DataFrame, conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """nodes with role and text of their last turns, read off their smallest members; for tries of conversations as they stand in the table."""
    plain = conversations.select(conversations[id_col].alias("conv_id"), conversations[turn_col].alias("turn"), conversations[role_col].alias("role"), conversations[text_col].alias("text"))
    digest = F.sha2(F.concat(F.octet_length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.unhex(F.substring(digest, 1, 32)))
    turns = plain.filter("conv_id is not null").select("conv_id", F.row_number().over(order).alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")
