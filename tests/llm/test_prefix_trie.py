import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from sectora.llm import prefix_trie as pt
from sectora.llm.contracts import trie_report

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, n string"


def turns(rows):
    return [(*r, "own", 3, "n") for r in rows]


def paths(rows, shared):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, sha, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    if not shared:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    return out


def brute(by_conv):
    members = defaultdict(list)
    for c, path in by_conv.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        under = [sums[k] for k in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(a for a, _ in under) or int(not under), own + sum(b for _, b in under))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(by_conv[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=150, most=7):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        first = [("system", "be kind"), ("user", "hi é漢"), (None, None)][: r.randint(0, 3)]
        rest = [(r.choice(["user", "assistant", ""]), r.choice(["a", "b", "", None, "long text " * 5])) for _ in range(r.randint(0, most))]
        rows += [(c * 7 % 331 + (100 if c % 5 else 0), t if t else None, *x) for t, x in enumerate(first + rest)]
    return rows


def run(spark, rows):
    return sorted([tuple(r) for r in trie_report(spark.createDataFrame(turns(rows), SCHEMA).repartition(5)).collect()], key=str)


@pytest.mark.parametrize(("held", "packed", "fan"), [(100_000, 8_192, 64), (3, 2, 2)])
def test_rebuilt_conversations_like_brute_force(spark, monkeypatch, held, packed, fan):
    for name, value in (("HELD", held), ("PACKED", packed), ("FAN", fan)):
        monkeypatch.setattr(pt, name, value)
    more = [(-5, 1, "user", "x"), (-5, 2, "user", "y"), (None, 1, "user", "x"), (12_345, 1, "u", "only"), (12_345, 1, "u", "only"), (12_345, 1, "v", "tie"), (777_700, 3, "u", "a")]
    rows = conversations(1) + more
    assert run(spark, rows) == brute(paths(rows, True))


def test_one_beginning_in_most_conversations_and_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "PACKED", 16)
    rows = [(c, t, "user", x) for c in range(600) for t, x in enumerate(["hot", "hot too", "c" if c % 3 else f"own {c}"])]
    assert run(spark, rows) == brute(paths(rows, True))


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(pt, "HELD", 50)
    rows = [(1, t, "user", str(t)) for t in range(700)] + [(2, t, "user", str(t)) for t in range(400)] + [(2, 400, "user", "other")]
    df = spark.createDataFrame(turns(rows), SCHEMA)
    trie = pt.prefix_trie(pt.numbered_turns(df))
    want = {(r[0], r[1]): r[2:] for r in brute(paths(rows, False))}
    got = pt.with_parents(trie.nodes).join(pt.end_digests(trie.ends), "key", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or none) for r in got} == want


def test_texts_of_nodes(spark):
    rows = conversations(3, 40)
    df = spark.createDataFrame(turns(rows), SCHEMA)
    by_conv = paths(rows, False)
    for r in pt.node_texts(pt.prefix_trie(pt.numbered_turns(df)).nodes, df).collect():
        assert (r.role or "", r.text or "") == (by_conv[r.conv_id][r.depth - 1] if r.depth else ("", ""))


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []
