"""Mixing sources to target weights: every document gets a number of copies, so that each source comes to its target. DataFrame functions only.

A source's target divided by its size is the number of copies that each of its documents is expected to get. The whole part is certain; the fraction is
rounded by the pivotal method. Two documents with fractions p and q and sizes a and b are paired: either p rises and q falls, or the other way round, by as
much as makes one of them 0 or 1, so that p a + q b stays the same. The chances of the two ways are such that p and q stay the expected values. The other
one goes on to the next pair. So every document keeps its expected number of copies, and a source's mix misses its target only by the last fraction.

The pairs form a tree. Documents are dealt to leaves of about `LEAF` by a hash of what they are, largest first within a leaf; each leaf leaves at most one
fraction, `FAN` neighbouring leaves meet in a node, `FAN` nodes in the next, up to one root a source. Of each class of sizes (a power of two) in a source
about `KEPT` documents skip the tree and are paired at the root: large documents are what stays fractional, and a chain from the largest to the smallest
brings the last fraction down to a few words. It is rounded to the nearer side. A source that holds a third of all rows has a third of the leaves. Each
level is a shuffle of one row a node of the level before. All choices are taken from hashes of ids, sizes and the seed, so neither the order of rows nor a
task that runs again changes them.

Targets: sources in order of code points, null last, weigh `weights` in turn and share `share` of all sizes; no target exceeds `most` times its source, and
the excess is shared by weight among the others until none exceeds it.

Nulls: a null text has no words, null sources are one source, null ids are one id. Rows that repeat source, id and size are counted together and dealt with
as one: of n such rows with fraction p, floor(n p) get a further copy for certain and one has the rest for its fraction; which of them they are makes no
difference, and the result has a row for each. Documents without words get no further copy, sources without words get target 0. An empty table gives an
empty result. Other columns aren't read; `mix` passes them through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, looked_up, stored

#: Documents that a leaf takes on average, and nodes that meet in one of the next level.
LEAF, FAN = 64, 64
#: Documents of each class of sizes in a source that are kept for its root, on average.
KEPT = 64
#: Fractions this near to 0 or 1 are 0 or 1: what sums of doubles leave.
NEAR = 1e-12
#: Repeated rows are written out in steps of so many.
STEP = 65_536
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The number of binary digits."""
    return F.length(F.bin(size))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, doc_id, size and the number n of such rows."""
    rows = docs.select(docs[source_col].alias("source"), docs[id_col].alias("doc_id"), word_count(docs[text_col]).alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))


def source_targets(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, ratio (of the two), n_keys and classes (keys by class of size), from rows as `sized` makes them; one row a source."""
    by_class = rows.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("keys"))
    classes = F.map_from_entries(F.collect_list(F.struct("class", "keys"))).alias("classes")
    sums = by_class.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("keys").alias("n_keys"), classes)
    # numbered in order without one task for all: parts of a range, each by itself, after the counts of the parts before (one row a part)
    ranged = stored(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("part").agg(F.count("*").alias("count")).select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    named = stored(ranged.join(earlier, "part").select("source", "source_size", "n_keys", "classes", weight.alias("weight")), "mix-weights")
    level = _water_level(named, share, most)
    target = F.least(F.col("source_size") * most, F.col("weight") * level)
    return named.withColumn("target", target).withColumn("ratio", F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)).drop("weight")


def _water_level(named: DataFrame, share: float, most: float) -> float:
    """What a weight of one gets. Sources that would get more than `most` times their size get that; the others share the rest, until no source has more."""
    cap = F.col("source_size") * float(most)
    level = 0.0
    while True:
        full = (cap <= F.col("weight") * level) if level else F.lit(False)
        total, given, open_weight = named.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not total or not open_weight:
            return level
        rest = (share * total - given) / open_weight
        if rest <= level:
            return level
        level = rest


def _chance(row: Column, seed: int, level: int) -> Column:
    """A number in [0, 1) that a document and a level always get."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), row["h"]), F.lit(1 << 53)) / float(1 << 53)


def _round_pairs(rows: Column, seed: int, level: int) -> Column:
    """From an array of documents with h, words and p: the one left with a fraction (number in the array, or -1, and p) and the decided ones (number, up)."""
    decided = "array<struct<k: int, up: boolean>>"
    start = F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("p"), F.array().cast(decided).alias("done"))
    done = lambda k, up: F.array(F.struct(k.cast("int").alias("k"), up.alias("up")))

    def meet(state: Column, k: Column) -> Column:
        new = rows[k]
        whole = (new["p"] <= NEAR) | (new["p"] >= 1 - NEAR)
        first = F.struct(k.alias("k"), new["p"].alias("p"), state["done"].alias("done"))
        aside = F.struct(state["k"].alias("k"), state["p"].alias("p"), F.concat(state["done"], done(k, new["p"] > 0.5)).alias("done"))
        return F.when(whole, aside).when(state["k"] < 0, first).otherwise(let(_pair(state, rows[state["k"]], new, seed, level), lambda pair: _after(state, k, pair)))

    def _after(state: Column, k: Column, pair: Column) -> Column:
        old_done, new_done = (pair["p"] <= NEAR) | (pair["p"] >= 1 - NEAR), (pair["q"] <= NEAR) | (pair["q"] >= 1 - NEAR)
        nothing = F.array().cast(decided)
        went = F.concat(state["done"], F.when(old_done, done(state["k"], pair["p"] > 0.5)).otherwise(nothing), F.when(new_done, done(k, pair["q"] > 0.5)).otherwise(nothing))
        left = F.when(~new_done, k).when(~old_done, state["k"]).otherwise(-1).cast("int")
        return F.struct(left.alias("k"), F.when(~new_done, pair["q"]).when(~old_done, pair["p"]).otherwise(0.0).alias("p"), went.alias("done"))

    numbers = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, start, meet)


def _pair(state: Column, old: Column, new: Column, seed: int, level: int) -> Column:
    """The fractions p (of old) and q (of new) after words have moved between them; at least one is exactly 0 or 1."""
    p, q, a, b = state["p"], new["p"], old["words"], new["words"]
    rise, fall = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))  # words that can move to the old one, and from it
    rises = _chance(new, seed, level) * (rise + fall) < fall
    up_p = F.when(a * (1 - p) <= b * q, 1.0).otherwise(p + rise / a)
    up_q = F.when(b * q <= a * (1 - p), 0.0).otherwise(q - rise / b)
    down_p = F.when(a * p <= b * (1 - q), 0.0).otherwise(p - fall / a)
    down_q = F.when(b * (1 - q) <= a * p, 1.0).otherwise(q + fall / b)
    return F.struct(F.when(rises, up_p).otherwise(down_p).alias("p"), F.when(rises, up_q).otherwise(down_q).alias("q"))


def decide(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, doc_id, size, n, source_size, target, copies and extra, a row for each source, id and size: n rows have it, each gets `copies` copies, and
    `extra` of them one more."""
    rows = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    targets = stored(source_targets(rows, weights, share, most), "mix-targets")
    total, keys = targets.agg(F.sum("n_keys"), F.max("n_keys")).first()
    known = looked_up(rows, targets.withColumn("leaves", F.ceil(F.col("n_keys") / LEAF)), "source", "n_keys", total or 0)
    copies = F.floor(F.col("ratio") + NEAR).cast("long")
    mass = F.when(F.col("size") > 0, F.col("n") * F.greatest(F.col("ratio") - copies, F.lit(0.0))).otherwise(0.0)
    sure = F.floor(mass + NEAR).cast("long")
    h = F.xxhash64(F.lit(seed), "source", "doc_id", "size")
    row = F.struct((-F.col("size")).alias("order"), h.alias("h"), "doc_id", "size", "n", sure.alias("sure"), F.col("size").cast("double").alias("words"), F.greatest(mass - sure, F.lit(0.0)).alias("p"))
    shared = ["source", "source_size", "target", "copies"]
    for_root = F.pmod(F.xxhash64(F.lit(seed), h), F.lit(1 << 53)) / float(1 << 53) * F.col("classes")[size_class(F.col("size"))] < KEPT
    placed = known.select("source", "source_size", "target", copies.alias("copies"), F.pmod(h, F.col("leaves")).alias("node"), row.alias("row"), for_root.alias("for_root"))
    placed = stored(placed, "mix-placed")
    kept, nodes = (placed.filter(c).drop("for_root") for c in ("for_root", "not for_root"))
    out, width, level = [], -(-(keys or 0) // LEAF), 0
    while True:
        if width <= 1:
            nodes = nodes.unionByName(kept.withColumn("node", F.lit(0).cast("long")))
        grouped = nodes.groupBy(*shared, "node").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        met = stored(grouped.withColumn("left", _round_pairs(F.col("rows"), seed, level)), "mix-level")
        one = lambda d: F.struct(F.col("rows")[d["k"]].alias("row"), d["up"].alias("up"))
        out.append(met.select(*shared, F.explode(F.transform(F.col("left")["done"], one)).alias("d")).select(*shared, "d.*"))
        still = met.filter("left.k >= 0").select(*shared, "node", F.col("rows")[F.col("left")["k"]].withField("p", F.col("left")["p"]).alias("row"))
        if width <= 1:
            out.append(still.select(*shared, "row", (F.col("row")["p"] >= 0.5).alias("up")))
            break
        width, level = -(-width // FAN), level + 1
        nodes = still.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
    decided = out[0]
    for more in out[1:]:
        decided = decided.unionByName(more)
    return decided.select("source", "row.doc_id", "row.size", "row.n", "source_size", "target", "copies", (F.col("row")["sure"] + F.col("up").cast("long")).alias("extra"))


def copies_of(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken (words the mix takes), copies, source. options: those of `decide`."""
    groups = decide(docs, **options)
    steps = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STEP).cast("long"))))
    each = steps.withColumn("k", F.explode(F.sequence("at", F.least(F.col("at") + STEP, F.col("n")) - 1)))
    copies = F.col("copies") + (F.col("k") < F.col("extra")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, each as often as it is taken. Of rows that repeat source, id and size those with the smallest
    hashes of their texts get the further copies."""
    groups = decide(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
    boxed = docs.select(docs[source_col].alias("a"), docs[id_col].alias("b"), word_count(docs[text_col]).alias("c"), F.xxhash64(docs[text_col]).alias("t"), whole)
    on = F.col("a").eqNullSafe(F.col("source")) & F.col("b").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("size"))
    met = boxed.join(groups, on).withColumn("k", F.row_number().over(Window.partitionBy("a", "b", "c").orderBy("t")) - 1)
    copies = F.col("copies") + (F.col("k") < F.col("extra")).cast("long")
    return met.select("whole", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("whole.*")
