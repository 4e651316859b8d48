"""Exact deduplication by 128-bit content hash, with a byte comparison inside groups. DataFrame functions only.

Every text gets its SHA-256; the first 128 bits are the group key. Three passes, none of which moves texts of documents without copies while the set
of repeated hashes is small enough for Spark to broadcast it:

1. count rows per hash (partial sums before the shuffle, so a hot text is one row per task);
2. group the rows of repeated hashes by (hash, text), which compares bytes, and so finds texts that only share a hash;
3. join the verdict back to each row by hash (and by text where a hash was shared by different texts).

A hash with more than one in `HOT` of all repeated rows is hot; fewer than `HOT` can be, so their list is broadcast. Rows of a hot hash are dealt to
as many shares as it has times that many rows, wherever rows meet by hash: they are summed in each share first and then, one row a share and text, over the
shares. So a text that stands in a third of all rows is spread over a third of `HOT` shares whether or not Spark broadcasts the rest, and no share has
more than about one in `HOT` of the rows. What rows are dealt by is taken from the rows and their place in the input, never from an order that a task run
again might change.

Nulls: a null text is the empty text; a null id is never the one that stays unless all ids of the text are null. Rows that repeat both id and text are
marked alike; `exact_dedup` lets one of them through. An empty table gives an empty result. Other columns pass through `exact_dedup` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: A hash is hot if it has more than one in HOT of the repeated rows; a share of its rows has no more than that.
HOT = 1000


def _hashed(rows: DataFrame, hash_chars: int) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return rows.withColumn("text_sha256", sha).withColumn("h", F.unhex(F.substring("text_sha256", 1, hash_chars)))


def _other_digest(text: str):
    """A digest that owes nothing to the one h is cut from; tells texts apart that share h."""
    return F.sha2(F.reverse(text).cast("binary"), 256)


def _each_share() -> Column:
    """The shares that a hash's rows are dealt to."""
    return F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt")


def _dealt(hashed: DataFrame, hot: DataFrame) -> DataFrame:
    """hashed with `shares`, how many its hash has, and `salt`, the share of a row; hot: the hot hashes with their shares."""
    known = hashed.join(F.broadcast(hot.select("h", "shares")), "h", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    return known.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("shares")).cast("int"))


def text_classes(rows: DataFrame, keep: str = "min", hash_chars: int = 32) -> tuple[DataFrame, DataFrame, bool]:
    """Classes of equal texts with more than one row, as h, shares, keep_id, group_size, digest; the hot hashes; whether different texts share a hash."""
    hashed = _hashed(rows, hash_chars)
    repeated = stored(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "exact-hashes")
    total = repeated.agg(F.sum("n")).first()[0] or 1
    repeated = repeated.withColumn("shares", F.ceil(F.col("n") * HOT / total).cast("int"))
    hot = repeated.filter("shares > 1")
    pick = F.max if keep == "max" else F.min
    by_text = _dealt(hashed, hot).join(repeated.select("h", _each_share()), ["h", "salt"], "left_semi").groupBy("h", "salt", "shares", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # only hot texts have more than one share to sum over; other texts are whole already, and stay behind
    by_text = by_text.withColumn("digest", _other_digest("text")).withColumn("text", F.when(F.col("shares") > 1, F.col("text")))
    classes = by_text.groupBy("h", "shares", "digest", "text").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = stored(classes.select("h", "shares", "keep_id", "group_size", "digest"), "exact-classes")
    return classes, hot, not classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _judged(hashed: DataFrame, classes: DataFrame, hot: DataFrame, shared: bool, hint: str | None = None) -> DataFrame:
    on = ["h", "salt"]
    if shared:
        hashed, on = hashed.withColumn("digest", _other_digest("text")), [*on, "digest"]
    else:
        classes = classes.drop("digest")
    classes = classes.select("*", _each_share()).drop("shares")
    found = _dealt(hashed.drop("text"), hot).join(classes.hint(hint) if hint else classes, on, "left")
    alone = F.col("group_size").isNull()
    found = found.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
    return found.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_chars: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. keep: which id of equal texts stays, "min" or "max"."""
    rows = texts(docs, id_col, text_col)
    classes, hot, shared = text_classes(rows, keep, hash_chars)
    return _judged(_hashed(rows, hash_chars), classes, hot, shared).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each set of equal texts the one row with the smallest (or largest) id."""
    rows = texts(docs, id_col, text_col)
    classes, hot, shared = text_classes(rows, keep)
    twice = _hashed(rows, 32).groupBy("h", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    boxed = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # whole rows meet their verdicts by a merge join: one plan, and one measure of shuffle, for inputs of any size
    kept = _judged(_hashed(boxed, 32), classes, hot, shared, "merge").filter("kept")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_sha256"])
    return kept.select("row.*")
