"""License scans by diagonal voting. DataFrame functions only.

Every `gram` consecutive words of a document are hashed and joined to the positions where a template has the same hash. A match at document word p and
template word q votes for the diagonal p - q. Neighbouring diagonals (a few words added or lost) are merged into one run, and a run is verified as a span by
the share of the template's grams that stand in it in the template's order: each gram counts once, at its first place in the run, and only where that is
after the places of all grams before it. Short phrases are templates like the rest, whose diagonals aren't merged: a phrase stands where its diagonal has
all its grams, so its places are exact.

Texts are split once. The templates are a list of a few hundred words (a parameter, by default fixed), so their side of the join is broadcast; of a
document only its matches and one row that marks it are shuffled, counted per task first.

Nulls and empty texts have no words and no labels. Repeated ids with different texts are told apart by a hash of the text; rows that repeat id and text
are counted, judged once and given back as often as they stand. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases whose places are counted, with the label each stands for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening sentences of well-known notices, with the label each stands for.
NOTICES = {
    "licensed under the apache license version 2.0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4.0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
}
GRAM = 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SPLIT), "")


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_grams(spark: SparkSession, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, gram: int = GRAM) -> DataFrame:
    """template (number), q (place in it), grams (how many it has), label, phrase (or notice), t0, t1, ... (words), hash of the templates."""
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = template_words(text)
        if len(words) < gram:
            raise ValueError(f"a template of fewer than {gram} words: {text!r}")
        rows += [(number, q, len(words) - gram + 1, label, number < len(phrases), words[q : q + gram]) for q in range(len(words) - gram + 1)]
    grams = spark.createDataFrame(rows, "template int, q int, grams int, label string, phrase boolean, words array<string>")
    first = [F.col("words")[k].alias(f"t{k}") for k in range(gram)]
    return grams.select("template", "q", "grams", "label", "phrase", *first).withColumn("hash", F.xxhash64(*[f"t{k}" for k in range(gram)]))


def matches(rows: DataFrame, grams: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc_id, key, n_words, template, grams, label, phrase, q, p, copies; rows: doc_id, key, text. Each document also has a row without template.

    The words follow an absent one, which no template has: it is the document's mark, kept whether or not anything matches."""
    split = rows.select("doc_id", "key", words_of(F.col("text")).alias("words"))
    split = split.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("string")), "words").alias("words"))
    at = split.select("doc_id", "key", "n_words", "words", F.posexplode("words").alias("p", "w0"))
    at = at.select("doc_id", "key", "n_words", (F.col("p") - 1).alias("p"), "w0", *[F.get("words", F.col("p") + k).alias(f"w{k}") for k in range(1, gram)])
    at = at.withColumn("hash", F.xxhash64(*[f"w{k}" for k in range(gram)]))
    same = at["hash"] == grams["hash"]
    for k in range(gram):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    found = at.join(F.broadcast(grams), same, "left").filter("template is not null or p < 0")
    return found.groupBy("doc_id", "key", "n_words", "template", "grams", "label", "phrase", "q", "p").agg(F.count("*").alias("copies"))


def in_order(pairs: Column) -> Column:
    """How many template places of an array of (q, p) stand in order: each at its first p, counted where that is beyond those of all smaller q."""
    state = F.struct(F.lit(-1).alias("q"), F.lit(-1).alias("p"), F.lit(0).alias("n"))

    def told(s: Column, x: Column) -> Column:
        beyond = (x["q"] != s["q"]) & (x["p"] > s["p"])
        return F.struct(x["q"].alias("q"), F.when(x["q"] != s["q"], F.greatest(s["p"], x["p"])).otherwise(s["p"]).alias("p"), (s["n"] + beyond.cast("int")).alias("n"))

    return F.aggregate(F.array_sort(pairs), state, told)["n"]


def spans(found: DataFrame, drift: int = 2, least: float = 0.75) -> DataFrame:
    """doc_id, key, n_words, label, phrase, place, share, copies of verified spans; and one row a document without label.

    Neighbouring diagonals of a notice (up to `drift` words apart) are one run; each diagonal of a phrase is by itself and must be complete."""
    doc = ["doc_id", "key", "n_words"]
    by = Window.partitionBy(*doc, "template").orderBy("place", "q")
    found = found.withColumn("place", F.col("p") - F.col("q"))
    new = F.coalesce((F.col("place") - F.lag("place").over(by) > F.when(F.col("phrase"), 0).otherwise(drift)).cast("int"), F.lit(1))
    runs = found.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy(*doc, "template", "grams", "label", "phrase", "run").agg(F.min("place").alias("place"), F.collect_list(F.struct("q", "p")).alias("pairs"), F.max("copies").alias("copies"))
    share = F.when(F.col("template").isNotNull(), in_order(F.col("pairs")) / F.col("grams"))
    told = merged.select(*doc, "label", "phrase", "place", share.alias("share"), "copies")
    return told.filter(F.col("share").isNull() | (F.col("share") >= F.when(F.col("phrase"), 1.0).otherwise(least)))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, gram: int = GRAM, drift: int = 2, least: float = 0.75
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest verified share, 1 for a phrase).

    phrases and notices: text -> label; of phrases every place is counted, of notices verified spans are."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = spans(matches(rows, template_grams(docs.sparkSession, phrases, notices, gram), gram), drift, least)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    place = F.when(F.col("phrase"), F.col("place")).cast("long")
    told = found.groupBy("doc_id", "key", "n_words").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    return repeated(told, "copies").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def repeated(rows: DataFrame, copies: str, step: int = 4096) -> DataFrame:
    """Each row as often as its column `copies` says, made step by step so that no long list is held."""
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step))
    out = rows.withColumn("_step", F.explode(steps))
    return out.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col(copies) - F.col("_step") * step)))).drop("_step", "_turn")
