"""Labels matched to the codes of a classification, in stages, and groups of labels by what is known of their codes.

Tables say what stands for what; none is packaged. Every stage is part of one join on folded names, from which each label's best stage is kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import WrongInput

#: A code's names in several classifications (ISO codes, short names, the spelling of a source ...).
NAMES = "classification string, name string, code string"
#: Names of whole groups of codes, a row for each member.
GROUPS = "alias string, code string"
#: What is known of codes: a group of each scheme (continent, OECD ...).
FACTS = "code string, scheme string, group string"


def folded(c: Column) -> Column:
    """A name without the differences that don't count: case, white space around it and how much stands inside."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def match_labels(labels: DataFrame, names: DataFrame, groups: DataFrame | None = None, order: Iterable[str] = ()) -> DataFrame:
    """label, stage, classification, code of all distinct labels (column label; null ones are left out).

    Stages, the first that finds something counts: "group" (the label is the name of a group, one row for each member), then for each classification of
    `order` (all by name, if it is empty) "exact" and "folded". A label whose best stage gives several codes without being a group is "ambiguous", one
    that nothing finds is "unmatched"; both have no code."""
    wanted = labels.select("label").dropna().distinct().withColumn("key", folded(F.col("label")))
    order = list(order)
    known = names.select("classification", "name", "code").dropna().distinct()
    if order:
        ranks = names.sparkSession.createDataFrame(list(enumerate(order)), "place int, classification string")
        known = known.join(ranks, "classification")
    else:
        ranks = known.select("classification").distinct().withColumn("place", F.rank().over(Window.orderBy("classification")))
        known = known.join(ranks, "classification")
    known = known.withColumn("key", folded(F.col("name")))
    exact = F.col("label") == F.col("name")
    rank = F.lit(2) * F.col("place") + F.when(exact, 1).otherwise(2)
    found = wanted.join(known, "key").select("label", rank.alias("rank"), F.when(exact, "exact").otherwise("folded").alias("stage"), "classification", "code")
    if groups is not None:
        members = groups.select(folded(F.col("alias")).alias("key"), "code").dropna()
        whole = wanted.join(members, "key").select("label", F.lit(-1).alias("rank"), F.lit("group").alias("stage"), F.lit(None).cast("string").alias("classification"), "code")
        found = found.unionByName(whole)
    best = found.distinct().withColumn("best", F.min("rank").over(Window.partitionBy("label"))).filter("rank = best")
    one = best.groupBy("label", "stage", "classification").agg(F.collect_set("code").alias("codes"))
    clear = (F.col("stage") == "group") | (F.size("codes") == 1)
    told = one.select("label", F.when(clear, F.col("stage")).otherwise("ambiguous").alias("stage"), "classification", F.when(clear, F.sort_array("codes")).alias("codes"))
    out = wanted.select("label").join(told, "label", "left").withColumn("stage", F.coalesce("stage", F.lit("unmatched")))
    return out.select("label", "stage", "classification", F.explode_outer("codes").alias("code"))


def coverage(matches: DataFrame) -> DataFrame:
    """stage, n_labels, n_codes of `match_labels`."""
    return matches.groupBy("stage").agg(F.countDistinct("label").alias("n_labels"), F.countDistinct("code").alias("n_codes"))


def single(matches: DataFrame) -> DataFrame:
    """label, code of labels that stand for one code."""
    return matches.dropna(subset=["code"]).groupBy("label").agg(F.min("code").alias("code"), F.countDistinct("code").alias("n")).filter("n = 1").select("label", "code")


def groups_of(matches: DataFrame, facts: DataFrame, scheme: str) -> DataFrame:
    """source, target: the map for `structure.aggregate` of a scheme; labels without a single code, or whose code has no group there, keep their names."""
    wanted = facts.filter(folded(F.col("scheme")) == folded(F.lit(scheme))).select("code", "group").dropna().distinct()
    if wanted.isEmpty():
        raise WrongInput(f"nothing is known of {scheme!r}")
    if not wanted.groupBy("code").count().filter("count > 1").isEmpty():
        raise WrongInput(f"{scheme!r} puts a code into several groups")
    return single(matches).join(wanted, "code").select(F.col("label").alias("source"), F.col("group").alias("target"))


def clusters_of(matches: DataFrame, facts: DataFrame) -> dict[str, tuple[str, ...]]:
    """Clusters for `Model.with_clusters`: "all", and a group of every scheme ("scheme:group", or its name alone where both are the same)."""
    known = single(matches).join(facts.dropna().distinct(), "code")
    name = F.when(F.col("scheme") == F.col("group"), F.col("group")).otherwise(F.concat_ws(":", "scheme", "group"))
    rows = known.select(name.alias("name"), "label").distinct().collect()  # labels of one set and their groups
    out: dict[str, list[str]] = {"all": [r["label"] for r in matches.select("label").distinct().collect()]}
    for r in rows:
        out.setdefault(r["name"], []).append(r["label"])
    return {k: tuple(sorted(v)) for k, v in out.items()}
