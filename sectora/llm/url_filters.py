"""URL filters by a temporal list join. DataFrame functions only.

A list is a log of dated entries: on `entry_date` a pattern (a host or a domain, or either with a path prefix of one segment) is put on a list or taken off
it. Entries become validity intervals: each holds from its date until the next entry of the same list and pattern. Every capture is then held against the
entries active when it was fetched: an as-of join, done as an equality join on the pattern and the month with a range condition on the date.

A capture's patterns are its host, all domains of two labels or more above it, and each of these followed by each prefix of the path that ends with a
segment; names and prefixes are exploded one after the other, so a URL's patterns are never all in one array. The host of a pattern is matched in lower
case, its path as it is; a slash at its end counts for nothing.

Intervals are spread over the months they cover, from the first to the last month of the captures, and captures over theirs: a host with a third of all
captures is parted by month, and the rest of its skew is left to Spark's skew join, which may split the captures' side. Verdicts are summed per capture
before anything else is shuffled.

Of the active entries of one list the most specific pattern decides (longest, then a block before an allow). A capture is blocked if any list blocks it.

Nulls and URLs without a host have no pattern and aren't blocked; a null fetch date matches no interval. Entries with a null list, pattern or date are
left out; of entries of one list, pattern and date the last action in order ("allow" < "block") holds. Repeated captures are judged alike. Empty tables
give no verdicts or unblocked ones. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """The lower-case host: without scheme, user, port and a leading or trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.trim(host, F.lit("."))
    return F.when(host != "", host)


def names_of(host: Column) -> Column:
    """A host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(2), n), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return F.array_distinct(F.concat(F.array(host), F.when(n >= 2, parents).otherwise(F.array().cast("array<string>"))))


def paths_of(url: Column) -> Column:
    """The empty path and the prefixes of a URL's path that end with a segment, each after a slash."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    segments = F.split(path, "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda k: F.element_at(segments, k) != "")
    return F.concat(F.array(F.lit("")), F.transform(ends, lambda k: F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, action, valid_from, valid_to (exclusive; null: until now) of dated entries (list, pattern, action, entry_date)."""
    bare = F.regexp_replace("pattern", "/+$", "")
    host = F.substring_index(bare, "/", 1)
    pattern = F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))  # paths keep their case
    known = entries.select("list", pattern.alias("pattern"), F.lower("action").alias("action"), F.col("entry_date").cast("date").alias("valid_from")).dropna(subset=["list", "pattern", "valid_from", "action"])
    known = known.groupBy("list", "pattern", "valid_from").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "pattern").orderBy("valid_from")
    return known.withColumn("valid_to", F.lead("valid_from").over(later)).select("list", "pattern", "action", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetch_date") -> DataFrame:
    """Per row of captures: page_id, url, fetch_date, host, blocked, lists (those that block it, sorted), n_entries (active entries that match)."""
    rows = captures.select(captures[id_col].alias("page_id"), captures[url_col].alias("url"), captures[date_col].cast("date").alias("fetch_date"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # what is asked: each pattern of each different URL and date, once
    asked = rows.filter("host is not null and fetch_date is not null").select("url", "fetch_date").distinct()
    asked = asked.select("url", "fetch_date", F.explode(names_of(host_of(F.col("url")))).alias("name"))
    asked = asked.select("url", "fetch_date", "name", F.explode(paths_of(F.col("url"))).alias("path"))
    asked = asked.select("url", "fetch_date", F.concat("name", "path").alias("pattern"), F.trunc("fetch_date", "month").alias("month"))
    # intervals need no months before the first or beyond the last capture
    first, last = (F.lit(d).cast("date") for d in rows.agg(F.min("fetch_date"), F.max("fetch_date")).first())
    spans = intervals(entries).withColumn("begins", F.greatest("valid_from", first)).withColumn("ends", F.least(F.date_sub("valid_to", 1), last))
    months = F.sequence(F.trunc("begins", "month"), F.trunc("ends", "month"), F.expr("interval 1 month"))
    active = spans.filter("begins <= ends").select("list", "pattern", "action", "valid_from", "valid_to", F.explode(months).alias("month"))
    held = (F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to")))
    hits = asked.join(active, ["pattern", "month"]).filter(held)
    best = F.max(F.struct(F.length("pattern").alias("size"), (F.col("action") == "block").alias("block"))).alias("best")
    by_list = hits.groupBy("url", "fetch_date", "list").agg(best, F.count("*").alias("n"))
    verdicts = by_list.groupBy("url", "fetch_date").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("best.block"), F.col("list")))), ",").alias("lists"), F.sum("n").alias("n_entries"))
    found = rows.join(verdicts, ["url", "fetch_date"], "left")
    return found.select("page_id", "url", "fetch_date", "host", (F.coalesce("lists", F.lit("")) != "").alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"))
