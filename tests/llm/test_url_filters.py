import datetime as dt
import random
import re
from collections import Counter

from sectora.llm.url_filters import intervals, judge

CAPTURES = "page_id long, url string, fetch_date date, list string, pattern string, month date"
ENTRIES = "list string, pattern string, action string, entry_date date, url string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def names(url):
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
    host = m[1].strip(".") if m else ""
    if not host:
        return None, []
    labels = host.split(".")
    found = {host} | {".".join(labels[-k:]) for k in range(2, len(labels) + 1)}
    path = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", url)[1].split("/")
    return host, found | {f"{n}/{'/'.join(path[: k + 1])}" for n in found for k in range(len(path)) if path[k]}


def brute(captures, entries):
    log = {}
    for name, pattern, action, date, _ in entries:
        if None not in (name, pattern, action, date):
            host, slash, path = pattern.rstrip("/").partition("/")
            k = (name, host.lower() + slash + path, date)
            log[k] = max(log.get(k, ""), action.lower())
    out = Counter()
    for page, url, date, *_ in captures:
        host, found = names(url)
        active, n = {}, 0
        for p in found:
            for name in {k[0] for k in log}:
                dates = [d for (l, q, d) in log if l == name and q == p and date is not None and d <= date]
                if dates:
                    n += 1
                    action = log[(name, p, max(dates))]
                    active[name] = max(active.get(name, (0, False)), (len(p), action == "block"))
        lists = ",".join(sorted(k for k, (_, block) in active.items() if block))
        out[(page, url, date, host, lists != "", lists, n)] += 1
    return out


def test_like_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "A.Example.com", "one", "1.2.3.4", ".".join("abcdefghijk")]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80', '.'])}{r.choice(['', '/', '/fr', '/fr/x', '/fr//x/', '/Fr/x/Y/z', '/en?a=/b', '?q', '#f'])}" for _ in range(300)]
    captures = [(i, u, day(r.randint(0, 400)), "l", "p", None) for i, u in enumerate(urls)]
    captures += [(900, None, day(3), *[None] * 3), (901, urls[0], None, *[None] * 3), (902, "no url", day(9), *[None] * 3), (None, urls[1], day(9), *[None] * 3), captures[0], captures[0]]
    entries = [(r.choice(["ads", "spam"]), r.choice(["a.example.com", "EXAMPLE.com", "x.org", "example.com/fr", "a.example.com/en", "one", "j.k", "3.4", "Example.com/Fr", "example.com/Fr/x/Y", "example.com/fr/x/", "x.org/fr//x", "b.c.d.e.f.g.h.i.j.k"]), r.choice(["block", "allow", "Block"]), day(r.randint(-30, 380)), "") for _ in range(60)]
    entries += [(None, "x.org", "block", day(1), ""), ("ads", None, "block", day(1), ""), ("ads", "x.org", "block", None, ""), entries[0]]
    got = judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert Counter(tuple(x) for x in got.collect()) == brute(captures, entries)


def test_entries_become_intervals(spark):
    log = [("l", "x.org", "block", day(5), ""), ("l", "X.org", "allow", day(9), ""), ("l", "x.org", "block", day(9), "")]
    got = sorted((x.action, x.valid_from, x.valid_to) for x in intervals(spark.createDataFrame(log, ENTRIES)).collect())
    assert got == [("block", day(5), day(9)), ("block", day(9), None)]


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://x.org", day(3), None, None, None)], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert [x.blocked for x in judge(captures, entries).collect()] == [False]
    assert judge(spark.createDataFrame([], CAPTURES), spark.createDataFrame([("l", "x.org", "block", day(1), "")], ENTRIES)).count() == 0


def test_paths_keep_their_case(spark):
    captures = [(i, f"http://Example.com{path}", day(3), None, None, None) for i, path in enumerate(["/Private/x", "/private/x", "/Open"])]
    entries = [("l", "EXAMPLE.com/Private", "block", day(1), ""), ("l", "example.com", "allow", day(1), "")]
    got = judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {x.page_id: (x.blocked, x.n_entries) for x in got} == {0: (True, 2), 1: (False, 1), 2: (False, 1)}


def test_parents_and_paths_of_any_length(spark):
    captures = [(0, "http://a.b.c.d.e.f.g.h.i.j.k/1/2/3/4/5?q", day(3), None, None, None)]
    entries = [("l", "b.c.d.e.f.g.h.i.j.k", "allow", day(1), ""), ("l", "j.k/1/2/3/4", "block", day(1), ""), ("m", "c.d.e.f.g.h.i.j.k/1/2/3/4/5", "block", day(1), "")]
    got = judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).first()
    assert (got.lists, got.n_entries) == ("m", 3)


def test_intervals_far_from_the_captures(spark):
    captures = [(i, "http://x.org/", day(n), None, None, None) for i, n in enumerate((40, 41, 120))]
    entries = [("l", "x.org", "block", day(-9000), ""), ("l", "x.org", "allow", day(41), ""), ("l", "x.org", "block", day(9000), ""), ("m", "x.org", "block", day(-50), ""), ("m", "x.org", "allow", day(-40), "")]
    got = judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert {x.page_id: (x.blocked, x.n_entries) for x in got.collect()} == {0: (True, 2), 1: (False, 2), 2: (False, 2)}
