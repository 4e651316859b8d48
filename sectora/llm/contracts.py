"""The registered queries of the operators on runs, conversations and mixtures, and the SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import periodic_runs, prefix_trie
from .common import let, stored, texts

#: Words, as a regular expression of the JVM.
WORDS = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; of every tenth id by hash, the words from a fixed place on become repetitions of the words there. A null id counts as ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = (h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + ((n - a) / (3 + g % 8)).cast("long")).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), F.greatest(n - a, F.lit(0)).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")

    planted = let(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), repeated)
    return texts(docs).select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def _run_digest(rows: list[periodic_runs.Row]) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    best = [max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]), default=None) for _, _, runs, _ in rows]
    longs = lambda values: pa.array(values, pa.int64())
    return [
        longs([len(runs) for _, _, runs, _ in rows]),
        *(longs([r and r[k] for r in best]) for k in range(3)),
        longs([r and 1000 * r[1] // r[2] for r in best]),
        pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()) for _, _, runs, _ in rows]),
        pa.array([sha(kept) for *_, kept in rows]),
    ]


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest run, digests of all runs and of the text without repetitions."""
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return periodic_runs.collapse_runs(with_planted_runs(docs), shortest=12, columns=_run_digest, schema=schema)


def with_shared_beginnings(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, digest, points) of rebuilt conversations: conversation c takes the first crc32(c) % 6 turns of conversation c - c % 100, all it
    has if these are fewer, then its own turns beyond as many. A row at position 0, without a digest, stands for the conversation itself."""
    own = stored(prefix_trie.numbered_turns(conversations), "turns")
    taken = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    none = own.schema["digest"].dataType
    all_ids = own.filter("pos = 1").select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = own.filter("pos < 6 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    # at most 199 conversations have one base, and each takes five turns of it at most
    begun = all_ids.join(heads, "base").filter("pos <= h").select("conv_id", "pos", "digest", "points")
    there = all_ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast(none).alias("digest"), F.lit(0).cast("long").alias("points"))
    return there.unionByName(begun).unionByName(own.filter(F.col("pos") > taken))


def trie_report(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations."""
    trie = prefix_trie.prefix_trie(with_shared_beginnings(conversations))
    nodes = prefix_trie.with_parents(trie.nodes).join(prefix_trie.end_digests(trie.ends), "key", "left")
    no_ends = F.lit(hashlib.sha256(b"").hexdigest())
    long = lambda c: F.col(c).cast("long")
    return nodes.select(
        "conv_id", long("depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", no_ends).alias("ends_sha256"),
    )


#: Unsigned CRC-32 of an id's decimal digits, which DuckDB hasn't got: the bits of each byte are taken out of the polynomial one by one.
def _crc32_sql(column: str) -> str:
    digits = f"list_transform(range(1, 1 + length(CAST({column} AS VARCHAR))), lambda k: CAST(ascii(substr(CAST({column} AS VARCHAR), k, 1)) AS BIGINT))"
    bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: 0::BIGINT)), lambda v, z: {bit})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {byte}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""
        WITH split AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_crc32_sql("doc_id")} AS h FROM documents
        ), placed AS (
            SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM split
        ), docs AS (
            SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM placed
        ), starts AS (
            SELECT rid, w, unnest(range(greatest(n - 5, 0))) AS i FROM docs
        ), grams AS (
            SELECT rid, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM starts
        ), alike AS (
            SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.gram = y.gram AND x.i < y.i
        ), stretches AS (
            SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM alike
        ), ends AS (
            SELECT rid, q, min(i) AS s, max(i) + 6 + q AS e FROM stretches GROUP BY rid, q, island
        ), runs AS (
            SELECT rid, s, e - s AS n, min(q) AS q FROM ends WHERE e - s >= greatest(12, 2 * q) GROUP BY rid, s, e
        ), by_doc AS (
            SELECT rid, count(*) AS n_runs, arg_max({{'s': s, 'n': n, 'q': q}}, [n, -s, -q]) AS best, list({{'s': s, 'n': n, 'q': q}}) AS all_runs,
                   string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS told
            FROM runs GROUP BY rid
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
               CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN all_runs IS NULL THEN w ELSE list_filter(w, lambda x, k: len(list_filter(all_runs, lambda r: k - 1 >= r.s + r.q AND k - 1 < r.s + r.n)) = 0) END, ' ')) AS collapsed_sha256
        FROM docs LEFT JOIN by_doc USING (rid)
    """,
    "op12_prefix_trie": f"""
        WITH numbered AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM numbered)
        ), rebuilt AS (
            SELECT ids.conv_id, pos, role, text FROM ids JOIN numbered ON numbered.conv_id = ids.base AND pos <= h
            UNION ALL SELECT conv_id, pos, role, text FROM ids JOIN numbered USING (conv_id) WHERE pos > h
        ), paths AS (
            SELECT ids.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id
        ), members AS (
            SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM paths
        ), nodes AS (
            SELECT path[:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends
            FROM members GROUP BY ALL
        ), children AS (
            SELECT node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), valued AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].t) END AS saved FROM nodes LEFT JOIN children USING (node)
        ), above AS (
            SELECT node[:up] AS node, n_children, saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM valued)
        ), sums AS (
            SELECT node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node
        )
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM valued v JOIN sums USING (node) LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.node[:v.depth - 1]
    """,
}
