"""The registered queries of the operators, with production parameters over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from . import bpe, contracts, decontaminate, exact_dedup, license_scan, maxent, mixing, quality, simhash, substring_dedup, toxicity, url_filters
from .common import modest_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.5)


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages has no fetch dates; each page gets a day of two years from its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetch_date"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """A log of list entries for the hosts of the captures, by a fixed rule: hosts are put on, taken off and put back on the list `abuse`, their domains of
    three labels on `spam`, and host and first path segment on `paths`, to block or to allow."""
    host = url_filters.host_of(F.col("url"))
    segment = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    hosts = captures.select(host.alias("host"), segment.alias("segment")).filter("host is not null").distinct()
    day = lambda c: F.length(c) * 37 + F.ascii(c) * 11 + F.ascii(F.substring(c, 4, 1)) * 5
    on = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    domain = F.element_at(F.split("host", r"\."), -3)
    entry = lambda name, pattern, action, date: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), action.alias("action"), date.alias("entry_date"))
    h, d, p = F.col("host"), F.concat(domain, F.lit("."), F.substring_index("host", ".", -2)), F.concat("host", F.lit("/"), "segment")
    block, allow = F.lit("block"), F.lit("allow")
    log = F.array(
        entry("abuse", h, block, on(day(h) % 500)), entry("abuse", h, allow, on(day(h) % 500 + 120)), entry("abuse", h, block, on(day(h) % 500 + 400)),
        entry("spam", d, block, on(day(d) % 300)), entry("spam", d, allow, on(day(d) % 300 + 200)),
        entry("paths", p, F.when(F.ascii("segment") % 2 == 0, block).otherwise(allow), on(day(p) % 600)),
    )
    return hosts.select(F.explode(log).alias("e")).select("e.*").filter("pattern is not null").distinct()


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(table(spark, sf_dir, "pages"))
    return url_filters.judge(captures, dated_entries(captures)).withColumn("fetch_date", F.col("fetch_date").cast("string"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"), folds=7, held=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.7)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _token_digest(doc_ids: list, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    columns = [pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([*map(sha, ids)]), pa.array([sha(x.encode()) for x in decoded])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def tokenize(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the tokenizer is byte_bpe_50k.json unless a path is given."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(docs, tokenizer_path, _token_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)


def _kept_digest(doc_ids: pa.Array, n_words: list[int], n_removed: list[int], kept: list[bytes]) -> pa.RecordBatch:
    columns = [doc_ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13, row=_kept_digest, schema="doc_id long, n_words long, n_removed long, kept_sha256 string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.run_report(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.trie_report(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies_of(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity, "op2_url_filters": op2_url_filters, "op3_lm_scoring": op3_lm_scoring, "op4_license_scan": op4_license_scan,
    "op6_quality": op6_quality, "op5_exact_dedup": op5_exact_dedup, "op7_decontamination": op7_decontamination, "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash, "op10_substring_dedup": op10_substring_dedup, "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie, "op13_mixing": op13_mixing,
}

_TEMPLATES = ", ".join(
    f"({number}, {q}, {len(words)}, '{words[q]}', '{words[q + 1]}', '{label}', {str(number < len(license_scan.PHRASES)).lower()})"
    for number, (text, label) in enumerate([*license_scan.PHRASES.items(), *license_scan.NOTICES.items()])
    for words in [license_scan.template_words(text)]
    for q in range(len(words) - 1)
)

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": r"""
        WITH captures AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS fetch_date,
                   nullif(trim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.'), '') AS host,
                   regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
            FROM pages
        ), hosts AS (
            SELECT DISTINCT host, segment, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS three, length(host) - length(replace(host, '.', '')) AS dots
            FROM captures WHERE host IS NOT NULL
        ), named AS (
            SELECT host AS pattern, 'abuse' AS list, ascii('x') AS k, segment FROM hosts
            UNION ALL SELECT three, 'spam', 0, segment FROM hosts WHERE dots >= 2
            UNION ALL SELECT host || '/' || segment, 'paths', 0, segment FROM hosts
        ), days AS (
            SELECT *, length(pattern) * 37 + ascii(pattern) * 11 + ascii(substr(pattern, 4, 1)) * 5 AS n FROM named
        ), entries AS (
            SELECT list, pattern, 'block' AS action, DATE '2024-01-01' + CAST(n % 500 AS INTEGER) AS entry_date FROM days WHERE list = 'abuse'
            UNION SELECT list, pattern, 'allow', DATE '2024-01-01' + CAST(n % 500 + 120 AS INTEGER) FROM days WHERE list = 'abuse'
            UNION SELECT list, pattern, 'block', DATE '2024-01-01' + CAST(n % 500 + 400 AS INTEGER) FROM days WHERE list = 'abuse'
            UNION SELECT list, pattern, 'block', DATE '2024-01-01' + CAST(n % 300 AS INTEGER) FROM days WHERE list = 'spam'
            UNION SELECT list, pattern, 'allow', DATE '2024-01-01' + CAST(n % 300 + 200 AS INTEGER) FROM days WHERE list = 'spam'
            UNION SELECT list, pattern, CASE WHEN ascii(segment) % 2 = 0 THEN 'block' ELSE 'allow' END, DATE '2024-01-01' + CAST(n % 600 AS INTEGER) FROM days WHERE list = 'paths'
        ), known AS (
            SELECT list, pattern, entry_date AS valid_from, max(action) AS action FROM entries GROUP BY ALL
        ), spans AS (
            SELECT *, lead(valid_from) OVER (PARTITION BY list, pattern ORDER BY valid_from) AS valid_to FROM known
        ), names AS (
            SELECT DISTINCT url, fetch_date, name FROM (
                SELECT url, fetch_date, host AS name FROM captures WHERE host IS NOT NULL
                UNION ALL
                SELECT url, fetch_date, array_to_string(list_slice(string_split(host, '.'), -k, -1), '.')
                FROM captures, unnest(range(2, length(host) - length(replace(host, '.', '')) + 2)) AS r(k) WHERE host IS NOT NULL
            )
        ), segments AS (
            SELECT DISTINCT url, string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') AS parts FROM captures
        ), paths AS (
            SELECT url, '' AS path FROM segments
            UNION ALL SELECT url, '/' || array_to_string(list_slice(parts, 1, k), '/') FROM segments, unnest(range(1, len(parts) + 1)) AS r(k) WHERE parts[k] <> ''
        ), asked AS (
            SELECT url, fetch_date, name || path AS pattern FROM names JOIN paths USING (url)
        ), by_list AS (
            SELECT url, fetch_date, list, arg_max(action, length(asked.pattern) * 2 + CAST(action = 'block' AS INTEGER)) AS action, count(*) AS n
            FROM asked JOIN spans ON asked.pattern = spans.pattern AND fetch_date >= valid_from AND (valid_to IS NULL OR fetch_date < valid_to)
            GROUP BY ALL
        ), verdicts AS (
            SELECT url, fetch_date, coalesce(string_agg(list, ',' ORDER BY list) FILTER (WHERE action = 'block'), '') AS lists, sum(n) AS n_entries FROM by_list GROUP BY ALL
        )
        SELECT page_id, url, CAST(fetch_date AS VARCHAR) AS fetch_date, host, coalesce(lists, '') <> '' AS blocked, coalesce(lists, '') AS lists, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries
        FROM captures LEFT JOIN verdicts USING (url, fetch_date)
    """,
    "op4_license_scan": r"""
        WITH grams(template, q, length, t0, t1, label, phrase) AS (VALUES """
    + _TEMPLATES
    + r"""), split AS (
            SELECT doc_id, row_number() OVER () AS rid,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
            FROM documents
        ), placed AS (
            SELECT rid, unnest(words) AS w0, unnest(list_concat(words[2:], [NULL])) AS w1, unnest(range(len(words))) AS p FROM split WHERE len(words) > 0
        ), hits AS (
            SELECT rid, template, length, label, phrase, q, p, p - q AS place FROM placed JOIN grams ON w0 = t0 AND w1 = t1
        ), marked AS (
            SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY rid, template ORDER BY place, q) <= 2 THEN 0 ELSE 1 END AS new FROM hits WHERE NOT phrase
        ), runs AS (
            SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY place, q ROWS UNBOUNDED PRECEDING) AS run FROM marked
        ), firsts AS (
            SELECT rid, template, run, q, length, label, min(p) AS p, min(place) AS place FROM runs GROUP BY ALL
        ), ordered AS (
            SELECT *, p > coalesce(max(p) OVER (PARTITION BY rid, template, run ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS beyond FROM firsts
        ), found AS (
            SELECT rid, place, label, true AS base, 1.0::DOUBLE AS share FROM hits WHERE phrase GROUP BY rid, template, place, label, length HAVING count(*) = length - 1
            UNION ALL
            SELECT rid, min(place), label, false, count(*) FILTER (WHERE beyond)::DOUBLE / (length - 1) FROM ordered GROUP BY rid, template, length, label, run
            HAVING count(*) FILTER (WHERE beyond)::DOUBLE / (length - 1) >= 0.75
        ), by_doc AS (
            SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM found GROUP BY rid
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
        FROM split LEFT JOIN by_doc USING (rid)
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    **contracts.ORACLE_SQL,
}
