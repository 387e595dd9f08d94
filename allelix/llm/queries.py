"""The opN_ queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, fim, jaccard_join, near_dups, packing, quality, secret_scan, substrings, tokens, urls, warc
from .common import table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs).drop("text", "cleaned")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_round_trip(pages, keep_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output = F.col("output")
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(fim.restored(output, F.col("form"))).alias("restored_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_decontamination, op2_token_counts, op3_packing, op4_url_filters, op5_secret_scans, op6_minhash_near_dedup, op7_quality_rules, op8_chat_formatting, op9_substring_dedup, op10_warc, op11_ngram_jaccard_join, op12_fill_in_middle, op13_filter_audit)
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        rules(r_host, r_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path,
               (SELECT r_host || r_path FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC LIMIT 1) AS rule,
               coalesce((SELECT verdict FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host || r_path) DESC LIMIT 1), 'allow') AS verdict
        FROM parts""",
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
        shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s, len(s) AS n FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)""",
    "op9_substring_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(20) t(k)),
        kept AS (
            SELECT e.doc_id, count(g.p) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (g.p IS NULL), '') AS kept
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words w LEFT JOIN kept USING (doc_id)""",
    "op8_chat_formatting": r"""
        WITH said AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        whole AS MATERIALIZED (
            SELECT conv_id, count(*) AS n_turns, list(md5(role || '/' || text) ORDER BY turn) AS turns,
                   string_agg('<|' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || chr(10), '' ORDER BY turn) AS rendered FROM said GROUP BY conv_id),
        prefixes AS (SELECT DISTINCT array_to_string(turns[1:k], ',') AS p FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole))
        SELECT min(conv_id) AS conv_id, CAST(any_value(n_turns) AS BIGINT) AS n_turns, any_value(rendered) AS rendered
        FROM whole WHERE array_to_string(turns, ',') NOT IN (SELECT p FROM prefixes) GROUP BY turns""",
    "op10_warc": r"""
        WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM hashed)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT // CAST(power(32, 3 - k % 4) AS BIGINT)) % 32 AS INT), 1) FOR k IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM grouped""",
    "op11_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
        shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s, len(s) AS n FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN found USING (doc_id)""",
    "op12_fill_in_middle": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        cuts AS (
            SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM texts),
        parts AS (SELECT *, substr(text, 1, least(c1, c2)) AS p, substr(text, 1 + least(c1, c2), greatest(c1, c2) - least(c1, c2)) AS m, substr(text, 1 + greatest(c1, c2)) AS s FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op13_filter_audit": r"""
        WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id FROM documents GROUP BY 1),
        said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        flags AS MATERIALIZED (
            SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
                   regexp_matches(text, '[#$%&*|]') AS d, coalesce(first_id < doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM words JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
        grouped AS MATERIALIZED (SELECT part, [a, b, c, d, e] AS f, good, toxic, count(*) AS n FROM flags GROUP BY ALL),
        letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
                   WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
        steps AS (
            SELECT part, filter_order, k AS step, good, toxic, n, f[ascii(filter_order[k]) - 64] AS failed, len(list_filter(f, lambda x: x)) AS fails,
                   len(list_filter(range(1, k), lambda j: f[ascii(filter_order[j]) - 64])) AS before
            FROM grouped, orders, (SELECT unnest(range(1, 6)) AS k)),
        counted AS (
            SELECT part, filter_order, step, sum(CASE WHEN NOT failed AND before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND before = 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN failed AND before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN failed AND before = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
        FROM counted""",
}
