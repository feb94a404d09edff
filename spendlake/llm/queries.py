"""Registered queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, licences, mix, neardup, packing, quality, rlz, runs, site_tree, suffix_array, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that stand in another document too."""
    return suffix_array.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto order sample of the documents to the sources' target sizes."""
    return mix.mix_report(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document."""
    out = decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("spans", "items")


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return site_tree.extract_pages(_table(spark, sf_dir, "pages"))


def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matching licence of each document."""
    return licences.licence_report(_table(spark, sf_dir, "documents"))


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into rows."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside repeated 35-word windows of each document."""
    return rlz.parsed_documents(_table(spark, sf_dir, "documents")).drop("spans")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of each document."""
    return neardup.near_duplicate_groups(_table(spark, sf_dir, "documents")).drop("th")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of each document."""
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's URL."""
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, by language."""
    return audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archives written from all pages."""
    path = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each document, after the repeating tails of a tenth of them."""
    return runs.run_digest(runs.periodic_runs(_table(spark, sf_dir, "documents"), prepare=runs.echo_words))


REGISTRY = {
    f.__name__: f
    for f in (op1_suffix_array, op2_mix_sources, op3_decontaminate, op4_extract_html, op5_scan_licenses, op6_pack_tokens,
              op7_rlz_dedup, op8_near_duplicates, op9_quality_rules, op10_url_filter, op11_filter_audit, op12_warc_archives,
              op13_periodic_runs)
}

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _windows(size: int) -> str:
    return f"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + {size - 1}], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS s FROM w WHERE len(ws) >= {size}))"""


ORACLE = {
    "op1_suffix_array": f"""
WITH {_windows(50)},
shared AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win WHERE h IN (SELECT h FROM shared)),
runs AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM pos),
spans AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM runs GROUP BY doc_id, g)
SELECT spans.doc_id, CAST(a AS BIGINT) AS start_word, CAST(b AS BIGINT) AS end_word, CAST(b - a AS BIGINT) AS n_words,
       sha256(array_to_string(ws[a + 1:b], ' ')) AS sha256
FROM spans JOIN w ON spans.doc_id = w.doc_id""",
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS t
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (SELECT doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') AS t
        FROM (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS s FROM d, lens WHERE len(ws) >= m)),
hit AS (SELECT doc_id, s, win.m, item_id FROM win JOIN pat ON win.m = pat.m AND win.t = pat.t),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op7_rlz_dedup": f"""
WITH {_windows(35)},
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win WHERE h IN (SELECT h FROM twice)),
gone AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t
         FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) x
         WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.doc_id = x.doc_id AND pos.p = x.p) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op8_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[s:s + 4], ' ')) AS x
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN size ON d.doc_id = size.doc_id
JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id""",
    "op11_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             MAP {{'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
                  'C': 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * len(d.text),
                  'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(first_id < d.doc_id, false)}} AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id JOIN first ON d.text = first.text),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c)
      JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT part, filter_order, step, filter_order[step] AS letter, fails[filter_order[step]] AS own, n, good, toxic,
             list_bool_or([false] || [fails[filter_order[i]] FOR i IN range(1, step)]) AS gone,
             list_sum([CAST(v AS INT) FOR v IN map_values(fails)]) AS n_fails FROM g, s),
r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed,
             sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND n_fails = 1) AS unique_fails,
             sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost
      FROM t GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r""",
    "op12_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, strlen(html) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN top END AS refers_to
FROM r""",
}
