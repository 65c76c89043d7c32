"""One registered query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import string
import zlib

import numpy as np

from . import embedding_dedup, fingerprints, language_id, mixing, ngram_join, packing, periodic_runs, secret_scan, suffix_dedup, token_counts, token_files, url_filter, whitening
from .common import read


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words a tenth of the documents take instead of their own: a tail that repeats itself."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": lambda spark, d: url_filter.judge(read(spark, d, "pages")),
    "op2_document_fingerprints": lambda spark, d: fingerprints.fingerprints(read(spark, d, "documents")),
    "op3_ngram_join": lambda spark, d: ngram_join.join(read(spark, d, "documents")),
    "op4_secret_scans": lambda spark, d: secret_scan.scan(read(spark, d, "documents")),
    "op5_source_mixing": lambda spark, d: mixing.mix(read(spark, d, "documents")).drop("source"),
    "op6_suffix_dedup": lambda spark, d: suffix_dedup.remove(read(spark, d, "documents")),
    "op7_token_counts": lambda spark, d: token_counts.count(read(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language_id.predict(read(spark, d, "documents")),
    "op9_retrieval_packing": lambda spark, d: packing.pack(read(spark, d, "documents")),
    "op10_embedding_dedup": lambda spark, d: embedding_dedup.link(read(spark, d, "embeddings")),
    "op11_token_files": lambda spark, d: token_files.written(read(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: periodic_runs.digests(periodic_runs.collapse(read(spark, d, "documents"), planted)),
    "op13_whitening": lambda spark, d: whitening.whiten(read(spark, d, "embeddings")),
}
WORDS = r"[^\x20\x09-\x0D]+"
LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
WEIGHTS = " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in enumerate(mixing.WEIGHTS))

ORACLES: dict[str, str] = {
    "op1_url_filters": rf"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages) u),
p AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT h || s AS rule, * FROM (VALUES {RULES}) AS t(h, s, v)),
listed AS MATERIALIZED (SELECT DISTINCT host AS l FROM p WHERE host <> '' AND starts_with(md5(host), '{url_filter.LIST_PREFIX}')),
j AS (SELECT p.*, (SELECT arg_max({{'rule': rule, 'v': v}}, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS best,
  EXISTS (SELECT 1 FROM listed WHERE host = l OR ends_with(host, '.' || l)) AS listed FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j""",
    "op5_source_mixing": rf"""
WITH s AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {mixing.KEY_BITS // 4}) AS BIGINT) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {WEIGHTS} END AS w FROM s GROUP BY source),
cap AS (SELECT *, source_size::DOUBLE * {mixing.MOST_EPOCHS} AS cap, source_size::DOUBLE * {mixing.MOST_EPOCHS} / w AS ratio FROM src),
-- the share of a unit of weight is the largest of what is left after each number of full sources
unit AS (SELECT max(((SELECT sum(source_size) FROM src) - before) / behind) AS unit FROM (SELECT sum(cap) OVER o - cap AS before, sum(w) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS behind
  FROM cap WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)) x),
t AS (SELECT source, source_size, least(w * unit, cap) AS target FROM cap, unit),
p AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken FROM p""",
    "op3_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{WORDS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM w, unnest(range(1, len(w) - 3)) AS t(i)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4) x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
    JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(many.n, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id""",
}
