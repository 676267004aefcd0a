"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import divergence, katz, language, manifest, media, mixing, nearest, passages, pieces, pii, quality, repeats, simhash


def _table(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": _table("documents", media.media_query),
        "op2_near_passages": _table("documents", passages.passages_query),
        "op3_nearest_neighbours": _table("embeddings", nearest.nearest_query),
        "op4_language_id": _table("documents", language.language_query),
        "op5_source_mixing": _table("documents", mixing.mixing_query),
        "op6_simhash": _table("documents", simhash.simhash_query),
        "op7_sentence_pieces": _table("documents", pieces.pieces_query),
        "op8_katz_backoff": _table("documents", katz.katz_query),
        "op9_personal_data": _table("documents", pii.pii_query),
        "op10_repeat_removal": _table("documents", repeats.repeats_query),
        "op11_merkle_manifest": _table("documents", manifest.manifest_query),
        "op12_quality_rules": lambda spark, sf_dir: quality.quality_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op13_source_divergence": _table("documents", divergence.divergence_query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_nearest_neighbours": """
WITH ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
        "op11_merkle_manifest": """
WITH RECURSIVE field AS (
  SELECT doc_id, lang, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS d,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed
  FROM field),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
node AS (
  SELECT 0 AS level, lang, i, n, d FROM placed
  UNION ALL
  SELECT level + 1, lang, i // 8, max(n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY level, lang, i // 8),
sub AS (SELECT lang, d, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
over AS (
  SELECT 0 AS level, i, n, d FROM sub
  UNION ALL
  SELECT level + 1, i // 8, max(n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // 8),
climb AS (
  SELECT i AS leaf_at, lang, 0 AS level, i, n, '' AS proof, coalesce(changed, d) AS now FROM placed
  UNION ALL
  SELECT c.leaf_at, c.lang, c.level + 1, any_value(c.i) // 8, any_value(c.n + 7) // 8,
    any_value(c.proof) || coalesce(string_agg(CASE WHEN x.i <> c.i THEN x.d END, '' ORDER BY x.i), ''),
    sha256(string_agg(CASE WHEN x.i = c.i THEN c.now ELSE x.d END, '' ORDER BY x.i))
  FROM climb c JOIN node x ON x.level = c.level AND x.lang IS NOT DISTINCT FROM c.lang AND x.i // 8 = c.i // 8
  WHERE c.n > 1 GROUP BY c.leaf_at, c.lang, c.level),
high AS (
  SELECT c.leaf_at, c.lang, 0 AS level, s.i, s.n, c.proof, c.now FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.leaf_at, c.lang, c.level + 1, any_value(c.i) // 8, any_value(c.n + 7) // 8,
    any_value(c.proof) || coalesce(string_agg(CASE WHEN x.i <> c.i THEN x.d END, '' ORDER BY x.i), ''),
    sha256(string_agg(CASE WHEN x.i = c.i THEN c.now ELSE x.d END, '' ORDER BY x.i))
  FROM high c JOIN over x ON x.level = c.level AND x.i // 8 = c.i // 8
  WHERE c.n > 1 GROUP BY c.leaf_at, c.lang, c.level)
SELECT p.doc_id, p.d AS leaf, s.d AS subroot, r.d AS root, sha256(h.proof) AS proof_sha256, h.now AS folded_root, h.now = r.d AS verified
FROM placed p JOIN high h ON h.leaf_at = p.i AND h.lang IS NOT DISTINCT FROM p.lang AND h.n = 1
JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT d FROM over WHERE n = 1) r
""",
        "op12_quality_rules": lambda spark, sf_dir: quality.quality_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op13_source_divergence": r"""
WITH token AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
word AS (SELECT row, lang, source, unnest(found) AS term FROM token),
kept AS (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
pair_of AS (SELECT DISTINCT lang, source FROM token),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM word w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
mass AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(m.n, 0) + 5 * l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS BIGINT) AS q
  FROM pair_of g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN mass m ON m.lang = g.lang AND m.source = g.source
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
away AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM pair_of a JOIN pair_of b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN away d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
WHERE part = 'pair' OR rank <= 50
""",
    }
