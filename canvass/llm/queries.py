"""The queries of this subpackage, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, katz_lm, license_scan, line_dedup, ngram_join, packing, quality_rules, repeated_spans, source_mixing, token_files
from .storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_digest(spark, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_table(spark, sf_dir, "documents"))


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score(_table(spark, sf_dir, "documents"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digest(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its domains' posteriors, its rate and its copies."""
    return source_mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_katz_lm": op7_katz_lm,
    "op8_repeated_spans": op8_repeated_spans,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(vec_id, root) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
        ), roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT r.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
        FROM roots r LEFT JOIN counts c ON c.vec_id = r.vec_id
    """,
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)
        ), reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op8_repeated_spans": r"""
        WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        starts AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 399))) AS pos FROM h)),
        again AS (SELECT doc_id, pos FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
        edges AS (SELECT doc_id, pos, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1000) + 400 AS opens FROM again),
        runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 400 AS b FROM (SELECT doc_id, pos, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges) GROUP BY doc_id, run),
        gaps AS (
            SELECT r.doc_id, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS f, a AS t FROM runs r
            UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id
        ), kept AS (
            SELECT g.doc_id, string_agg(substr(h.h, 2 * f + 1, 2 * (least(t, len(h.h) // 2) - f)), '' ORDER BY f) AS k FROM gaps g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id
        ), sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
        SELECT h.doc_id, CAST(len(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.k, h.h))) AS kept_sha256
        FROM h LEFT JOIN sums s ON s.doc_id = h.doc_id LEFT JOIN kept k ON k.doc_id = h.doc_id
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
        ), repeated AS (
            SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT l.doc_id, l.line, l.pos, r.last IS NOT NULL AND r.last <> l.doc_id AS gone FROM keyed l LEFT JOIN repeated r ON l.k = r.k
        )
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
