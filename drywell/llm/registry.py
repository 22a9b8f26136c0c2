"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .fingerprint import op9_iblt_fingerprints
from .kdtree import op11_centroid_clustering
from .kdtree import sql as clustering_sql
from .media import documents_interleaved, op7_media_columns, pages_interleaved
from .mixing import op3_source_mixing
from .packing import op5_best_fit_packing
from .pieces import op13_sentencepiece
from .quality import op6_quality_classifier
from .repair import op1_repair_tokens
from .simhash import op10_simhash_near_dedup
from .toxicity import op8_toxicity
from .warc import op4_zip_warc
from .wordpiece import op2_token_counts

QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_token_counts": op2_token_counts,
    "op3_source_mixing": op3_source_mixing,
    "op4_zip_warc": op4_zip_warc,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_media_columns": op7_media_columns,
    "op8_toxicity": op8_toxicity,
    "op9_iblt_fingerprints": op9_iblt_fingerprints,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_sentencepiece": op13_sentencepiece,
    "documents_interleaved": documents_interleaved,
    "pages_interleaved": pages_interleaved,
}
#: SQL where it can express an operator.
ORACLES: dict[str, str] = {
    "op4_zip_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op11_centroid_clustering": clustering_sql(),
    "documents_interleaved": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
        p AS (SELECT doc_id, n + CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS size, text || repeat(' ', CAST(CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS BIGINT)) AS payload FROM t)
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS page_id, count(*) + 1 AS n_text, count(*) AS n_media, CAST(sum(size) AS BIGINT) AS payload_bytes,
               sha256(string_agg(sha256(payload), ',' ORDER BY doc_id)) AS payloads_sha256, string_agg('text ' || doc_id, '; ' ORDER BY doc_id) AS captions
        FROM p GROUP BY ALL""",
}
