"""Queries of the training-data operators, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, consensus, distinctive, leaks, lookalikes, mojibake, packing, pieces, repetition, scans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": consensus.consensus_grades,
        "p1_reliability": consensus.annotator_reliability,
        "p5_found": scans.scan_lines,
        "p5_texts": scans.scan_paragraphs,
        "p4_found": pieces.oversized_chunks,
        "p4_pieces": pieces.chunk_pieces,
        "p4_rebuilt": pieces.rebuilt_chunks,
        "p6_found": distinctive.topic_chunks,
        "p6_scores": distinctive.chunk_term_scores,
        "p6_term_weights": distinctive.chunk_term_weights,
        "p8_containers": packing.document_containers,
        "p8_whole": packing.packed_documents,
        "p8_report": packing.packing_totals,
        "p2_found": lookalikes.lookalike_values,
        "p2_canonical": lookalikes.canonical_values,
        "p2_title_groups": lookalikes.title_groups,
        "p7_found": mojibake.garbled_values,
        "p7_restored": mojibake.restored_values,
        "p3_found": boilerplate.lines_found,
        "p3_cleaned": boilerplate.cleaned_documents,
        "p9_found": lambda s, d: leaks.leaked_pairs(s, d).select("doc_id", "item_id").distinct(),
        "p9_cleaned": leaks.cleaned_documents,
        "p10_found": repetition.repetitive_documents,
        "p10_shares": repetition.repetition_shares,
        "p10_classifier": repetition.classifier_check,
    }


#: Lines of the documents with their keys, and the keys repeated in a source.
_LINES = r"""d AS (SELECT DISTINCT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
          l AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS line_no, regexp_replace(lower(nfc_normalize(unnest(lines))), '[^\p{L}\p{Nl}\p{No}]', '', 'g') AS k FROM d),
          n AS (SELECT source, count(*) AS docs FROM d GROUP BY source), c AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM l WHERE k <> '' GROUP BY source, k),
          bad AS (SELECT source, k FROM c JOIN n USING (source) WHERE c.n >= 3 AND c.n * 5 >= docs)"""
#: Words without case and digits, and of each whether an eight-word passage it lies in came before.
_REPEATS = r"""w AS (SELECT DISTINCT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda x: regexp_replace(x, '\p{Nd}+', '', 'g')), lambda x: x <> '') AS ws FROM documents),
          g AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END)) AS gram FROM w),
          f AS (SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 THEN i END AS again FROM g),
          v AS (SELECT doc_id, (max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) IS NOT NULL)::INT AS hit FROM f),
          share AS (SELECT w.doc_id, coalesce(s, 0) AS share FROM w LEFT JOIN (SELECT doc_id, avg(hit) AS s FROM v GROUP BY doc_id) USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_LINES} SELECT l.doc_id, l.line_no FROM l JOIN bad USING (source, k)",
        "p3_cleaned": rf"""WITH {_LINES}, s AS (SELECT source, list(k) AS ks FROM bad GROUP BY source)
          SELECT doc_id, documents.source, md5(CASE WHEN ks IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(ks, regexp_replace(lower(nfc_normalize(x)), '[^\p{{L}}\p{{Nl}}\p{{No}}]', '', 'g'))), chr(10)), '') END) AS digest FROM documents LEFT JOIN s ON s.source = documents.source""",
        "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 512",
        "p4_rebuilt": "SELECT DISTINCT chunk_id, md5(text) AS digest, true AS within FROM chunks WHERE length(text) > 512",
        "p8_whole": "SELECT DISTINCT doc_id, true AS whole FROM documents WHERE text <> ''",
        "p10_found": f"WITH {_REPEATS} SELECT DISTINCT doc_id FROM share WHERE share >= 0.4",
        "p10_shares": f"WITH {_REPEATS} SELECT DISTINCT doc_id, round(share, 6) AS share, share >= 0.4 AS repetitive FROM share",
    }
