"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from . import p1_pages, p2_budget, p3_neighbours, p4_sources, p5_functions, p6_encoding, p7_leaks, p8_abuse


def p1_found(spark, d):
    return p1_pages.found(table(spark, d, "documents"))


def p1_articles(spark, d):
    return p1_pages.articles(table(spark, d, "documents"))


def p1_lines(spark, d):
    lines = p1_pages.classified_lines(table(spark, d, "documents"))
    return lines.groupBy("furniture").agg(F.count("*").alias("n_lines"))


def p2_found(spark, d):
    return p2_budget.falsifying_fields(table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "sources"))


def p2_budget_totals(spark, d):
    return p2_budget.token_budget(table(spark, d, "documents"), table(spark, d, "sources"))


def p2_document_tokens(spark, d):
    return p2_budget.document_tokens(table(spark, d, "documents"))


def p2_chunk_estimates(spark, d):
    audit = p2_budget.audit_chunks(table(spark, d, "chunks"), table(spark, d, "documents"), table(spark, d, "sources"))
    return audit.groupBy("true_name", "true_version").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").cast("long").alias("n_tokens"))


def p6_ids(spark, d):
    return p6_encoding.encode_corpus(table(spark, d, "documents"))


def p6_roundtrip(spark, d):
    return p6_encoding.roundtrip(table(spark, d, "documents"))


def p3_found(spark, d):
    return p3_neighbours.mutual_pairs(table(spark, d, "chunks"))


def p3_topk(spark, d):
    return p3_neighbours.search(table(spark, d, "chunks"))


def p3_recall(spark, d):
    return p3_neighbours.recall(table(spark, d, "chunks"))


def p4_found(spark, d):
    return p4_sources.found(table(spark, d, "documents"), table(spark, d, "upstream_files"))


def p4_reasons(spark, d):
    return p4_sources.foreign_files(table(spark, d, "documents"), table(spark, d, "upstream_files"))


def p4_copies(spark, d):
    return p4_sources.upstream_copies(table(spark, d, "documents"), table(spark, d, "upstream_files"))


def p4_repository_copies(spark, d):
    documents = table(spark, d, "documents")
    return p4_sources.repository_copies(documents, p4_sources.judged_files(documents))


def p4_handwritten(spark, d):
    return p4_sources.handwritten_report(table(spark, d, "documents"), table(spark, d, "upstream_files"))


def p5_found(spark, d):
    return p5_functions.found(table(spark, d, "chunks"), table(spark, d, "symbols"), table(spark, d, "documents"))


def p5_pairs(spark, d):
    return p5_functions.function_pairs(table(spark, d, "chunks"), table(spark, d, "symbols"), table(spark, d, "documents"))


def p7_found(spark, d):
    return p7_leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_suites(spark, d):
    return p7_leaks.suite_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return p8_abuse.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_scores(spark, d):
    documents = table(spark, d, "documents")
    return p8_abuse.score_documents(documents, p8_abuse.train(documents, table(spark, d, "review_labels"))).select("doc_id", "source", "score")


def p8_rates(spark, d):
    return p8_abuse.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_sentences(spark, d):
    documents = table(spark, d, "documents")
    return p8_abuse.offending_sentences(documents, p8_abuse.train(documents, table(spark, d, "review_labels")))


def p8_heldout(spark, d):
    return p8_abuse.heldout_report(table(spark, d, "documents"), table(spark, d, "review_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_articles, p1_lines, p3_found, p3_topk, p3_recall, p4_found, p4_reasons, p4_copies, p4_repository_copies, p4_handwritten, p5_found, p5_pairs, p7_found, p7_suites, p8_found, p8_scores, p8_rates, p8_sentences, p8_heldout, p2_found, p2_budget_totals, p2_document_tokens, p2_chunk_estimates, p6_ids, p6_roundtrip)}

_WORDS = "len(regexp_extract_all(content, '[^\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'))"
_AUDIT = f"""
WITH measured AS (
  SELECT id, document_id, source_name, source_version, token_count, created_at, coalesce({_WORDS} * 4 // 3, 0)::INT AS n_tokens
  FROM chunks WHERE id IS NOT NULL),
latest AS (
  SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, document_id DESC NULLS LAST,
    source_name DESC NULLS LAST, source_version DESC NULLS LAST, token_count DESC NULLS LAST, n_tokens DESC) = 1),
owned AS (
  SELECT o.id AS document_id, s.name AS true_name, s.version AS true_version
  FROM (SELECT id, min(source_id) AS source_id FROM documents WHERE id IS NOT NULL GROUP BY id) o LEFT JOIN sources s ON s.id = o.source_id),
audit AS (
  SELECT l.*, o.true_name, o.true_version, o.document_id IS NOT NULL AS known FROM latest l LEFT JOIN owned o ON o.document_id = l.document_id)
"""
_LINES = "list_distinct(list_filter(list_transform(string_split({}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')), lambda l: regexp_matches(l, '[\\p{{L}}\\p{{N}}]')))"
ORACLES = {
    "p4_copies": f"""
WITH d AS (SELECT doc_id, {_LINES.format("raw_content")} AS lines FROM documents WHERE regexp_matches(path, '(?i)\\.(py|gd|ts|tsx|js|jsx|rs|go|cpp|h|frag|vert|glsl)$') AND NOT regexp_matches(path, '(?i)^https?://')),
u AS (SELECT file_id, {_LINES.format("content")} AS lines FROM upstream_files),
pairs AS (SELECT doc_id, file_id, len(list_intersect(d.lines, u.lines)) / len(u.lines) AS containment FROM d, u WHERE len(u.lines) >= 5)
SELECT doc_id, file_id, containment FROM pairs WHERE containment >= 0.5""",
    "p2_found": _AUDIT
    + """
SELECT id, 'token_count' AS field_name FROM audit WHERE token_count IS DISTINCT FROM n_tokens
UNION ALL SELECT id, 'source_name' FROM audit WHERE known AND (source_name IS NULL OR source_name IS DISTINCT FROM true_name)
UNION ALL SELECT id, 'source_version' FROM audit WHERE known AND (source_version IS NULL OR source_version IS DISTINCT FROM true_version)""",
    "p2_chunk_estimates": _AUDIT + "SELECT true_name, true_version, count(*) AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens FROM audit GROUP BY ALL",
}
