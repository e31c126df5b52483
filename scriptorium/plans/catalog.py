"""Registered queries of the engine, each over whole tables, and the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import analysis, vectors
from ..functions import text as T
from ..operators import chunking, crawl, export, search, stats, store, symbols
from ..runtime import ensure_checkpoint_dir, table
from ..sources import files, markup
from ..streaming import incremental
from . import pipeline

QUERIES: dict = {}
ORACLES: dict = {}

#: Parameters of the registered searches.
SEARCH_TEXT = 'shared buffer or "lazy worker" -camera'
RERANK_TEXT = "queue worker buffer cache"
CUTOFF = "2024-09-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_W = r"[^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_STRIP = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_STRIP}', ''), '{_STRIP}$', '')"


_LATEST_CHUNKS = "(SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)"


def latest_chunks(spark, d):
    """For few columns: a window over them."""
    return store.dedupe_ids(table(spark, d, "chunks"))


def latest_whole(spark, d):
    """For wide columns: only rows of repeated ids are shuffled."""
    return store.latest_of_repeated(table(spark, d, "chunks").where(F.col("id").isNotNull()), ["id"], ["created_at"])


@query("""
SELECT s.source, s.doc_type, count(*) AS n_documents, sum(s.n_tokens)::BIGINT AS n_tokens, sum(s.n_sections)::BIGINT AS n_sections FROM (
  SELECT d.source, d.doc_type, coalesce(len(regexp_extract_all(d.raw_content, '""" + _W + """')) * 4 // 3, 0) AS n_tokens,
    len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(d.raw_content, ''), '^\\x{feff}', ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: regexp_matches(l, '^#{1,3}[ \\t]+[^ \\t\\n\\x0b\\f\\r]'))) AS n_sections
  FROM documents d) s GROUP BY ALL""")
def ingest_summary(spark, d):
    lines = F.split(T.uniform_lines(F.coalesce("raw_content", F.lit(""))), "\n")
    headings = F.size(F.filter(lines, lambda line: line.rlike(r"^#{1,3}[ \t]+\S")))
    rows = table(spark, d, "documents").select("source", "doc_type", F.coalesce(T.token_estimate(F.col("raw_content")), F.lit(0)).alias("n_tokens"), headings.alias("n_sections"))
    return rows.groupBy("source", "doc_type").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_sections").cast("long").alias("n_sections"))


@query("""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(raw_content, '^\\x{feff}', ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE raw_content IS NOT NULL)),
marked AS (SELECT *, regexp_matches(line, '^#{1,3}[ \\t]+[^ \\t\\n\\x0b\\f\\r]') AS h FROM lines),
numbered AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) - CASE WHEN first_value(h) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS section_no FROM marked),
built AS (
  SELECT doc_id, section_no::INT AS section_no, """ + _strip("coalesce(regexp_extract(max(line) FILTER (WHERE h), '^#{1,3}[ \\t]+([^\\n]*)', 1), '')") + """ AS heading,
    """ + _strip("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT h), '')") + """ AS body
  FROM numbered GROUP BY doc_id, section_no)
SELECT doc_id, section_no, heading, md5(body) AS body_hash FROM built WHERE body <> ''""")
def section_bodies(spark, d):
    return chunking.sections(table(spark, d, "documents")).select("doc_id", "section_no", "heading", F.md5("body").alias("body_hash"))


@query()
def chunk_documents(spark, d):
    chunks = pipeline.route_chunks(table(spark, d, "documents"))
    return chunks.select("doc_id", "chunk_index", "chunk_type", "qualified_name", "summary", "token_count", F.md5("content").alias("content_hash"))


@query("""
SELECT doc_id, (len(regexp_extract_all(text, '""" + _W + """')) * 4 // 3)::INT AS n_tokens,
  CASE WHEN strpos(text, '. ') > 1 THEN substr(text, 1, strpos(text, '. ')) WHEN strpos(text, '.' || chr(10)) > 1 THEN substr(text, 1, strpos(text, '.' || chr(10))) ELSE substr(text, 1, 200) END AS summary,
  substr(""" + _strip("split_part(text, chr(10), 1)") + """, 1, 200) AS first_line
FROM documents WHERE text IS NOT NULL""")
def text_summaries(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where(text.isNotNull()).select("doc_id", T.token_estimate(text).alias("n_tokens"), T.first_sentence(text).alias("summary"), T.first_line(text).alias("first_line"))


@query("""
SELECT source, count(*) AS n_documents, count(*) FILTER (WHERE md5(raw_content) IS DISTINCT FROM content_hash) AS n_wrong_hash, count(DISTINCT md5(raw_content)) AS n_contents
FROM documents GROUP BY source""")
def content_audit(spark, d):
    return stats.content_audit(table(spark, d, "documents"))


@query("SELECT md5(raw_content) AS hash, count(*) AS n_rows, count(DISTINCT path) AS n_paths FROM documents WHERE raw_content IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_contents(spark, d):
    return stats.repeated_contents(table(spark, d, "documents"))


_OLD = f"(SELECT * FROM documents WHERE created_at < TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY source_id, path ORDER BY updated_at DESC NULLS LAST, doc_id DESC) = 1)"
_NEW = f"(SELECT * FROM documents WHERE created_at >= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY source_id, path ORDER BY updated_at DESC NULLS LAST, doc_id DESC) = 1)"
KEY = ("source_id", "path")


def _old_and_new(spark, d):
    documents = table(spark, d, "documents").drop("raw_content", "text")
    cut = F.lit(CUTOFF).cast("timestamp")
    stored = store.latest_by(documents.where(F.col("created_at") < cut), KEY, ["updated_at", "doc_id"])
    incoming = store.latest_by(documents.where(F.col("created_at") >= cut), KEY, ["updated_at", "doc_id"])
    return stored, incoming


@query(f"""
SELECT n.doc_id, n.id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.content_hash = n.content_hash THEN 'same' ELSE 'changed' END AS change
FROM {_NEW} n LEFT JOIN {_OLD} o ON o.source_id IS NOT DISTINCT FROM n.source_id AND o.path IS NOT DISTINCT FROM n.path""")
def document_changes(spark, d):
    return store.detect_changes(*_old_and_new(spark, d)).select("doc_id", "id", "change")


@query(f"""
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.doc_id IS NULL THEN n.doc_id ELSE o.doc_id END AS doc_id, CASE WHEN o.doc_id IS NULL THEN n.created_at ELSE o.created_at END AS created_at,
  CASE WHEN n.doc_id IS NULL THEN o.content_hash ELSE n.content_hash END AS content_hash, CASE WHEN n.doc_id IS NULL THEN o.updated_at ELSE n.updated_at END AS updated_at
FROM {_OLD} o FULL JOIN {_NEW} n ON o.source_id IS NOT DISTINCT FROM n.source_id AND o.path IS NOT DISTINCT FROM n.path""")
def document_upsert(spark, d):
    stored, incoming = _old_and_new(spark, d)
    return store.upsert(stored, incoming, KEY, ["title", "doc_type", "content_hash", "updated_at"]).select("id", "doc_id", "created_at", "content_hash", "updated_at")


@query(f"""
SELECT c.source_name, c.chunk_type, count(*) AS n_chunks FROM {_LATEST_CHUNKS} c
WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n JOIN {_OLD} o ON o.source_id IS NOT DISTINCT FROM n.source_id AND o.path IS NOT DISTINCT FROM n.path WHERE n.id = c.document_id)
GROUP BY ALL""")
def chunks_kept(spark, d):
    stored, incoming = _old_and_new(spark, d)
    again = store.detect_changes(stored, incoming).where("change <> 'new'").select(F.col("id").alias("document_id"))
    kept = store.replace_chunks(latest_chunks(spark, d), again, latest_chunks(spark, d).limit(0))
    return kept.groupBy("source_name", "chunk_type").agg(F.count("*").alias("n_chunks"))


@query("""
WITH incoming AS (SELECT source AS name, '1.0' AS version, 'docs' AS source_type, min(path) AS origin FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT coalesce(s.name, i.name) AS name, coalesce(s.version, i.version) AS version, CASE WHEN i.name IS NULL THEN s.source_type ELSE i.source_type END AS source_type,
  CASE WHEN i.name IS NULL THEN s.origin ELSE i.origin END AS origin, s.dimensions
FROM sources s FULL JOIN incoming i ON s.name = i.name AND s.version = i.version""")
def source_upsert(spark, d):
    incoming = table(spark, d, "documents").where(F.col("source").isNotNull()).groupBy(F.col("source").alias("name")).agg(F.lit("1.0").alias("version"), F.lit("docs").alias("source_type"), F.min("path").alias("origin"))
    merged = store.upsert(table(spark, d, "sources"), incoming.select("name", "version", "source_type", "origin"), ["name", "version"], ["source_type", "origin"])
    return merged.select("name", "version", "source_type", "origin", "dimensions")


@query("SELECT 'sources' AS table_name, count(*) AS n_rows FROM sources UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks")
def table_counts(spark, d):
    return stats.table_counts(**{name: table(spark, d, name) for name in ("sources", "documents", "chunks")})


@query("SELECT chunk_type, count(*) AS n_chunks FROM chunks GROUP BY 1")
def chunk_type_counts(spark, d):
    return stats.type_counts(table(spark, d, "chunks"))


@query("""
SELECT s.name, s.version, s.source_type, s.origin, count(DISTINCT d.id) AS n_documents, count(DISTINCT c.id) AS n_chunks
FROM sources s LEFT JOIN documents d ON d.source_id = s.id LEFT JOIN chunks c ON c.source_name = s.name AND c.source_version = s.version
GROUP BY s.id, s.name, s.version, s.source_type, s.origin""")
def source_counts(spark, d):
    return stats.source_counts(*(table(spark, d, name) for name in ("sources", "documents", "chunks")))


@query(f"SELECT id, created_at FROM {_LATEST_CHUNKS}")
def chunks_latest(spark, d):
    return latest_chunks(spark, d).select("id", "created_at")


@query(f"""
SELECT qualified_name, id, source_name, source_version, chunk_type, chunk_index FROM {_LATEST_CHUNKS} WHERE qualified_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY coalesce(source_name, ''), coalesce(source_version, ''), coalesce(chunk_index, -1), id) = 1""")
def chunk_lookup(spark, d):
    return search.lookup(latest_chunks(spark, d))


@query(f"""
SELECT source_name, source_version, parent_name, row_number() OVER (PARTITION BY source_name, source_version, parent_name ORDER BY chunk_type NULLS FIRST, chunk_index NULLS FIRST, id)::INT AS place, chunk_type, qualified_name, id
FROM {_LATEST_CHUNKS}""")
def chunk_context(spark, d):
    return search.context(latest_chunks(spark, d))


@query(f"SELECT id, qualified_name, chunk_index FROM {_LATEST_CHUNKS} WHERE source_name = 'lumora-engine' AND chunk_type IN ('method', 'constant')")
def chunk_filter(spark, d):
    return search.matching(latest_chunks(spark, d), source_name="lumora-engine", chunk_types=["method", "constant"]).select("id", "qualified_name", "chunk_index")


def _query_vector(spark, d):
    """The vector of the smallest id: one row, read to the driver as a user's query vector would be."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


_NEAR = """
SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


@query(f"SELECT * FROM ({_NEAR}) ORDER BY similarity DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    near = search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, key="vec_id")
    return near.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT * FROM ({_NEAR}) WHERE label IN (1, 3) ORDER BY similarity DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    near = search.nearest(table(spark, d, "embeddings").where(F.col("label").isin(1, 3)), _query_vector(spark, d), 10, key="vec_id")
    return near.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)).round(5) AS cut_sum, len(list_resize(embedding, 80, 0))::INT AS padded_size
FROM embeddings""")
def vector_fit(spark, d):
    e = F.col("embedding")
    total = F.aggregate(vectors.fit(e, 32), F.lit(0.0), lambda t, x: t + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 5).alias("cut_sum"), F.size(vectors.fit(e, 80)).alias("padded_size"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS mean_norm FROM embeddings GROUP BY label")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.norm(F.col("embedding"))), 5).alias("mean_norm"))


_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)
_STEM = "CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[^aeo]es$') THEN regexp_replace(w, 'es$', 'e') WHEN regexp_matches(w, '[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"


def _terms(field: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower(coalesce({field}, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: {_STEM})"


@query(f"SELECT w2 AS term, count(*) AS n_chunks, sum(tf)::BIGINT AS n_occurrences FROM (SELECT id, w2, count(*) AS tf FROM (SELECT id, unnest({_terms('content')}) AS w2 FROM {_LATEST_CHUNKS}) GROUP BY ALL) GROUP BY 1")
def term_statistics(spark, d):
    return search.postings(latest_whole(spark, d)).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_occurrences"))


_FIELDS = tuple(search.FIELD_WEIGHTS)
_HAS = lambda t: "(" + " OR ".join(f"list_contains({f}_t, '{t}')" for f in _FIELDS) + ")"
_PAIR = lambda a, b: "(" + " OR ".join(f"len(list_filter(list_zip({f}_t[:-2], {f}_t[2:]), lambda p: p[1] = '{a}' AND p[2] = '{b}')) > 0" for f in _FIELDS) + ")"
_TF = " + ".join(f"{weight} * len(list_filter({f}_t, lambda w: w = '{t}')) / (len(list_filter({f}_t, lambda w: w = '{t}')) + 1.0)" for f, weight in search.FIELD_WEIGHTS.items() for t in ("buffer", "lazy", "shared", "worker"))
_FTS = f"""
WITH analysed AS (SELECT id, {", ".join(f"{_terms(f)} AS {f}_t" for f in _FIELDS)} FROM {_LATEST_CHUNKS}),
matched AS (SELECT id, round({_TF}, 6) AS rank FROM analysed WHERE ({_HAS("shared")} AND {_HAS("buffer")}) OR ({_PAIR("lazy", "worker")} AND NOT {_HAS("camera")}))"""


@query(_FTS + " SELECT id, rank FROM matched ORDER BY rank DESC, id LIMIT 10")
def text_search(spark, d):
    return search.text_search(latest_whole(spark, d), SEARCH_TEXT).select("id", F.round("rank", 6).alias("rank"))


def _chunk_vector(chunks):
    usable = chunks.where(vectors.usable(F.col("embedding"), 64))
    return usable.select("id", "embedding").orderBy("id").limit(1).first()["embedding"]


_USABLE = f"(SELECT * FROM {_LATEST_CHUNKS} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_SEMANTIC = f"SELECT u.id, u.content, round(list_cosine_similarity(u.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity FROM {_USABLE} u, (SELECT embedding FROM {_USABLE} ORDER BY id LIMIT 1) q"


@query(_FTS + f""",
k AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS keyword_place FROM matched ORDER BY rank DESC, id LIMIT 30),
s AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS semantic_place FROM ({_SEMANTIC}) ORDER BY similarity DESC, id LIMIT 30)
SELECT coalesce(k.id, s.id) AS id, round(coalesce(1.0 / (60 + keyword_place), 0) + coalesce(1.0 / (60 + semantic_place), 0), 6) AS score,
  CASE WHEN semantic_place IS NULL THEN 'keyword' WHEN keyword_place IS NULL THEN 'semantic' ELSE 'hybrid' END AS retrieval
FROM k FULL JOIN s ON k.id = s.id ORDER BY coalesce(1.0 / (60 + keyword_place), 0) + coalesce(1.0 / (60 + semantic_place), 0) DESC, keyword_place NULLS LAST, semantic_place NULLS LAST LIMIT 10""")
def hybrid_search(spark, d):
    chunks = latest_whole(spark, d)
    found = search.hybrid(chunks, SEARCH_TEXT, _chunk_vector(chunks))
    return found.select("id", F.round("score", 6).alias("score"), "retrieval")


_WANTED = ("buffer", "cache", "queue", "worker")


@query(f"""
SELECT id, round(({" + ".join(f"list_contains({_terms('content')}, '{t}')::INT" for t in _WANTED)}) / 4.0, 6) AS rerank_score, round(similarity, 6) AS similarity
FROM (SELECT * FROM ({_SEMANTIC}) ORDER BY similarity DESC, id LIMIT 50) ORDER BY rerank_score DESC, similarity DESC, id LIMIT 10""")
def rerank_two_stage(spark, d):
    chunks = latest_whole(spark, d)
    found = search.two_stage(chunks, RERANK_TEXT, _chunk_vector(chunks))
    return found.select("id", F.round("rerank_score", 6).alias("rerank_score"), F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT document_id, batch_no, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens FROM (
  SELECT document_id, token_count, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, id) - 1) // 5 AS batch_no FROM {_LATEST_CHUNKS}) GROUP BY ALL""")
def embedding_batches(spark, d):
    return search.batches(latest_chunks(spark, d)).groupBy("document_id", "batch_no").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


_HOST = r"nullif(lower(regexp_extract(path, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_BELOW = r"lower(regexp_extract(path, '(?i)^https?://[^/?#]+([^?#]*)', 1))"


@query(f"""
SELECT {_HOST} AS host, CASE WHEN contains({_BELOW}, '/classes/') OR contains({_BELOW}, '/class_') THEN 'class_ref' WHEN contains({_BELOW}, '/tutorial') OR contains({_BELOW}, '/getting_started') THEN 'tutorial' ELSE 'guide' END AS kind, count(*) AS n_pages
FROM documents WHERE regexp_matches(path, '(?i)^https?://') GROUP BY ALL""")
def url_kinds(spark, d):
    pages = table(spark, d, "documents").where(T.is_url(F.col("path")))
    return pages.groupBy(T.url_host(F.col("path")).alias("host"), T.url_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n_pages"))


@query("SELECT doc_id, path FROM documents WHERE (regexp_matches(path, '/(classes|manual)/') OR regexp_matches(path, '\\.md$')) AND NOT regexp_matches(path, '[?#]') AND NOT regexp_matches(path, 'worker')")
def path_filter(spark, d):
    keep = T.included(F.col("path"), ["/(classes|manual)/", r"\.md$"], ["[?#]", "worker"])
    return table(spark, d, "documents").where(keep).select("doc_id", "path")


@query("""
SELECT CASE WHEN suffix IN ('md', 'rst', 'txt') THEN 'prose' ELSE 'code' END AS kind, suffix, count(*) AS n_files, count(*) FILTER (WHERE outside) AS n_outside FROM (
  SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS suffix,
    NOT list_has_any(string_split(path, '/')[:-2], ['.git', '.svn', '.hg', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', 'target', '.idea', '.vscode']) AS outside
  FROM documents WHERE NOT regexp_matches(path, '(?i)^https?://')) WHERE suffix <> '' GROUP BY ALL""")
def file_kinds(spark, d):
    suffix = T.path_suffix(F.col("path"))
    rows = table(spark, d, "documents").where(~T.is_url(F.col("path"))).select(suffix.alias("suffix"), T.outside_directories(F.col("path"), files.SKIPPED_FOLDERS).alias("outside"))
    kind = F.when(F.col("suffix").isin(*files.PROSE_SUFFIXES), "prose").otherwise("code")
    return rows.where("suffix <> ''").groupBy(kind.alias("kind"), "suffix").agg(F.count("*").alias("n_files"), F.sum(F.col("outside").cast("long")).alias("n_outside"))


@query()
def prose_scan(spark, d):
    return files.prose_documents(table(spark, d, "documents").where(~T.is_url(F.col("path")))).select("path", "title", "doc_type", "content_hash")


@query("""
SELECT path, 'class_ref' AS doc_type, md5(raw_content) AS content_hash FROM documents
WHERE NOT regexp_matches(path, '(?i)^https?://') AND lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN (""" + ", ".join(f"'{s}'" for s in files.CODE_SUFFIXES) + """)
  AND NOT list_has_any(string_split(path, '/')[:-2], [""" + ", ".join(f"'{s}'" for s in files.SKIPPED_FOLDERS) + """]) AND NOT regexp_matches(path, '(^|/)__init__\\.py$') AND """ + _strip("coalesce(raw_content, '')") + """ <> ''""")
def code_scan(spark, d):
    return files.code_documents(table(spark, d, "documents").where(~T.is_url(F.col("path")))).select("path", "doc_type", "content_hash")


@query("""
SELECT doc_id, len(links)::INT AS n_links, links[1] AS first_link FROM (SELECT doc_id, regexp_extract_all(raw_content, '\\[[^\\]\\n]*\\]\\(([^)\\s]+)\\)', 1) AS links FROM documents) WHERE len(links) > 0""")
def page_links(spark, d):
    links = table(spark, d, "documents").select("doc_id", markup.markdown_links(F.col("raw_content")).alias("links"))
    return links.where(F.size("links") > 0).select("doc_id", F.size("links").alias("n_links"), F.element_at("links", 1).alias("first_link"))


_PARTS = r"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '\?.*$', ''), '#.*$', ''), '/+$', ''), '(?i)^https?://', ''), '/')"


@query(f"""
WITH RECURSIVE pages AS (SELECT DISTINCT {_PARTS} AS parts FROM documents WHERE regexp_matches(path, '(?i)^https?://')),
edges AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS s, array_to_string(parts[1:n + 1], '/') AS t FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM pages)),
walk(url, level) AS (SELECT DISTINCT parts[1], 0 FROM pages UNION SELECT e.t, w.level + 1 FROM walk w JOIN edges e ON e.s = w.url )
SELECT url, min(level)::INT AS level FROM walk GROUP BY url""")
def crawl_levels(spark, d):
    documents = table(spark, d, "documents")
    edges = crawl.site_edges(documents)
    seeds = documents.where(T.is_url(F.col("path"))).select(F.substring_index(F.regexp_replace(T.normal_url(F.regexp_replace("path", r"\?.*$", "")), "(?i)^https?://", ""), "/", 1).alias("url"))
    return crawl.levels(edges, seeds)


_IS_CLASS = "bool_or(chunk_type IN ('class_overview', 'method', 'property'))"


@query(f"""
SELECT source_name, source_version, parent_name, CASE WHEN {_IS_CLASS} THEN 'class' ELSE 'tutorial' END AS kind, count(*) AS n_chunks FROM {_LATEST_CHUNKS} WHERE parent_name IS NOT NULL GROUP BY ALL""")
def export_parents(spark, d):
    return export.parents(latest_chunks(spark, d)).drop("summary")


@query(f"""
WITH p AS (SELECT source_name, source_version, parent_name, {_IS_CLASS} AS is_class,
    coalesce(CASE WHEN {_IS_CLASS} THEN (arg_min(struct_pack(s := summary), (coalesce(chunk_index, -1), id)) FILTER (WHERE chunk_type = 'class_overview')).s ELSE (arg_min(struct_pack(s := summary), (coalesce(chunk_index, -1), id))).s END, '') AS summary
  FROM {_LATEST_CHUNKS} WHERE parent_name IS NOT NULL GROUP BY ALL),
l AS (SELECT *, substr({_strip("split_part(summary, chr(10), 1)")}, 1, 200) AS line_summary FROM p)
SELECT source_name, source_version, row_number() OVER (PARTITION BY source_name, source_version ORDER BY is_class DESC, parent_name)::INT AS line_no, CASE WHEN is_class THEN 'class' ELSE 'tutorial' END AS kind,
  '- **' || parent_name || '**' || CASE WHEN line_summary <> '' THEN ' — ' || line_summary ELSE '' END AS line FROM l""")
def export_index(spark, d):
    return export.index_lines(latest_chunks(spark, d))


@query(f"""
SELECT source_name, source_version, parent_name, substr(regexp_replace(parent_name, '[^\\p{{L}}\\p{{Nd}}._-]', '_', 'g'), 1, 100) AS file,
  row_number() OVER (PARTITION BY source_name, source_version, parent_name ORDER BY list_position(['class_overview', 'property', 'method', 'signal', 'constant', 'enum', 'shader_entry_point', 'tutorial_section'], chunk_type) NULLS LAST, chunk_index NULLS FIRST, id)::INT AS place,
  md5(CASE WHEN coalesce(heading, '') <> '' THEN '### ' || heading || chr(10) || chr(10) ELSE '' END || coalesce(content, '')) AS text_hash
FROM {_LATEST_CHUNKS} WHERE parent_name IS NOT NULL""")
def export_pages(spark, d):
    return export.page_lines(latest_whole(spark, d)).select("source_name", "source_version", "parent_name", "file", "place", F.md5("text").alias("text_hash"))


@query(f"""
WITH p AS (SELECT source_name, source_version, parent_name FROM {_LATEST_CHUNKS} WHERE parent_name IS NOT NULL GROUP BY ALL HAVING {_IS_CLASS}),
m AS (SELECT c.*, substr({_strip("split_part(coalesce(c.summary, ''), chr(10), 1)")}, 1, 200) AS line_summary FROM {_LATEST_CHUNKS} c
  JOIN p ON c.source_name IS NOT DISTINCT FROM p.source_name AND c.source_version IS NOT DISTINCT FROM p.source_version AND c.parent_name = p.parent_name WHERE c.chunk_type <> 'class_overview')
SELECT source_name, source_version, parent_name, row_number() OVER (PARTITION BY source_name, source_version, parent_name ORDER BY list_position(['class_overview', 'property', 'method', 'signal', 'constant', 'enum', 'shader_entry_point', 'tutorial_section'], chunk_type) NULLS LAST, chunk_index NULLS FIRST, id)::INT AS place,
  '- **' || coalesce(list_extract(string_split(qualified_name, '.'), -1), heading, '') || '**' || CASE WHEN line_summary <> '' THEN ' — ' || line_summary ELSE '' END AS text FROM m""")
def export_classes(spark, d):
    return export.class_lines(latest_whole(spark, d)).select("source_name", "source_version", "parent_name", "place", "text")


@query(f"SELECT chunk_type, key, count(*) AS n_rows FROM (SELECT chunk_type, unnest(json_keys(metadata)) AS key FROM {_LATEST_CHUNKS} WHERE json_valid(metadata)) GROUP BY ALL")
def metadata_keys(spark, d):
    return stats.metadata_keys(latest_chunks(spark, d))


@query(f"SELECT json_extract_string(metadata, '$.return_type') AS return_type, count(*) AS n_chunks FROM {_LATEST_CHUNKS} WHERE json_valid(metadata) AND json_extract_string(metadata, '$.return_type') IS NOT NULL GROUP BY 1")
def return_types(spark, d):
    rows = latest_chunks(spark, d).select(F.get_json_object("metadata", "$.return_type").alias("return_type"))
    return rows.where("return_type IS NOT NULL").groupBy("return_type").agg(F.count("*").alias("n_chunks"))


def _declaration_sql() -> str:
    parts = []
    for language, patterns in symbols.PATTERNS.items():
        for i, (kind, pattern) in enumerate(patterns):
            earlier = "".join(f" AND NOT regexp_matches(line, '{p}')" for _, p in patterns[:i])
            parts.append(f"SELECT doc_id, line_no, language, '{kind}' AS kind, regexp_extract(line, '{pattern}', 1) AS name, line FROM lines WHERE language = '{language}' AND regexp_matches(line, '{pattern}'){earlier}")
    cases = " ".join(f"WHEN '{suffix}' THEN '{language}'" for suffix, language in symbols.LANGUAGES.items())
    return f"""
WITH files AS (SELECT doc_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {cases} END AS language, regexp_replace(regexp_replace(raw_content, '^\\x{{feff}}', ''), '\\r\\n?', chr(10), 'g') AS code
  FROM documents WHERE NOT regexp_matches(path, '(?i)^https?://') AND raw_content IS NOT NULL),
split AS (SELECT doc_id, language, string_split(code, chr(10)) AS ls FROM files WHERE language IS NOT NULL),
lines AS (SELECT doc_id, language, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM split),
declared AS ({" UNION ALL ".join(parts)})
"""


@query(_declaration_sql() + "SELECT doc_id, line_no, language, kind, name FROM declared")
def code_declarations(spark, d):
    return symbols.declarations(table(spark, d, "documents")).select("doc_id", "line_no", "language", "kind", "name")


@query(_declaration_sql() + "SELECT doc_id, line_no, language, kind, name, " + _strip("regexp_replace(line, '[ \\t\\n\\x0b\\f\\r{:]+$', '')") + """ AS signature,
  CASE WHEN kind = 'method' THEN last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM declared""")
def code_symbols(spark, d):
    return symbols.with_parents(symbols.declarations(table(spark, d, "documents")))


@query(_declaration_sql() + """
SELECT s.chunk_type, count(*) AS n_symbols, count(d.name) AS n_declared
FROM (SELECT DISTINCT doc_id, name, chunk_type FROM symbols WHERE name IS NOT NULL) s LEFT JOIN (SELECT DISTINCT doc_id, name FROM declared) d ON d.doc_id = s.doc_id AND d.name = s.name GROUP BY 1""")
def symbol_agreement(spark, d):
    return symbols.symbol_agreement(table(spark, d, "documents"), table(spark, d, "symbols"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM events GROUP BY ALL")
def event_windows(spark, d):
    return incremental.event_windows(table(spark, d, "events")).withColumn("total_value", F.round("total_value", 4))


@query("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def stream_event_types(spark, d):
    """The events read as a file stream to its end; the stateful counts land in the shared folder and are read back.

    The stream counts per day, type and user, and lets a day go once the watermark has passed it, so its state holds the open days only.
    """
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 day").alias("day"), "event_type", "user_id").agg(F.count("*").alias("n"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    final = spark.read.parquet(f"{root}/out")
    last = final.groupBy("day", "event_type", "user_id").agg(F.max("n").alias("n"))
    return last.groupBy("event_type").agg(F.sum("n").alias("n_events"), F.count_distinct("user_id").alias("n_users"))
