"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import lookup, retrieval
from lexloom.plans import common
from lexloom.plans.common import SQL_C, SQL_E, SQL_P
from lexloom.session import written
from lexloom.sources.tables import once, table

SESSION = "ws-shared-review"


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test_item").select(F.col("item_id").cast("string").alias("query_id"), "query")


def _query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The stated queries of vector search: every vector whose id is divisible by 20."""
    return table(spark, folder, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return common.chunks(spark, folder, "doc_id", "chunk_index", "text", "embedding", "session_id")


def _tokenised(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return retrieval.tokenised(_chunks(spark, folder), *columns)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(_items(spark, folder), _chunks(spark, folder))


def bm25_scoped(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(_items(spark, folder), _chunks(spark, folder), scope=F.col("session_id") == SESSION)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vectors(_query_vectors(spark, folder), _chunks(spark, folder))


def vector_scoped(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.scoped(table(spark, folder, "chunks"), SESSION).select("id", "chunk_index", "embedding")
    return retrieval.vectors(_query_vectors(spark, folder), once(rows, "id"))


def _hybrid(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """Both rankings of each item, fused. No encoder is given, so the vector of an item is that of its best hit by words that has one."""
    chunks, items, n = _chunks(spark, folder), _items(spark, folder), retrieval.candidates()
    by_words = written(retrieval.bm25(items, retrieval.tokenised(chunks), k=n))
    stored = chunks.filter(F.size("embedding") == 64).filter(F.exists("embedding", lambda x: x != 0))
    best = by_words.join(stored.select("id", "embedding"), "id").groupBy("query_id").agg(F.min_by("embedding", "rank").alias("vector"))
    return retrieval.fused(retrieval.vectors(best, chunks, k=n), by_words, k)


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, retrieval.TOP_K)


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """What a search returns: fused hits with the facts of their chunk and the head of its text."""
    chunks = common.chunks(spark, folder, "doc_id", "doc_title", "session_id", "page_no", "section_path", "text")
    return retrieval.shown(_hybrid(spark, folder, retrieval.TOP_K), chunks).withColumn("section_path", F.array_join("section_path", " > "))


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks, items = _chunks(spark, folder), _items(spark, folder)
    indexed = retrieval.tokenised(chunks)
    return retrieval.reranked(retrieval.bm25(items, indexed, k=50), items, indexed)


def ranked_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each item's hits, by their best hit."""
    indexed = _tokenised(spark, folder, "doc_id")
    hits = retrieval.bm25(_items(spark, folder), indexed, k=retrieval.candidates()).join(indexed.select("id", "doc_id"), "id")
    return hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"))


def hits_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Files behind each item's ten best hits: how many hits, the best of them; hits whose document is not delivered fall out."""
    indexed = _tokenised(spark, folder, "doc_id")
    hits = retrieval.bm25(_items(spark, folder), indexed).join(indexed.select("id", "doc_id"), "id")
    files = common.documents(spark, folder, "file_path")
    return hits.join(files, "doc_id").groupBy("query_id", "file_path").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))


def _grep(spark: SparkSession, folder: str, pattern: str, **options) -> DataFrame:
    # Only hits are deduplicated, so that texts without one are never shuffled.
    rows = table(spark, folder, "chunks").select("id", "doc_id", "chunk_index", "text")
    return once(retrieval.grep(rows, pattern, **options), "id")


def grep_literal(spark: SparkSession, folder: str) -> DataFrame:
    return _grep(spark, folder, "Notwithstanding")


def grep_literal_cs(spark: SparkSession, folder: str) -> DataFrame:
    return _grep(spark, folder, "第1", case_sensitive=True)


def grep_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _grep(spark, folder, "(USD|EUR) [0-9]{1,3}(,[0-9]{3})+", mode="regex")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    # The filter comes before the deduplication, so that it reaches the scan.
    rows = table(spark, folder, "parsed_document").filter(F.col("session_id") == SESSION)
    return once(rows.select("doc_id", "title", "source_format"), "doc_id")


def list_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.documents(spark, folder, "session_id")
    return rows.groupBy(F.coalesce(F.nullif("session_id", F.lit("")), F.lit("(unassigned)")).alias("session")).agg(F.count("*").alias("documents"))


def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.outline(common.chunks(spark, folder, "doc_id", "section_path", "charspan"))
    return rows.withColumn("section_path", F.array_join("section_path", " > "))


def _asked_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every section path of every document and every path above it."""
    paths = common.chunks(spark, folder, "doc_id", "section_path").filter(F.size("section_path") > 0).select("doc_id", "section_path").distinct()
    return paths.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("section_path")), lambda n: F.slice("section_path", F.lit(1), n))).alias("path")).distinct()


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every section, or of what lies below it where it has none itself."""
    rows = lookup.sections(_asked_sections(spark, folder), common.chunks(spark, folder, "doc_id", "section_path"))
    return rows.select("id", "doc_id", F.array_join("path", " > ").alias("section"))


def section_text(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous text of every section."""
    chunks = common.chunks(spark, folder, "doc_id", "section_path", "charspan", "text")
    rows = lookup.section_texts(_asked_sections(spark, folder), chunks, common.documents(spark, folder, "full_text"))
    return rows.select("doc_id", F.array_join("path", " > ").alias("section"), "start_offset", "end_offset", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def chunk_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk that evidence names, asked for in the session of the evidence's document."""
    sessions = common.documents(spark, folder, "session_id").select(F.col("doc_id").alias("document_id"), F.col("session_id").alias("session"))
    named = common.evidence(spark, folder, "document_id", "source_chunk_ids").join(sessions, "document_id", "left").select("session", F.explode("source_chunk_ids").alias("id")).distinct()
    found = lookup.chunks_by_id(named, common.chunks(spark, folder, "doc_id", "text", "section_path", "page_no", "charspan"), common.documents(spark, folder, "title", "source_format", "session_id"))
    return found.select("session", "id", "outcome", "doc_id", "title", "source_format", F.array_join("section_path", " > ").alias("section"), "page_no", F.length("text").alias("size"))


def document_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that evidence names, asked for in the shared session."""
    named = common.evidence(spark, folder, "document_id").select(F.lit(SESSION).alias("session"), F.col("document_id").alias("doc_id")).distinct()
    return lookup.documents_by_id(named, common.documents(spark, folder, "title", "source_format", "session_id", "full_text")).withColumn("size", F.length("full_text")).drop("full_text")


def page_for_span(spark: SparkSession, folder: str) -> DataFrame:
    spans = common.evidence(spark, folder, "document_id", "start_offset", "end_offset").select(F.col("evidence_id").alias("key"), F.col("document_id").alias("doc_id"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"))
    found = retrieval.pages_for_spans(spans.filter("doc_id is not null and lo < hi"), common.chunks(spark, folder, "doc_id", "chunk_index", "page_no", "charspan"))
    return found.select(F.col("key").alias("evidence_id"), "page_no")


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_scoped, vector_topk, vector_scoped, hybrid_rrf, search_results, rerank_topk, ranked_files, hits_by_file, grep_literal, grep_literal_cs, grep_regex, list_documents, list_sessions, document_outline, section_chunks, section_text, chunk_by_id, document_meta, page_for_span)
}

TOKENS = common.sql_tokens("text")
BM25 = f"""{SQL_C}, toks AS (SELECT id, chunk_index, session_id, {TOKENS} AS ts FROM c), sized AS (SELECT id, chunk_index, session_id, len(ts) AS dl FROM toks), total AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
post AS (SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(ts) AS token FROM toks) GROUP BY token, id), freq AS (SELECT token, count(*) AS df FROM post GROUP BY token),
asked AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest({common.sql_tokens('query')}) AS token FROM test_item),
raw AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN post USING (token) JOIN freq USING (token) JOIN sized USING (id), total GROUP BY query_id, id)"""


def _bm25(k: int, where: str = "") -> str:
    return f"{BM25}, bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) AS rank FROM raw JOIN sized USING (id) {where} QUALIFY rank <= {k})"


def _vector(k: int, where: str = "") -> str:
    usable = "embedding IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0"
    return f"""qv AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0 AND {usable}), cv AS (SELECT id, chunk_index, embedding::DOUBLE[] AS w FROM c WHERE {usable} {where}),
vc AS (SELECT query_id, id, chunk_index, round(list_cosine_similarity(v, w), 6) AS score FROM qv, cv), vk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) AS rank FROM vc QUALIFY rank <= {k})"""


VECTOR = "embedding IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0"
HYBRID = f"""{_bm25(100)}, qv AS (SELECT query_id, arg_min(embedding, rank)::DOUBLE[] AS v FROM bm JOIN c USING (id) WHERE {VECTOR} GROUP BY query_id), cv AS (SELECT id, chunk_index, embedding::DOUBLE[] AS w FROM c WHERE {VECTOR}),
vc AS (SELECT query_id, id, chunk_index, round(list_cosine_similarity(v, w), 6) AS score FROM qv, cv), vk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) AS rank FROM vc QUALIFY rank <= 100),
both_ AS (SELECT query_id, id, vk.rank AS vector_rank, bm.rank AS bm25_rank FROM vk FULL OUTER JOIN bm USING (query_id, id)),
s AS (SELECT *, round(coalesce(0.5::DOUBLE / (60 + vector_rank), 0) + coalesce(0.5::DOUBLE / (60 + bm25_rank), 0), 9) AS score FROM both_),
fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST) AS rank, vector_rank, bm25_rank FROM s QUALIFY rank <= 10)"""


def _sql_grep(hit: str, count: str, start: str, size: str) -> str:
    return f"""WITH {SQL_C}, h AS (SELECT id, doc_id, chunk_index, text, {count} AS match_count, {start} AS s, {size} AS l FROM c WHERE {hit})
SELECT id, doc_id, chunk_index, match_count, CASE WHEN l >= 200 THEN substring(text, s + 1, 200) ELSE substring(text, CAST(greatest(0, s - (200 - l) // 2) AS BIGINT) + 1, 200) END AS snippet FROM h"""


#: Chunks of every asked section: of exactly its path, or of what is below it.
SECTIONS = """r AS (SELECT id, doc_id, section_path AS sp, text, CASE WHEN len(charspan) = 2 THEN charspan[1] END AS lo, CASE WHEN len(charspan) = 2 THEN charspan[2] END AS hi FROM c WHERE len(section_path) > 0),
q AS (SELECT DISTINCT doc_id, sp[1:n] AS path FROM (SELECT doc_id, sp, unnest(range(1, len(sp) + 1)) AS n FROM r)), exact AS (SELECT q.doc_id, path, id, text, lo, hi FROM q JOIN r ON r.doc_id = q.doc_id AND sp = path),
found AS (SELECT * FROM exact UNION ALL SELECT q.doc_id, q.path, id, text, lo, hi FROM (SELECT * FROM q ANTI JOIN exact USING (doc_id, path)) q JOIN r ON r.doc_id = q.doc_id AND sp[1:len(q.path)] = q.path)"""
MONEY = "(USD|EUR) [0-9]{1,3}(,[0-9]{3})+"
ORACLE = {
    "bm25_topk": f"WITH {_bm25(10)} SELECT * FROM bm",
    "bm25_scoped": f"WITH {_bm25(10, f'''WHERE session_id = '{SESSION}' ''')} SELECT * FROM bm",
    "vector_topk": f"WITH {SQL_C}, {_vector(10)} SELECT * FROM vk",
    "vector_scoped": f"WITH {SQL_C}, {_vector(10, f'''AND session_id = '{SESSION}' ''')} SELECT * FROM vk",
    "hybrid_rrf": f"WITH {HYBRID} SELECT * FROM fused",
    "search_results": f"""WITH {HYBRID} SELECT query_id, rank, id, doc_id, doc_title, session_id, page_no, array_to_string(section_path, ' > ') AS section_path, left(text, 200) AS snippet, score FROM fused JOIN c USING (id)""",
    "hits_by_file": f"WITH {_bm25(10)}, {SQL_P} SELECT query_id, file_path, count(*) AS hits, min(rank) AS best_rank FROM bm JOIN c USING (id) JOIN p ON p.doc_id = c.doc_id GROUP BY query_id, file_path",
    "rerank_topk": f"""WITH {_bm25(50)}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct({common.sql_tokens('query')}) AS qt FROM test_item), t AS (SELECT id, ts FROM toks),
s AS (SELECT query_id, id, rank AS before, round(len(list_intersect(qt, ts)) / greatest(len(qt), 1), 6) AS score FROM bm JOIN q USING (query_id) JOIN t USING (id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s QUALIFY rank <= 10""",
    "ranked_files": f"WITH {_bm25(100)} SELECT query_id, doc_id, min(rank) AS best_rank FROM bm JOIN c USING (id) GROUP BY query_id, doc_id",
    "grep_literal": _sql_grep("contains(lower(text), 'notwithstanding')", "CAST((length(text) - length(replace(lower(text), 'notwithstanding', ''))) // 15 AS INT)", "strpos(lower(text), 'notwithstanding') - 1", "15"),
    "grep_literal_cs": _sql_grep("contains(text, '第1')", "CAST((length(text) - length(replace(text, '第1', ''))) // 2 AS INT)", "strpos(text, '第1') - 1", "2"),
    "grep_regex": _sql_grep(f"regexp_matches(text, '(?i){MONEY}')", f"CAST(len(regexp_extract_all(text, '(?i){MONEY}')) AS INT)", f"length(regexp_extract(text, '(?is)^(.*?){MONEY}', 1))", f"length(regexp_extract(text, '(?i){MONEY}'))"),
    "list_documents": f"WITH {SQL_P} SELECT doc_id, title, source_format FROM p WHERE session_id = '{SESSION}'",
    "list_sessions": f"WITH {SQL_P} SELECT coalesce(nullif(session_id, ''), '(unassigned)') AS session, count(*) AS documents FROM p GROUP BY 1",
    "document_outline": f"WITH {SQL_C} SELECT doc_id, array_to_string(section_path, ' > ') AS section_path, min(charspan[1]) AS start_offset, max(charspan[2]) AS end_offset, count(*) AS chunks FROM c WHERE len(section_path) > 0 GROUP BY doc_id, c.section_path",
    "section_chunks": f"WITH {SQL_C}, {SECTIONS} SELECT id, doc_id, array_to_string(path, ' > ') AS section FROM found",
    "section_text": f"""WITH {SQL_C}, {SQL_P}, {SECTIONS}, g AS (SELECT doc_id, path, min(lo) AS s, max(hi) AS t, array_agg(id ORDER BY lo IS NULL, lo, id) AS ids, string_agg(text, chr(10) ORDER BY lo IS NULL, lo, id) AS joined FROM found GROUP BY doc_id, path),
h AS (SELECT g.*, full_text, coalesce(s >= 0 AND s <= t AND t <= length(full_text) AND full_text <> '', false) AS whole FROM g LEFT JOIN p USING (doc_id)), x AS (SELECT *, CASE WHEN whole THEN substring(full_text, s + 1, t - s) ELSE joined END AS body FROM h)
SELECT doc_id, array_to_string(path, ' > ') AS section, CASE WHEN whole THEN s ELSE 0 END AS start_offset, CASE WHEN whole THEN t ELSE 0 END AS end_offset, length(body) AS size, md5(body) AS digest, array_to_string(ids, ',') AS chunk_ids FROM x""",
    "chunk_by_id": f"""WITH {SQL_C}, {SQL_P}, {SQL_E}, q AS (SELECT DISTINCT session_id AS session, id FROM (SELECT document_id, unnest(source_chunk_ids) AS id FROM e) x LEFT JOIN p ON p.doc_id = document_id WHERE id IS NOT NULL),
d AS (SELECT session, q.id, regexp_extract(q.id, '^(.+):[0-9]+$', 1) AS doc FROM q), o AS (SELECT d.*, CASE WHEN doc = '' THEN 'invalid' WHEN coalesce(session, '') = '' OR p.session_id IS DISTINCT FROM session THEN 'outside' WHEN c.id IS NULL THEN 'missing' ELSE 'found' END AS outcome, c.doc_id, title, p.source_format, section_path, page_no, text
FROM d LEFT JOIN p ON p.doc_id = doc LEFT JOIN c ON c.id = d.id)
SELECT session, id, outcome, CASE WHEN outcome = 'found' THEN doc_id END AS doc_id, CASE WHEN outcome = 'found' THEN title END AS title, CASE WHEN outcome = 'found' THEN coalesce(source_format, '') END AS source_format,
CASE WHEN outcome = 'found' THEN array_to_string(coalesce(section_path, []), ' > ') END AS section, CASE WHEN outcome = 'found' THEN coalesce(page_no, 0) END AS page_no, CASE WHEN outcome = 'found' THEN length(text) END AS size FROM o""",
    "document_meta": f"""WITH {SQL_P}, {SQL_E}, q AS (SELECT DISTINCT document_id AS doc FROM e), o AS (SELECT doc, CASE WHEN coalesce(trim(doc), '') = '' THEN 'invalid' WHEN session_id IS DISTINCT FROM '{SESSION}' THEN 'outside' ELSE 'found' END AS outcome, title, source_format, full_text FROM q LEFT JOIN p ON p.doc_id = doc)
SELECT '{SESSION}' AS session, doc AS doc_id, outcome, CASE WHEN outcome = 'found' THEN coalesce(title, '') END AS title, CASE WHEN outcome = 'found' THEN coalesce(source_format, '') END AS source_format, CASE WHEN outcome = 'found' THEN length(coalesce(full_text, '')) END AS size FROM o""",
    "page_for_span": f"""WITH {SQL_C}, {SQL_E}, s AS (SELECT * FROM e WHERE document_id IS NOT NULL AND start_offset < end_offset),
m AS (SELECT evidence_id, arg_min(c.page_no, (charspan[1], chunk_index, id)) AS page FROM s JOIN c ON c.doc_id = s.document_id AND charspan[2] > start_offset AND charspan[1] < end_offset AND charspan[1] < charspan[2] GROUP BY evidence_id)
SELECT evidence_id, coalesce(page, 0) AS page_no FROM s LEFT JOIN m USING (evidence_id)""",
}
