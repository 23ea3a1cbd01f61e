"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators.blocks import lines
from lexloom.plans import common
from lexloom.plans.common import BLANK, SQL_C, SQL_P
from lexloom.sources.tables import table


def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


def sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.documents(spark, folder, "full_text").select("doc_id", F.posexplode(tx.sentences(F.col("full_text"))).alias("n", "sentence")).withColumn("size", F.length("sentence"))
    end = F.sum("size").over(W.partitionBy("doc_id").orderBy("n"))
    return rows.select("doc_id", "n", (end - F.col("size")).alias("start_offset"), end.alias("end_offset"))


def sentence_stats(spark: SparkSession, folder: str) -> DataFrame:
    sizes = F.transform(tx.sentences(F.col("text")), F.length)
    return table(spark, folder, "documents").select("doc_id", F.size(sizes).alias("sentences"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"))


def search_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.search_tokens(F.col("text"))
    return common.chunks(spark, folder, "text").select("id", F.size(tokens).cast("long").alias("tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest"))


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    tokens = common.chunks(spark, folder, "text").select("id", F.explode(tx.search_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token", "id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


def head_snippet(spark: SparkSession, folder: str) -> DataFrame:
    return common.chunks(spark, folder, "text").select("id", tx.head_snippet(F.col("text")).alias("snippet"))


def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    return common.documents(spark, folder, "file_path", "full_text").select("doc_id", tx.document_key(F.col("file_path"), F.col("full_text")).alias("made_key"))


def chunk_keys(spark: SparkSession, folder: str) -> DataFrame:
    doc, index = tx.chunk_key_parts(F.col("id"))
    return common.chunks(spark, folder).select("id", doc.alias("doc_id"), index.alias("chunk_index"))


def line_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return lines(common.documents(spark, folder, "full_text"), "doc_id", "full_text").drop("line")


def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(common.documents(spark, folder, "full_text"), "doc_id", "full_text")
    levels = rows.select("doc_id", "line_no", tx.heading_level(F.col("line")).alias("level"), tx.raw_heading_level(F.col("line")).alias("raw_level"))
    return levels.filter("raw_level is not null")


def title_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Title from the text: the first line if it is short and no sentence, else the first heading, else the file name."""
    rows = lines(common.documents(spark, folder, "full_text", "file_path"), "doc_id", "full_text").withColumn("line", F.regexp_replace("line", f"^[{BLANK}]+|[{BLANK}]+$", "")).filter("line != ''")
    first = rows.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("first"), F.min_by(F.when(tx.heading_level(F.col("line")).isNotNull(), F.col("line")), F.when(tx.heading_level(F.col("line")).isNotNull(), F.col("line_no"))).alias("heading"))
    short = F.when((F.length("first") <= 30) & ~F.col("first").rlike(tx.SENTENCE_END), F.col("first"))
    named = common.documents(spark, folder, "file_path").join(first, "doc_id", "left")
    return named.select("doc_id", F.coalesce(short, "heading", F.substring_index("file_path", "/", -1)).alias("title"))


def embedding_input(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.chunks(spark, folder, "doc_title", "section_path", "text")
    made = tx.embedding_text(F.col("doc_title"), F.col("section_path"), F.col("text"))
    return rows.select("id", F.length(made).alias("size"), F.md5(made.cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (token_estimate, sentence_spans, sentence_stats, search_tokens, term_frequencies, head_snippet, document_keys, chunk_keys, line_offsets, heading_levels, title_inference, embedding_input)}

SENTENCES = f"[^{tx.TERMINATORS}]*[{tx.TERMINATORS}][{BLANK}]*|[^{tx.TERMINATORS}]+$"
STRIPPED = f"regexp_replace(line, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"
SQL_LINES = """parts AS (SELECT doc_id, string_split(regexp_replace(full_text, '\\n$', ''), chr(10)) AS ls FROM p WHERE length(full_text) > 0),
numbered AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM parts)"""
LEVEL = f"""CASE WHEN length(t) <= 60 AND NOT regexp_matches(t, '{tx.SENTENCE_END}') THEN CASE
  WHEN regexp_matches(t, '{tx.CHAPTER}') THEN 1
  WHEN regexp_extract(t, '{tx.NUMBERED}', 1) <> '' THEN length(regexp_replace(regexp_extract(t, '{tx.NUMBERED}', 1), '[^.]', '', 'g')) + 1
  WHEN (regexp_matches(t, '{tx.ROMAN}') AND regexp_matches(t, '{tx.ROMAN_FORM}')) OR regexp_matches(t, '{tx.LETTERED}') THEN 2
  WHEN regexp_matches(t, '{tx.BRACKETED}') THEN 3 END END"""

ORACLE = {
    "token_estimate": f"SELECT doc_id, {common.sql_estimate('text')} AS tokens FROM documents",
    "sentence_spans": f"""WITH {SQL_P}, parts AS (SELECT doc_id, regexp_extract_all(full_text, '{SENTENCES}') AS ss FROM p),
rows AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS n FROM parts),
ended AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM rows)
SELECT doc_id, n, CAST(e - length(s) AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset FROM ended""",
    "sentence_stats": f"""WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{SENTENCES}'), lambda x: length(x)) AS sizes FROM documents)
SELECT doc_id, len(sizes) AS sentences, coalesce(list_max(sizes), 0) AS longest FROM s""",
    "search_tokens": f"WITH {SQL_C}, t AS (SELECT id, {common.sql_tokens('text')} AS tokens FROM c) SELECT id, len(tokens) AS tokens, md5(array_to_string(tokens, ' ')) AS digest FROM t",
    "term_frequencies": f"WITH {SQL_C}, t AS (SELECT id, unnest({common.sql_tokens('text')}) AS token FROM c) SELECT token, count(DISTINCT id) AS chunks, count(*) AS uses FROM t GROUP BY token",
    "head_snippet": f"WITH {SQL_C} SELECT id, left(text, 200) AS snippet FROM c",
    "document_keys": f"WITH {SQL_P} SELECT doc_id, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') || '-' || left(md5(full_text), 8) AS made_key FROM p",
    "chunk_keys": f"WITH {SQL_C} SELECT id, regexp_extract(id, '^(.*):[^:]*$', 1) AS doc_id, TRY_CAST(regexp_extract(id, ':([0-9]+)$', 1) AS INT) AS chunk_index FROM c",
    "line_offsets": f"""WITH {SQL_P}, {SQL_LINES}, ended AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM numbered)
SELECT doc_id, line_no, CAST(e - length(line) AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset FROM ended""",
    "heading_levels": f"""WITH {SQL_P}, {SQL_LINES}, cut AS (SELECT doc_id, line_no, {STRIPPED} AS t FROM numbered), leveled AS (SELECT *, {LEVEL} AS level FROM cut)
SELECT doc_id, line_no, level, coalesce(level, CASE WHEN t <> '' AND length(t) <= 80 AND (regexp_matches(t, '{tx.NAMED}')
  OR (length(t) <= 60 AND len(regexp_extract_all(t, '\\p{{L}}')) > 0 AND len(regexp_extract_all(t, '\\p{{Lu}}')) / len(regexp_extract_all(t, '\\p{{L}}')) >= 0.8 AND NOT ends_with(t, '.'))) THEN 1 END) AS raw_level
FROM leveled WHERE raw_level IS NOT NULL""",
    "title_inference": f"""WITH {SQL_P}, {SQL_LINES}, cut AS (SELECT doc_id, line_no, {STRIPPED} AS t FROM numbered), leveled AS (SELECT *, {LEVEL} AS level FROM cut WHERE t <> ''),
firsts AS (SELECT doc_id, arg_min(t, line_no) AS f, arg_min(t, line_no) FILTER (level IS NOT NULL) AS h FROM leveled GROUP BY doc_id)
SELECT p.doc_id, coalesce(CASE WHEN length(f) <= 30 AND NOT regexp_matches(f, '{tx.SENTENCE_END}') THEN f END, h, regexp_extract(file_path, '[^/]*$')) AS title FROM p LEFT JOIN firsts USING (doc_id)""",
    "embedding_input": f"""WITH {SQL_C}, trails AS (SELECT id, text, nullif(trim(doc_title), '') AS t, nullif(array_to_string(list_filter(coalesce(section_path, []), lambda s: s IS NOT NULL AND s <> ''), ' > '), '') AS trail FROM c),
heads AS (SELECT id, text, left(concat_ws(' | ', t, trail), 400) AS head FROM trails), made AS (SELECT id, CASE WHEN head <> '' THEN head || chr(10) || text ELSE text END AS m FROM heads)
SELECT id, length(m) AS size, md5(m) AS digest FROM made""",
}
