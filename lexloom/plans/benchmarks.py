"""Queries on sources, benchmarks and summaries of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import json as js
from lexloom.operators import chunking, sessions, summaries
from lexloom.operators import evidence as ev
from lexloom.plans import common
from lexloom.plans.common import SQL_C, SQL_E, SQL_P
from lexloom.session import shared_dir
from lexloom.sources import benchmarks, corpus
from lexloom.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"


def _nli_file(spark: SparkSession, folder: str) -> str:
    """The inference items as the benchmark publishes them: a line per premise with its hypotheses."""
    items = table(spark, folder, "test_item").filter("benchmark = 'nli'")
    pair = F.struct("item_id", F.struct(F.col("query").alias("hypothesis"), "label").alias("pair"))
    lines = items.groupBy(F.col("text").alias("premise"), "subset").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    path = _folder(spark)
    lines.select("premise", "subset", F.col("pairs.pair").alias("hypothesises/labels")).write.json(path)
    return path


def nli_instances(spark: SparkSession, folder: str) -> DataFrame:
    rows = benchmarks.nli_instances(spark, _nli_file(spark, folder))
    return rows.select("subset", F.md5(F.col("premise").cast("binary")).alias("premise"), "n", "hypothesis", "label")


def nli_premises(spark: SparkSession, folder: str) -> DataFrame:
    rows = benchmarks.nli_premises(spark, _nli_file(spark, folder))
    return rows.select("subset", F.md5(F.col("premise").cast("binary")).alias("premise"), "premise_len", "n_hypotheses")


def span_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Gold spans of every question, written as a benchmark and read again: the documents and spans of its verified evidence."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "start_offset", "end_offset", "quote", "verified").filter("question_id is not null and verified")
    snippet = F.struct(F.col("document_id").alias("file_path"), F.array("start_offset", "end_offset").alias("span"), F.col("quote").alias("answer"))
    tests = rows.groupBy(F.col("question_id").alias("query")).agg(F.collect_list(snippet).alias("snippets"))
    path = _folder(spark)
    tests.select(F.array(F.struct("query", "snippets")).alias("tests")).write.json(path)
    return benchmarks.span_queries(spark, path, lines=True).filter("start is not null and end is not null").select("query", "file_path", "start", "end", F.md5(F.col("answer").cast("binary")).alias("answer"))


def gold_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Does every quote stand where its offsets say, line breaks aside?"""
    gold = common.evidence(spark, folder, "document_id", "start_offset", "end_offset", "quote").filter("document_id is not null and start_offset < end_offset")
    gold = gold.select(F.col("evidence_id").alias("key"), F.col("document_id").alias("file_path"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.col("quote").alias("answer"))
    texts = common.documents(spark, folder, "full_text").select(F.col("doc_id").alias("file_path"), F.col("full_text").alias("text"))
    return benchmarks.gold_alignment(gold, texts).select(F.col("key").alias("evidence_id"), "aligned")


def corpus_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All corpus texts taken in as files: what becomes of each, and how many chunks it has."""
    files = table(spark, folder, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), "text")
    documents, _ = corpus.ingested(files, "corpus", "ws-corpus")
    return documents.select("doc_id", "title", "session_id", F.coalesce("skipped", F.lit("")).alias("skipped"), "chunks")


def corpus_skips(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus texts that are no documents, and why."""
    files = table(spark, folder, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), "text")
    return corpus.corpus_documents(files, "corpus", "ws-corpus").filter("skipped is not null").select("doc_id", "file_path", "title", "skipped")


def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk records of fixed-size chunks; blank ones leave gaps in the index."""
    documents = common.documents(spark, folder, "full_text")
    rows = chunking.chunk_rows(documents, chunking.fixed_chunks(documents))
    return rows.select("id", "doc_id", "chunk_index", F.col("charspan")[0].alias("start_offset"), F.col("charspan")[1].alias("end_offset"), "chapter", "section", "page_no", F.md5(F.col("text").cast("binary")).alias("digest"))


def trimmed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Beginnings of chunks within 100 tokens."""
    cut = chunking.trimmed(F.col("text"), 100)
    return common.chunks(spark, folder, "text").select("id", F.length(cut).alias("size"), F.md5(cut.cast("binary")).alias("digest"))


def json_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The properties of every event out of an answer that fences them and leaves a comma too many."""
    answer = F.concat(F.lit("```json\nHere you are: "), F.regexp_replace("props", "\\}$", ",}"), F.lit(" - done\n```"))
    read = js.json_object(answer)
    return table(spark, folder, "events").select("event_id", F.get_json_object(read, "$.k").try_cast("bigint").alias("k"), js.json_object(F.col("event_type")).alias("none"))


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of tools in every user's messages, one after the other."""
    call = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}</tool_call>"))
    text = F.concat(F.lit("first "), call, F.lit(" <tool_call>not json</tool_call> then\n"), call)
    rows = table(spark, folder, "events").select("event_id", F.explode(js.tool_calls(text)).alias("call"))
    return rows.select("event_id", "call.id", "call.name", F.get_json_object("call.arguments", "$.k").try_cast("bigint").alias("k"))


def request_subsample(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the items, benchmarks and labels in proportion."""
    items = table(spark, folder, "test_item").select("item_id", F.concat_ws("/", "benchmark", F.coalesce("label", F.lit("-"))).alias("stratum"))
    return sessions.subsample(items, "stratum", "item_id", 0.1)


def requested_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that some question's evidence names: the ones to take in for these requests."""
    named = common.evidence(spark, folder, "document_id").select(F.col("document_id").alias("doc_id"))
    return common.documents(spark, folder, "title", "source_format").join(named, "doc_id", "left_semi")


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the items of each benchmark and subset, and their share of it."""
    counts = table(spark, folder, "test_item").groupBy("benchmark", "subset", F.coalesce("label", F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("benchmark", "subset").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["benchmark", "subset"]).select("benchmark", "subset", "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that score high for a question against those with verified evidence."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "retrieval_score", "verified").select(F.col("question_id").alias("query"), F.col("document_id").alias("document"), "retrieval_score", "verified")
    return summaries.document_scores(rows.filter("retrieval_score >= 0.5"), rows.filter("verified"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each question as a run: its evidence is verified anew, and its verdict is held against the stored one."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "start_offset", "end_offset", "quote", "section_path", "source_chunk_ids", "verified").filter("question_id is not null")
    made = ev.verify(rows, common.chunks(spark, folder, "doc_id", "chunk_index", "text", "section_path", "page_no", "charspan"), common.documents(spark, folder, "full_text"))
    rows = rows.select("question_id", "evidence_id", "source_chunk_ids", F.col("verified").alias("stored")).join(made, "evidence_id")
    verdict = lambda c: F.when(F.bool_or(c), "entailment").otherwise("neutral")
    records = rows.groupBy("question_id").agg(
        F.count("*").alias("candidates"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(~F.col("verified"), 1)).alias("rejected"), F.sum(F.size("source_chunk_ids")).alias("searches"),
        verdict(F.coalesce("stored", F.lit(False))).alias("gold_label"), verdict(F.col("verified")).alias("label"),
        F.count("*").alias("cited"), F.count(F.when(F.col("verified"), 1)).alias("cited_matched"),
    )
    reasons = rows.filter("reason != ''").groupBy("question_id", "reason").agg(F.count("*").alias("n")).groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("reason", F.col("n").cast("string")))).alias("reasons"))
    records = records.join(reasons, "question_id", "left").select("*", F.lit(True).alias("valid"), F.lit(True).alias("completed"), F.when(F.col("verified") == 0, "no_effective_new_evidence").otherwise("answered").alias("stop_reason"))
    return summaries.run_summary(records).select("records", "errors", "accuracy", "f1_weighted", "candidates", "verified", "rejected", "searches", "citation_rate", "searches_avg", "reasons", "stop_reasons")


def export_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence written as JSON lines in two goes and read again."""
    rows, path = common.evidence(spark, folder, "question_id", "source_chunk_ids", "quote", "verified"), _folder(spark)
    for part in ("verified", "not coalesce(verified, false)"):
        corpus.append_jsonl(rows.filter(part), path)
    read = spark.read.schema(rows.schema).json(path)
    return read.select("evidence_id", "question_id", F.array_join("source_chunk_ids", ",").alias("chunk_ids"), F.md5(F.col("quote").cast("binary")).alias("digest"), "verified")


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence written as CSV, arrays as JSON, and read again."""
    rows, path = common.evidence(spark, folder, "question_id", "source_chunk_ids", "quote"), _folder(spark)
    corpus.write_csv(rows, path)
    schema = "evidence_id string, question_id string, source_chunk_ids string, quote string"
    read = spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").option("nullValue", "\\N").csv(path)
    chunks = F.from_json("source_chunk_ids", "array<string>")
    return read.select("evidence_id", "question_id", F.array_join(chunks, ",").alias("chunk_ids"), F.md5(F.coalesce("quote", F.lit("")).cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        nli_instances, nli_premises, span_queries, gold_alignment, corpus_ingest, corpus_skips, chunk_records, trimmed_chunks, json_repair, tool_calls, request_subsample, requested_documents, label_distribution, document_scores,
        run_summary, export_evidence, export_csv,
    )
}

VERIFIED = "coalesce(verified, false)"
ORACLE = {
    "nli_instances": "SELECT subset, md5(text) AS premise, row_number() OVER (PARTITION BY text, subset ORDER BY item_id) - 1 AS n, query AS hypothesis, label FROM test_item WHERE benchmark = 'nli'",
    "nli_premises": "SELECT subset, md5(text) AS premise, length(text) AS premise_len, count(*) AS n_hypotheses FROM test_item WHERE benchmark = 'nli' GROUP BY text, subset",
    "span_queries": f"""WITH {SQL_E} SELECT question_id AS query, document_id AS file_path, start_offset AS start, end_offset AS "end", md5(quote) AS answer FROM e
WHERE question_id IS NOT NULL AND verified AND coalesce(document_id, '') <> '' AND start_offset IS NOT NULL AND end_offset IS NOT NULL""",
    "gold_alignment": f"""WITH {SQL_P}, {SQL_E}, x AS (SELECT evidence_id, quote AS q, CASE WHEN start_offset >= 0 THEN coalesce(substring(full_text, start_offset + 1, end_offset - start_offset), '') ELSE '' END AS s FROM e LEFT JOIN p ON p.doc_id = document_id
WHERE document_id IS NOT NULL AND start_offset < end_offset) SELECT evidence_id, q IS NULL OR q = s OR contains(s, replace(q, chr(10), ' ')) OR contains(q, s) AS aligned FROM x""",
    "corpus_skips": f"SELECT 'corpus:' || doc_id || '.txt' AS doc_id, 'corpus/' || doc_id || '.txt' AS file_path, CAST(doc_id AS VARCHAR) AS title, 'empty' AS skipped FROM documents WHERE regexp_replace(coalesce(text, ''), '[{common.BLANK}]+', '', 'g') = ''",
    "chunk_records": f"""WITH RECURSIVE {SQL_P}, {common.sql_fixed(600, 100)}, x AS (SELECT f.*, substring(full_text, s + 1, e - s) AS t FROM fixed f JOIN p USING (doc_id) WHERE n >= 0)
SELECT doc_id || ':' || n AS id, doc_id, n AS chunk_index, s AS start_offset, e AS end_offset, '' AS chapter, '' AS section, 0 AS page_no, md5(t) AS digest FROM x WHERE regexp_replace(t, '[{common.BLANK}]+', '', 'g') <> ''""",
    "json_repair": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none FROM events",
    "tool_calls": "SELECT event_id, 'manual_' || n AS id, event_type AS name, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events, (VALUES (0), (2)) v(n)",
    "request_subsample": """WITH f AS (SELECT item_id, benchmark || '/' || coalesce(label, '-') AS stratum FROM test_item), s AS (SELECT stratum, count(*) AS n FROM f GROUP BY 1),
t AS (SELECT greatest(1, round_even(sum(n) * 0.1, 0)) AS total FROM s), r AS (SELECT stratum, total, total * n / sum(n) OVER () AS raw FROM s, t),
w AS (SELECT stratum, floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, stratum) <= total - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS share FROM r)
SELECT item_id, stratum FROM f JOIN w USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('0' || item_id), item_id) <= share""",
    "requested_documents": f"WITH {SQL_P} SELECT doc_id, title, source_format FROM p WHERE doc_id IN (SELECT document_id FROM evidence)",
    "label_distribution": "WITH x AS (SELECT benchmark, subset, coalesce(label, '(none)') AS label, count(*) AS n FROM test_item GROUP BY 1, 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY benchmark, subset), 6) AS share FROM x",
    "document_scores": f"""WITH {SQL_E}, d AS (SELECT question_id AS query, document_id AS document, coalesce(bool_or(retrieval_score >= 0.5), false) AS r, bool_or({VERIFIED}) AS g FROM e WHERE question_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2)
SELECT query, CAST(count(*) FILTER (r) AS BIGINT) AS retrieved, CAST(count(*) FILTER (g) AS BIGINT) AS gold, CAST(count(*) FILTER (r AND g) AS BIGINT) AS shared, round(coalesce(count(*) FILTER (r AND g) / nullif(count(*) FILTER (r), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (r AND g) / nullif(count(*) FILTER (g), 0), 0), 6) AS recall FROM d WHERE r OR g GROUP BY query""",
    "export_evidence": f"WITH {SQL_E} SELECT evidence_id, question_id, array_to_string(source_chunk_ids, ',') AS chunk_ids, md5(quote) AS digest, verified FROM e",
    "export_csv": f"WITH {SQL_E} SELECT evidence_id, question_id, array_to_string(source_chunk_ids, ',') AS chunk_ids, md5(coalesce(quote, '')) AS digest FROM e",
}
