"""Queries on chunkers, table maintenance and agent logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import blocks, chunking, metrics, sessions, storage
from lexloom.plans import common
from lexloom.plans.common import SQL_C, SQL_E, SQL_P
from lexloom.plans.text import LEVEL
from lexloom.session import shared_dir
from lexloom.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return common.documents(spark, folder, "full_text")


def chunks_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.token_budget_chunks(_documents(spark, folder))
    return rows.withColumn("section_path", F.array_join("section_path", " > "))


def chunks_fixed_chars(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.fixed_chunks(_documents(spark, folder))


def chunks_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sentence_chunks(_documents(spark, folder))


def chunks_structural(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.structural_chunks(blocks.parsed_blocks(_documents(spark, folder)))
    return rows.withColumn("section_path", F.array_join("section_path", " > "))


def parsed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.parsed_blocks(_documents(spark, folder)).drop("text")


def assembled_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks.assembled(blocks.parsed_blocks(_documents(spark, folder)))
    return rows.select("doc_id", F.length("full_text").alias("size"), F.md5(F.col("full_text").cast("binary")).alias("digest"))


def chunk_alignment_audit(spark: SparkSession, folder: str) -> DataFrame:
    return storage.misaligned(common.chunks(spark, folder, "doc_id", "text", "charspan"), _documents(spark, folder))


def span_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Repairs of spans that were made to begin one character early, wherever a line break lies there."""
    lo, hi = common.span()
    rows = common.chunks(spark, folder, "doc_id", "text", "charspan").filter(lo > 0).withColumn("charspan", F.array(lo - 1, hi))
    return storage.repaired_spans(rows, _documents(spark, folder))


def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Late deliveries of documents merged into the first ones."""
    rows = table(spark, folder, "parsed_document").select("doc_id", "title", "source_format", "ingested_at", F.length("full_text").alias("size"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("ingested_at")))
    stored, new = first.filter("n = 1").drop("n"), first.filter("n > 1").drop("n")
    merged = storage.upsert(stored, new.withColumn("title", F.concat(F.lit("late "), F.coalesce("title", F.lit("")))), "doc_id", "ingested_at")
    return merged.select("doc_id", "title", "source_format", "size")


def replaced_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All delivered documents cut anew by size; chunks of documents that were not delivered are kept."""
    stored = common.chunks(spark, folder, "doc_id", "chunk_index")
    new = chunking.fixed_chunks(_documents(spark, folder), most=2000).select(F.concat_ws(":", "doc_id", "n").alias("id"), "doc_id", F.col("n").alias("chunk_index"))
    return storage.replace_children(stored.select("id", "doc_id", "chunk_index"), new, "doc_id")


def assigned_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Unassigned documents moved into a session of their format."""
    rows = common.documents(spark, folder, "session_id", "source_format")
    moved = storage.assign_session(rows, F.coalesce("session_id", F.lit("")) == "", "ws-inbox")
    return moved.groupBy("session_id").agg(F.count("*").alias("documents"))


def restored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All texts emptied and restored from their JSON export."""
    rows = common.documents(spark, folder, "full_text")
    path = f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"
    storage.export_documents(rows, path)
    exported = spark.read.schema("doc_id string, full_text string").json(path)
    restored = storage.restore_texts(rows.withColumn("full_text", F.lit("")), exported)
    return restored.select("doc_id", F.md5(F.col("full_text").cast("binary")).alias("digest"))


def pending_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Search tokens of all chunks, which have none yet."""
    rows = common.chunks(spark, folder, "text").withColumn("search_tokens", F.lit(None).cast("string"))
    return storage.pending_tokens(rows).select("id", F.md5(F.col("search_tokens").cast("binary")).alias("digest"))


# Logs ---------------------------------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def turn_counter(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.turns(_events(spark, folder), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "turn")


def retrieval_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Each user may make three clicks; how many rows of each type are blocked?"""
    rows = sessions.budgeted(_events(spark, folder), "user_id", ["ts", "event_id"], F.col("event_type") == "click", 3)
    return rows.groupBy("user_id").agg(F.count("*").alias("rows"), F.count(F.when(F.col("blocked"), 1)).alias("blocked"))


def merge_same_role(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("size", F.length("props").cast("long"))
    return sessions.merged_messages(rows, "user_id", ["ts", "event_id"], "event_type", "size")


def truncated_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("size", 4 + tx.estimated_tokens(F.col("props")))
    kept = sessions.bounded_history(rows, "user_id", ["ts", "event_id"], "size", 60)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.sum("size").alias("tokens"))


def message_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", (4 + tx.estimated_tokens(F.col("props")) + tx.estimated_tokens(F.col("event_type"))).alias("tokens"))
    return rows.groupBy("user_id").agg(F.sum("tokens").alias("tokens"))


def activity_islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.islands(_events(spark, folder), "user_id", "ts", 6 * 3600)
    return rows.groupBy("user_id").agg(F.count("*").alias("islands"), F.max("rows").alias("longest"))


def stop_reason_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the log's JSON, and its types as reasons."""
    rows = _events(spark, folder).select(F.create_map(F.col("event_type"), F.get_json_object("props", "$.k")).alias("counts"))
    return sessions.map_sums(rows, "counts")


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def ablation_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value per type on even and on odd users, as two arms."""
    rows = _events(spark, folder)
    arm = lambda odd: rows.filter(F.col("user_id") % 2 == odd).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return sessions.arm_deltas(arm(0), arm(1))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """500 chunks, spread over formats in proportion."""
    rows = common.chunks(spark, folder, "source_format").withColumn("source_format", F.coalesce("source_format", F.lit("")))
    shares = metrics.largest_remainder(rows.groupBy("source_format").agg(F.count("*").alias("n")), "source_format", "n", 500)
    return sessions.stratified(rows, "source_format", "id", shares)


def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Questions without any verified evidence yet."""
    rows = common.evidence(spark, folder, "question_id", "verified").filter("question_id is not null")
    return rows.select("question_id").distinct().join(rows.filter("verified").select("question_id"), "question_id", "left_anti")


def normal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read from free answers: each item's own label within a sentence, and its query, which names none."""
    items = table(spark, folder, "test_item").select("item_id", "query", F.coalesce("label", F.lit("")).alias("label"))
    answer = F.concat(F.lit("The answer is "), F.upper("label"), F.lit(", as "), "query")
    return items.select("item_id", tx.normal_label(answer).alias("label"), tx.normal_label(F.col("query")).alias("in_query"))


def section_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Depth of every section below its document, from the parts of its path."""
    rows = common.chunks(spark, folder, "doc_id", "section_path").filter(F.size("section_path") > 0).select("doc_id", "section_path").distinct()
    name = lambda n: F.concat(F.col("doc_id"), F.lit(" / "), F.array_join(F.slice("section_path", F.lit(1), n), " > "))
    steps = rows.select("doc_id", "section_path", F.explode(F.sequence(F.lit(1), F.size("section_path"))).alias("n"))
    edges = steps.select(name(F.col("n") - 1).alias("parent"), name(F.col("n")).alias("child")).distinct()
    return sessions.layers(edges)


QUERIES = {
    f.__name__: f
    for f in (
        chunks_token_budget, chunks_fixed_chars, chunks_sentences, chunks_structural, parsed_blocks, assembled_texts, chunk_alignment_audit, span_repair, upsert_documents, replaced_chunks, assigned_sessions, restored_texts, pending_backfill,
        turn_counter, retrieval_budget, merge_same_role, truncated_history, message_tokens, activity_islands, stop_reason_sums, latest_snapshot, ablation_delta, stratified_sample, resume_pending, normal_labels, section_layers,
    )
}

BLANK = common.BLANK
SLICED = f"{SQL_C}, {SQL_P}"
EVENT_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLE = {
    "chunk_alignment_audit": f"""WITH {SLICED} SELECT id, CASE WHEN NOT coalesce(charspan[1] >= 0 AND charspan[1] < charspan[2] AND charspan[2] <= length(full_text), false) THEN 'span' ELSE 'text' END AS reason FROM c LEFT JOIN p USING (doc_id)
WHERE NOT coalesce(charspan[1] >= 0 AND charspan[1] < charspan[2] AND charspan[2] <= length(full_text), false) OR substring(full_text, charspan[1] + 1, charspan[2] - charspan[1]) IS DISTINCT FROM text""",
    "span_repair": f"""WITH {SLICED} SELECT id, charspan[1] AS start_offset, charspan[2] AS end_offset FROM c JOIN p USING (doc_id) WHERE charspan[1] > 0 AND charspan[2] - charspan[1] = length(text) AND substring(full_text, charspan[1], charspan[2] - charspan[1] + 1) = chr(10) || text""",
    "upsert_documents": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM parsed_document)
SELECT doc_id, CASE WHEN m > 1 THEN 'late ' || coalesce(title, '') ELSE title END AS title, source_format, length(full_text) AS size FROM n WHERE k = m""",
    "assigned_sessions": f"WITH {SQL_P} SELECT CASE WHEN coalesce(session_id, '') = '' THEN 'ws-inbox' ELSE session_id END AS session_id, count(*) AS documents FROM p GROUP BY 1",
    "restored_texts": f"WITH {SQL_P} SELECT doc_id, md5(full_text) AS digest FROM p",
    "pending_backfill": f"WITH {SQL_C} SELECT id, md5(coalesce(array_to_string({common.sql_tokens('text')}, ' '), '')) AS digest FROM c",
    "turn_counter": f"SELECT event_id, user_id, row_number() OVER ({EVENT_ORDER}) AS turn FROM events",
    "retrieval_budget": f"""WITH s AS (SELECT *, event_type = 'click' AND sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER ({EVENT_ORDER}) > 3 AS blocked FROM events)
SELECT user_id, count(*) AS rows, count(*) FILTER (blocked) AS blocked FROM s GROUP BY user_id""",
    "merge_same_role": f"""WITH m AS (SELECT *, CASE WHEN row_number() OVER ({EVENT_ORDER}) > 1 AND lag(event_type) OVER ({EVENT_ORDER}) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER ({EVENT_ORDER}) AS n FROM m) SELECT user_id, CAST(n AS BIGINT) AS n, any_value(event_type) AS event_type, count(*) AS messages, CAST(sum(length(props)) AS BIGINT) AS size FROM g GROUP BY user_id, n""",
    "truncated_history": f"""WITH s AS (SELECT *, 4 + {common.sql_estimate('props')} AS size FROM events), b AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM s)
SELECT user_id, count(*) AS kept, CAST(sum(size) AS BIGINT) AS tokens FROM b WHERE total <= 60 OR last <= 3 GROUP BY user_id""",
    "message_tokens": f"SELECT user_id, CAST(sum(4 + {common.sql_estimate('props')} + {common.sql_estimate('event_type')}) AS BIGINT) AS tokens FROM events GROUP BY user_id",
    "activity_islands": """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM m), i AS (SELECT user_id, n, count(*) AS rows FROM g GROUP BY user_id, n) SELECT user_id, count(*) AS islands, max(rows) AS longest FROM i GROUP BY user_id""",
    "stop_reason_sums": "WITH x AS (SELECT event_type AS reason, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) SELECT reason, CAST(sum(v) AS BIGINT) AS n FROM x WHERE v IS NOT NULL GROUP BY reason",
    "latest_snapshot": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "ablation_delta": """WITH a AS (SELECT event_type AS metric, round(avg(value), 6) AS a FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 6) AS b FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT metric, a, b, round(b - a, 6) AS delta FROM a FULL OUTER JOIN b USING (metric)""",
    "stratified_sample": f"""WITH {SQL_C}, f AS (SELECT id, coalesce(source_format, '') AS source_format FROM c), s AS (SELECT source_format, count(*) AS n FROM f GROUP BY 1), r AS (SELECT source_format, 500 * n / sum(n) OVER () AS raw FROM s),
w AS (SELECT source_format, floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, source_format) <= 500 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS share FROM r)
SELECT id, source_format FROM f JOIN w USING (source_format) QUALIFY row_number() OVER (PARTITION BY source_format ORDER BY md5('0' || id), id) <= share""",
    "resume_pending": f"WITH {SQL_E} SELECT question_id FROM e WHERE question_id IS NOT NULL GROUP BY question_id HAVING count(*) FILTER (verified) = 0",
    "normal_labels": f"SELECT item_id, {common.sql_label("lower('The answer is ' || upper(coalesce(label, '')) || ', as ' || query)")} AS label, {common.sql_label('lower(query)')} AS in_query FROM test_item",
    "section_layers": f"""WITH {SQL_C}, s AS (SELECT DISTINCT doc_id, section_path AS sp FROM c WHERE len(section_path) > 0), n AS (SELECT doc_id, sp, unnest(range(0, len(sp) + 1)) AS k FROM s)
SELECT DISTINCT doc_id || ' / ' || array_to_string(sp[1:k], ' > ') AS node, CAST(k AS INT) AS layer FROM n""",
}
ORACLE["chunks_fixed_chars"] = f"WITH RECURSIVE {SQL_P}, {common.sql_fixed(600, 100)} SELECT doc_id, n, CAST(s AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset FROM fixed WHERE n >= 0"
ORACLE["replaced_chunks"] = f"""WITH RECURSIVE {SQL_C}, {SQL_P}, {common.sql_fixed(2000, 100)}, made AS (SELECT doc_id || ':' || n AS id, doc_id, n AS chunk_index FROM fixed WHERE n >= 0)
SELECT id, doc_id, chunk_index FROM c WHERE doc_id NOT IN (SELECT doc_id FROM made) UNION ALL SELECT * FROM made"""
ORACLE["parsed_blocks"] = f"""WITH {SQL_P}, parts AS (SELECT doc_id, string_split(regexp_replace(full_text, '\\n$', ''), chr(10)) AS ls FROM p WHERE length(full_text) > 0),
numbered AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM parts), cut AS (SELECT doc_id, k, regexp_replace(line, '^[{BLANK}]+|[{BLANK}]+$', '', 'g') AS t FROM numbered),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS block_no, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS e FROM cut WHERE t <> ''), l AS (SELECT *, {LEVEL} AS level FROM b)
SELECT doc_id, CAST(block_no AS INT) AS block_no, CASE WHEN level IS NULL THEN 'content' ELSE 'heading' END AS kind, level, CAST(e - length(t) AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset FROM l"""
ORACLE["assembled_texts"] = f"""WITH {SQL_P}, parts AS (SELECT doc_id, string_split(regexp_replace(full_text, '\\n$', ''), chr(10)) AS ls FROM p WHERE length(full_text) > 0),
kept AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(x, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), lambda x: x <> '') AS ts FROM parts), j AS (SELECT doc_id, array_to_string(ts, chr(10)) AS t FROM kept WHERE len(ts) > 0)
SELECT doc_id, length(t) AS size, md5(t) AS digest FROM j"""
