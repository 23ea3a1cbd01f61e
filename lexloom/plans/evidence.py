"""Queries on evidence and on metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import evidence as ev
from lexloom.operators import metrics
from lexloom.plans import common
from lexloom.plans.common import SQL_C, SQL_E, SQL_P


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return common.chunks(spark, folder, "doc_id", "chunk_index", "text", "section_path", "page_no", "charspan")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return common.documents(spark, folder, "full_text", "title")


def materialize(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence row's chunk ids and note, taken as a candidate."""
    rows = common.evidence(spark, folder, "source_chunk_ids", "relevance_note").withColumnRenamed("evidence_id", "key")
    found = ev.materialize(rows, _chunks(spark, folder), _documents(spark, folder))
    return found.select("key", "reason", "doc_id", F.array_join("section_path", " > ").alias("section"), "start_offset", "end_offset", F.array_join("chunk_ids", ",").alias("chunk_ids"), "page_no", "note")


def materialize_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates became evidence, and how many were rejected for which reason."""
    rows = common.evidence(spark, folder, "source_chunk_ids", "relevance_note", "question_id")
    made = ev.materialize(rows.withColumnRenamed("evidence_id", "key"), _chunks(spark, folder), _documents(spark, folder))
    return made.groupBy(F.coalesce("reason", F.lit("evidence")).alias("outcome")).agg(F.count("*").alias("candidates"))


def verify_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.evidence(spark, folder, "document_id", "start_offset", "end_offset", "quote", "section_path", "source_chunk_ids")
    return ev.verify(rows, _chunks(spark, folder), _documents(spark, folder))


def register_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each question is a run; evidence arrives in the order of creation."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "start_offset", "end_offset", "created_at").filter("question_id is not null")
    return ev.register(rows, "question_id", ["created_at", "evidence_id"], F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 3600)).select("evidence_id", "question_id", "number", "first")


def citation_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's report cites its evidence and one number that doesn't exist."""
    rows = common.evidence(spark, folder, "question_id", "verified").filter("question_id is not null")
    cited = rows.select(F.col("question_id").alias("report"), "evidence_id")
    cited = cited.unionByName(cited.select("report", F.concat(F.lit("X"), "report").alias("evidence_id")).distinct())
    return ev.audit_citations(cited, rows)


def worker_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per question: candidates, verified and rejected ones, distinct spans, and whether nothing was found."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "start_offset", "end_offset", "verified").filter("question_id is not null")
    span = F.struct("document_id", "start_offset", "end_offset")
    return rows.groupBy("question_id").agg(
        F.count("*").alias("candidates"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(F.coalesce(F.col("verified"), F.lit(False)), None).otherwise(1)).alias("rejected"),
        F.countDistinct(F.when(F.col("verified"), span)).alias("spans"), (F.count(F.when(F.col("verified"), 1)) == 0).alias("no_evidence"),
    )


def tool_result_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks read again within a question are replaced by a stub: reads, stubs and characters spared."""
    rows = common.evidence(spark, folder, "question_id", "source_chunk_ids", "created_at").filter("question_id is not null")
    reads = rows.select("question_id", "created_at", "evidence_id", F.posexplode("source_chunk_ids").alias("pos", "id"))
    again = F.row_number().over(W.partitionBy("question_id", "id").orderBy("created_at", "evidence_id", "pos")) > 1
    reads = reads.withColumn("again", again).join(common.chunks(spark, folder, "text").select("id", F.length("text").alias("size")), "id", "left")
    return reads.groupBy("question_id").agg(F.count("*").alias("reads"), F.count(F.when(F.col("again"), 1)).alias("stubs"), F.coalesce(F.sum(F.when(F.col("again"), F.col("size"))), F.lit(0)).alias("spared"))


def _judged_spans(spark: SparkSession, folder: str) -> DataFrame:
    return common.evidence(spark, folder, "question_id", "document_id", "start_offset", "end_offset", "verified")


def conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All overlapping spans of a question with different verdicts, once each, with the number of rows on either side."""
    return ev.conflicting_spans(_judged_spans(spark, folder))


def conflict_pairs_all(spark: SparkSession, folder: str) -> DataFrame:
    """All overlapping evidence of a question with different verdicts, by id."""
    return ev.conflicting_pairs(_judged_spans(spark, folder))


def effective_new_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Per question, the documents of each day beside those of the day before: is anything gone from the gaps?"""
    rows = common.evidence(spark, folder, "question_id", "document_id", "created_at").filter("question_id is not null and document_id is not null")
    days = rows.groupBy("question_id", F.to_date("created_at").alias("day")).agg(F.array_sort(F.collect_set("document_id")).alias("gaps"))
    before = F.lag("gaps").over(W.partitionBy("question_id").orderBy("day"))
    return days.withColumn("before", before).groupBy("question_id").agg(F.count(F.when(F.col("before").isNull() | (F.size(F.array_except("before", "gaps")) > 0), 1)).alias("effective"), F.count("*").alias("rounds"))


def report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A citation list per question."""
    rows = common.evidence(spark, folder, "question_id", "document_name", "section_path", "quote", "start_offset").filter("question_id is not null")
    label = F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit(""))
    line = F.concat(F.lit("- ["), "evidence_id", F.lit("] "), F.coalesce("document_name", F.lit("")), F.lit(" "), label, F.lit(": "), F.left(F.coalesce("quote", F.lit("")), F.lit(200)))
    lines = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", line.alias("line")))).alias("lines"))
    return lines.select("question_id", F.md5(F.array_join(F.col("lines.line"), "\n").cast("binary")).alias("digest"), F.size("lines").alias("citations"))


def evidence_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Stored quotes beside the text they point to: does the slice hold?"""
    from lexloom.operators.slices import slices

    rows = common.evidence(spark, folder, "document_id", "start_offset", "end_offset", "quote").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), F.col("document_id").alias("doc"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"), F.col("quote").alias("text"))
    documents = _documents(spark, folder).select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text"))
    return slices(rows, documents).select(F.col("id").alias("evidence_id"), F.length("slice").alias("size"), F.coalesce(F.col("text") == F.col("slice"), F.lit(False)).alias("exact"))


def _verified(spark: SparkSession, folder: str, verified: bool) -> DataFrame:
    rows = common.evidence(spark, folder, "document_id", "start_offset", "end_offset", "verified").filter("document_id is not null and start_offset < end_offset")
    return rows.filter(F.col("verified") if verified else F.lit(True)).select(F.col("evidence_id").alias("key"), F.col("document_id").alias("entity"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))


def span_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """All evidence of a document against its verified evidence."""
    return metrics.overlap_lengths(_verified(spark, folder, False), _verified(spark, folder, True)).withColumnRenamed("entity", "document_id")


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of all chunks as gold."""
    lo, hi = common.span()
    return common.chunks(spark, folder, "doc_id", "charspan").select(F.col("doc_id").alias("entity"), lo.alias("start"), hi.alias("end")).filter("start < end")


def span_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Verified evidence against all chunks of each document."""
    return metrics.span_scores(_verified(spark, folder, True), _sections(spark, folder))


def evidence_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.hit_rate(_verified(spark, folder, False), _sections(spark, folder))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of all chunks that verified evidence names, as gold."""
    lo, hi = common.span()
    named = common.evidence(spark, folder, "source_chunk_ids", "verified").filter("verified").select(F.explode("source_chunk_ids").alias("id")).distinct()
    return common.chunks(spark, folder, "doc_id", "charspan").join(named, "id").select(F.col("doc_id").alias("entity"), lo.alias("start"), hi.alias("end")).filter("start < end")


def span_scores_cited(spark: SparkSession, folder: str) -> DataFrame:
    """Verified evidence against every chunk that verified evidence names."""
    return metrics.span_scores(_verified(spark, folder, True), _cited(spark, folder))


def evidence_hit_rate_cited(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.hit_rate(_verified(spark, folder, False), _cited(spark, folder))


def ranking_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a question by their best score, against those with verified evidence."""
    rows = common.evidence(spark, folder, "question_id", "document_id", "retrieval_score", "verified").filter("question_id is not null and document_id is not null")
    order = W.partitionBy("question_id").orderBy(F.desc_nulls_last("retrieval_score"), "evidence_id")
    ranked = rows.select(F.col("question_id").alias("query"), F.col("document_id").alias("document"), F.row_number().over(order).alias("rank"))
    gold = rows.filter("verified").select(F.col("question_id").alias("query"), F.col("document_id").alias("document"))
    return metrics.ranking_scores(ranked, gold)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict as truth; as guess, whether the score is high."""
    rows = common.evidence(spark, folder, "verified", "retrieval_score", "document_id")
    guess = F.when(F.col("retrieval_score") >= 0.5, "true").when(F.col("retrieval_score").isNotNull(), "false")
    return rows.select(F.col("verified").cast("string").alias("truth"), guess.alias("guess"), "document_id")


def f1_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.class_scores(_judged(spark, folder), "truth", "guess")


def classification_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.classification_summary(_judged(spark, folder), "truth", "guess")


def macro_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy per source format, and the mean over formats."""
    formats = common.documents(spark, folder, "source_format").select("doc_id", F.coalesce(F.nullif("source_format", F.lit("")), F.lit("(none)")).alias("format"))
    rows = _judged(spark, folder).join(formats, F.col("document_id") == F.col("doc_id"))
    parts = rows.groupBy("format").agg(F.avg(F.when(F.col("truth").eqNullSafe(F.col("guess")), 1.0).otherwise(0.0)).alias("accuracy"))
    return parts.select("format", F.round("accuracy", 6).alias("accuracy"), F.round(F.avg("accuracy").over(W.partitionBy()), 6).alias("macro"))


def document_quota(spark: SparkSession, folder: str) -> DataFrame:
    """1000 places shared among sessions in proportion to their documents."""
    sizes = common.documents(spark, folder, "session_id").groupBy("session_id").agg(F.count("*").alias("n"))
    return metrics.largest_remainder(sizes.filter("session_id is not null"), "session_id", "n", 1000)


QUERIES = {
    f.__name__: f
    for f in (
        materialize, materialize_summary, verify_reasons, register_spans, citation_audit, worker_summary, tool_result_dedup, conflict_pairs, conflict_pairs_all, effective_new_evidence, report_markdown, evidence_snippets, span_overlap, span_scores,
        evidence_hit_rate, span_scores_cited, evidence_hit_rate_cited, ranking_scores, f1_per_class, classification_summary, macro_accuracy, document_quota,
    )
}

BLANK = common.BLANK
MADE = f"""{SQL_C}, {SQL_P}, {SQL_E},
cand AS (SELECT evidence_id AS key, left(coalesce(relevance_note, ''), 500) AS note, coalesce(source_chunk_ids, []) AS raw FROM e),
ids0 AS (SELECT key, trim(x) AS id, pos FROM (SELECT key, unnest(raw) AS x, generate_subscripts(raw, 1) AS pos FROM cand) WHERE x IS NOT NULL AND trim(x) <> ''),
ids AS (SELECT key, id, min(pos) AS pos FROM ids0 GROUP BY key, id), idl AS (SELECT key, array_agg(id ORDER BY pos) AS ids FROM ids GROUP BY key),
sz AS (SELECT doc_id, length(full_text) AS size FROM p WHERE full_text <> ''),
cs AS (SELECT id, c.doc_id, coalesce(section_path, []) AS sp, CASE WHEN len(charspan) = 2 THEN charspan[1] END AS lo, CASE WHEN len(charspan) = 2 THEN charspan[2] END AS hi, size FROM c LEFT JOIN sz USING (doc_id)),
nm AS (SELECT ids.key, ids.id, cs.doc_id, sp, lo, hi, size, lag(hi) OVER (PARTITION BY ids.key ORDER BY lo, hi) < lo AS gap FROM ids LEFT JOIN cs USING (id)),
fx AS (SELECT key, bool_or(doc_id IS NULL) AS missing, min(doc_id) AS doc_id, max(doc_id) AS other, bool_or(size IS NULL) AS textless, bool_or(NOT coalesce(lo >= 0 AND lo < hi AND hi <= size, false)) AS invalid,
  min(sp) AS sp, max(sp) AS osp, coalesce(bool_or(gap), false) AS hole, min(lo) AS ulo, arg_max(hi, (lo, hi)) AS uhi FROM nm GROUP BY key),
sec AS (SELECT doc_id, sp, min(lo) AS slo, max(hi) AS shi, array_agg(id ORDER BY lo IS NULL, lo, id) AS sids FROM cs WHERE len(sp) > 0 GROUP BY doc_id, sp),
need AS (SELECT DISTINCT doc_id, sp FROM fx WHERE doc_id = other AND sp = osp),
st AS (SELECT sec.*, {common.sql_estimate('substring(full_text, slo + 1, shi - slo)')} AS toks FROM sec JOIN need USING (doc_id, sp) JOIN p USING (doc_id)),
j AS (SELECT cand.key, note, coalesce(ids, []) AS ids, fx.* EXCLUDE (key), slo, shi, sids, coalesce(len(fx.sp) > 0 AND toks <= 3000, false) AS whole FROM cand LEFT JOIN idl USING (key) LEFT JOIN fx USING (key) LEFT JOIN st ON st.doc_id = fx.doc_id AND st.sp = fx.sp),
r AS (SELECT *, CASE WHEN len(ids) = 0 THEN 'no-chunks' WHEN missing THEN 'missing-chunk' WHEN doc_id <> other THEN 'cross-document' WHEN textless THEN 'no-full-text' WHEN invalid THEN 'invalid-span' WHEN sp <> osp THEN 'cross-section' WHEN NOT whole AND hole THEN 'hole' END AS r0,
  CASE WHEN whole THEN slo ELSE ulo END AS s, CASE WHEN whole THEN shi ELSE uhi END AS t FROM j),
b AS (SELECT r.*, CASE WHEN r0 IS NOT NULL THEN r0 WHEN regexp_replace(substring(full_text, s + 1, t - s), '[{BLANK}]+', '', 'g') = '' THEN 'blank' END AS reason FROM r LEFT JOIN p USING (doc_id)),
pg AS (SELECT key, arg_min(c.page_no, (charspan[1], chunk_index, id)) AS page FROM b JOIN c ON c.doc_id = b.doc_id AND charspan[2] > s AND charspan[1] < t AND charspan[1] < charspan[2] WHERE reason IS NULL GROUP BY key)"""

ORACLE = {
    "materialize": f"""WITH {MADE} SELECT key, reason, CASE WHEN reason IS NULL THEN doc_id END AS doc_id, CASE WHEN reason IS NULL THEN array_to_string(sp, ' > ') END AS section, CASE WHEN reason IS NULL THEN s END AS start_offset,
CASE WHEN reason IS NULL THEN t END AS end_offset, CASE WHEN reason IS NULL THEN array_to_string(CASE WHEN whole THEN sids ELSE ids END, ',') END AS chunk_ids, CASE WHEN reason IS NULL THEN coalesce(page, 0) END AS page_no, CASE WHEN reason IS NULL THEN note END AS note FROM b LEFT JOIN pg USING (key)""",
    "materialize_summary": f"WITH {MADE} SELECT coalesce(reason, 'evidence') AS outcome, count(*) AS candidates FROM b GROUP BY 1",
    "verify_reasons": f"""WITH {SQL_C}, {SQL_P}, {SQL_E}, x AS (SELECT evidence_id, document_id AS d, start_offset AS s, end_offset AS t, coalesce(quote, '') AS q, coalesce(e.section_path, []) AS sp, source_chunk_ids AS ids, full_text AS f, length(full_text) AS n
 FROM e LEFT JOIN p ON p.doc_id = e.document_id AND full_text <> ''),
y AS (SELECT *, CASE WHEN f IS NULL THEN 'no-full-text' WHEN s IS NULL OR t IS NULL THEN 'offsets-not-int' WHEN NOT (s >= 0 AND s <= t AND t <= n) THEN 'offsets-out-of-range' WHEN substring(f, s + 1, t - s) <> q THEN 'quote-mismatch' END AS r0 FROM x),
u AS (SELECT evidence_id, d, s, t, sp, f, n, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM y WHERE r0 IS NULL),
v AS (SELECT u.*, CASE WHEN c.id IS NULL THEN 'missing-chunk' WHEN c.doc_id <> d THEN 'off-doc-chunk' WHEN coalesce(c.section_path, []) <> sp THEN 'off-section-chunk' WHEN len(charspan) <> 2 OR NOT coalesce(charspan[1] >= 0 AND charspan[1] < charspan[2] AND charspan[2] <= n, false) THEN 'invalid-chunk-span'
  WHEN substring(f, charspan[1] + 1, charspan[2] - charspan[1]) IS DISTINCT FROM c.text THEN 'chunk-text-mismatch' END AS fail, greatest(charspan[1], s) AS lo, least(charspan[2], t) AS hi FROM u LEFT JOIN c USING (id)),
k AS (SELECT evidence_id, arg_min(fail, pos) AS r1 FROM v WHERE fail IS NOT NULL GROUP BY evidence_id),
o AS (SELECT *, max(hi) OVER (PARTITION BY evidence_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE fail IS NULL AND lo < hi),
g AS (SELECT evidence_id, sum(greatest(hi - greatest(lo, coalesce(reach, lo)), 0)) AS cov, bool_or(lo - 1 <= s AND s <= hi + 1) AS st, bool_or(lo - 1 <= t AND t <= hi + 1) AS en FROM o GROUP BY evidence_id),
z AS (SELECT evidence_id, coalesce(r0, r1, CASE WHEN cov IS NULL THEN 'chunks-no-overlap' WHEN cov / (t - s) + 1e-9 < 0.98 THEN 'low-coverage' WHEN NOT st THEN 'start-outside' WHEN NOT en THEN 'end-outside' END, '') AS reason FROM y LEFT JOIN k USING (evidence_id) LEFT JOIN g USING (evidence_id))
SELECT evidence_id, reason = '' AS verified, reason FROM z""",
    "register_spans": f"""WITH {SQL_E}, r AS (SELECT * FROM e WHERE question_id IS NOT NULL AND document_id IS NOT NULL AND start_offset IS NOT NULL AND end_offset IS NOT NULL),
f AS (SELECT *, first_value(evidence_id) OVER (PARTITION BY question_id, document_id, start_offset, end_offset ORDER BY created_at, evidence_id) AS fid, first_value(created_at) OVER (PARTITION BY question_id, document_id, start_offset, end_offset ORDER BY created_at, evidence_id) AS fat FROM r),
n AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY fat, fid) AS k FROM f)
SELECT evidence_id, question_id, 'E' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS number, evidence_id = fid AS first FROM n""",
    "citation_audit": f"WITH {SQL_E} SELECT question_id AS report, count(*) + 1 AS total, count(*) AS existing, CAST(1 AS BIGINT) AS missing, count(*) FILTER (verified) AS matched, round(count(*) FILTER (verified) / (count(*) + 1), 6) AS rate FROM e WHERE question_id IS NOT NULL GROUP BY question_id",
    "worker_summary": f"""WITH {SQL_E} SELECT question_id, count(*) AS candidates, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT coalesce(verified, false)) AS rejected,
count(DISTINCT CASE WHEN verified THEN (document_id, start_offset, end_offset) END) AS spans, count(*) FILTER (verified) = 0 AS no_evidence FROM e WHERE question_id IS NOT NULL GROUP BY question_id""",
    "tool_result_dedup": f"""WITH {SQL_C}, {SQL_E}, r AS (SELECT question_id, created_at, evidence_id, unnest(source_chunk_ids) AS id, generate_subscripts(source_chunk_ids, 1) AS pos FROM e WHERE question_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY created_at, evidence_id, pos) > 1 AS again FROM r)
SELECT question_id, count(*) AS reads, count(*) FILTER (again) AS stubs, CAST(coalesce(sum(length(text)) FILTER (again), 0) AS BIGINT) AS spared FROM n LEFT JOIN c USING (id) GROUP BY question_id""",
    "conflict_pairs": f"""WITH {SQL_E}, o AS (SELECT question_id, document_id, start_offset AS s, end_offset AS e, coalesce(CAST(verified AS INT), -1) AS v, count(*) AS n FROM e
WHERE question_id IS NOT NULL AND document_id IS NOT NULL AND start_offset < end_offset GROUP BY ALL)
SELECT question_id, document_id, a.s AS s_a, a.e AS e_a, a.v AS v_a, a.n AS n_a, b.s AS s_b, b.e AS e_b, b.v AS v_b, b.n AS n_b FROM o a JOIN o b USING (question_id, document_id) WHERE a.v < b.v AND a.s < b.e AND b.s < a.e""",
    "conflict_pairs_all": f"""WITH {SQL_E}, o AS (SELECT * FROM e WHERE question_id IS NOT NULL AND document_id IS NOT NULL AND start_offset < end_offset)
SELECT a.question_id, a.evidence_id AS id_a, b.evidence_id AS id_b FROM o a JOIN o b ON a.question_id = b.question_id AND a.document_id = b.document_id AND a.evidence_id < b.evidence_id
AND a.start_offset < b.end_offset AND b.start_offset < a.end_offset AND a.verified IS DISTINCT FROM b.verified""",
    "effective_new_evidence": f"""WITH {SQL_E}, d AS (SELECT question_id, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, list_distinct(array_agg(document_id)) AS g FROM e WHERE question_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(g) OVER (PARTITION BY question_id ORDER BY day) AS b FROM d) SELECT question_id, count(*) FILTER (b IS NULL OR len(list_filter(b, lambda x: NOT list_contains(g, x))) > 0) AS effective, count(*) AS rounds FROM l GROUP BY question_id""",
    "report_markdown": f"""WITH {SQL_E}, l AS (SELECT question_id, evidence_id, '- [' || evidence_id || '] ' || coalesce(document_name, '') || ' ' || coalesce(section_path[-1], '') || ': ' || left(coalesce(quote, ''), 200) AS line FROM e WHERE question_id IS NOT NULL)
SELECT question_id, md5(string_agg(line, chr(10) ORDER BY evidence_id)) AS digest, CAST(count(*) AS INT) AS citations FROM l GROUP BY question_id""",
    "evidence_snippets": f"""WITH {SQL_P}, {SQL_E}, s AS (SELECT evidence_id, quote, substring(full_text, start_offset + 1, end_offset - start_offset) AS s FROM e JOIN p ON p.doc_id = e.document_id WHERE start_offset >= 0 AND start_offset < end_offset)
SELECT evidence_id, length(s) AS size, coalesce(quote = s, false) AS exact FROM s WHERE s <> ''""",
    "f1_per_class": "",
    "classification_summary": "",
    "macro_accuracy": f"""WITH {SQL_P}, {SQL_E}, j AS (SELECT CAST(verified AS VARCHAR) AS t, CASE WHEN retrieval_score >= 0.5 THEN 'true' WHEN retrieval_score IS NOT NULL THEN 'false' END AS g, coalesce(nullif(source_format, ''), '(none)') AS format FROM e JOIN p ON p.doc_id = e.document_id),
a AS (SELECT format, avg(CASE WHEN t IS NOT DISTINCT FROM g THEN 1.0 ELSE 0.0 END) AS acc FROM j GROUP BY format) SELECT format, round(acc, 6) AS accuracy, round(avg(acc) OVER (), 6) AS macro FROM a""",
    "document_quota": f"""WITH {SQL_P}, s AS (SELECT session_id, count(*) AS n FROM p WHERE session_id IS NOT NULL GROUP BY session_id), r AS (SELECT session_id, 1000 * n / sum(n) OVER () AS raw FROM s),
w AS (SELECT *, 1000 - sum(floor(raw)) OVER () AS rest, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, session_id) AS place FROM r) SELECT session_id, CAST(floor(raw) + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM w""",
}
MERGED = """{n}m AS (SELECT *, max(t) OVER (PARTITION BY d ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {n}),
{n}g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM {n}m), {n}u AS (SELECT d, min(s) AS s, max(t) AS t FROM {n}g GROUP BY d, k)"""
ALL_SPANS = "a AS (SELECT DISTINCT document_id AS d, start_offset AS s, end_offset AS t FROM e WHERE document_id IS NOT NULL AND start_offset < end_offset)"
OK_SPANS = "b AS (SELECT DISTINCT document_id AS d, start_offset AS s, end_offset AS t FROM e WHERE document_id IS NOT NULL AND start_offset < end_offset AND verified)"
GOLD = "g AS (SELECT DISTINCT doc_id AS d, charspan[1] AS s, charspan[2] AS t FROM c WHERE charspan[1] < charspan[2])"
ORACLE["span_overlap"] = f"""WITH {SQL_E}, {ALL_SPANS}, {OK_SPANS}, {MERGED.format(n='a')}, {MERGED.format(n='b')}, al AS (SELECT d, sum(t - s) AS n FROM au GROUP BY d), bl AS (SELECT d, sum(t - s) AS n FROM bu GROUP BY d),
o AS (SELECT d, sum(least(au.t, bu.t) - greatest(au.s, bu.s)) AS n FROM au JOIN bu USING (d) WHERE least(au.t, bu.t) > greatest(au.s, bu.s) GROUP BY d)
SELECT d AS document_id, CAST(coalesce(al.n, 0) AS BIGINT) AS a_length, CAST(coalesce(bl.n, 0) AS BIGINT) AS b_length, CAST(coalesce(o.n, 0) AS BIGINT) AS overlap FROM al FULL OUTER JOIN bl USING (d) LEFT JOIN o USING (d)"""
ORACLE["span_scores"] = f"""WITH {SQL_C}, {SQL_E}, {OK_SPANS}, {GOLD}, {MERGED.format(n='b')}, {MERGED.format(n='g')}, o AS (SELECT coalesce(sum(least(bu.t, gu.t) - greatest(bu.s, gu.s)), 0) AS n FROM bu JOIN gu USING (d) WHERE least(bu.t, gu.t) > greatest(bu.s, gu.s)),
x AS (SELECT (SELECT coalesce(sum(t - s), 0) FROM bu) AS r, (SELECT coalesce(sum(t - s), 0) FROM gu) AS g, n AS o FROM o), y AS (SELECT *, coalesce(o / nullif(r, 0), 0) AS p, coalesce(o / nullif(g, 0), 0) AS q FROM x)
SELECT CAST(r AS BIGINT) AS retrieved, CAST(g AS BIGINT) AS gold, CAST(o AS BIGINT) AS overlap, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM y"""
ORACLE["evidence_hit_rate"] = f"""WITH {SQL_C}, {SQL_E}, {GOLD}, x AS (SELECT evidence_id, EXISTS (SELECT 1 FROM g WHERE d = document_id AND s < end_offset AND start_offset < t) AS hit FROM e WHERE document_id IS NOT NULL AND start_offset < end_offset)
SELECT count(*) FILTER (hit) AS hits, count(*) AS returned, round(coalesce(count(*) FILTER (hit) / nullif(count(*), 0), 0), 6) AS rate FROM x"""
CITED = "g AS (SELECT DISTINCT doc_id AS d, charspan[1] AS s, charspan[2] AS t FROM c WHERE id IN (SELECT unnest(source_chunk_ids) FROM e WHERE verified) AND charspan[1] < charspan[2])"
ORACLE |= {f"{name}_cited": ORACLE[name].replace(GOLD, CITED) for name in ("span_scores", "evidence_hit_rate")}
ORACLE["ranking_scores"] = (
    f"""WITH {SQL_E}, r AS (SELECT question_id AS query, document_id AS document, verified, row_number() OVER (PARTITION BY question_id ORDER BY retrieval_score DESC NULLS LAST, evidence_id) AS rank FROM e WHERE question_id IS NOT NULL AND document_id IS NOT NULL),
b AS (SELECT query, document, min(rank) AS rank, bool_or(coalesce(verified, false)) AS gold FROM r GROUP BY query, document) SELECT query, """
    + ", ".join(f"round(coalesce(count(*) FILTER (gold AND rank <= {k}) / nullif(count(*) FILTER (gold), 0), 0), 6) AS recall_{k}, round(count(*) FILTER (gold AND rank <= {k}) / {k}, 6) AS precision_{k}" for k in (1, 3, 5, 10))
    + ", round(coalesce(1 / min(rank) FILTER (gold), 0), 6) AS mrr FROM b GROUP BY query"
)
JUDGED = f"{SQL_E}, j AS (SELECT coalesce(CAST(verified AS VARCHAR), 'None') AS t, CASE WHEN retrieval_score >= 0.5 THEN 'true' WHEN retrieval_score IS NOT NULL THEN 'false' ELSE 'None' END AS g FROM e), l AS (SELECT t AS label FROM j UNION SELECT g FROM j), k AS (SELECT label, (SELECT count(*) FROM j WHERE t = label) AS support, (SELECT count(*) FROM j WHERE g = label) AS predicted, (SELECT count(*) FROM j WHERE t = label AND g = label) AS hits FROM l), f AS (SELECT *, round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 6) AS f1 FROM k)"
ORACLE["f1_per_class"] = f"WITH {JUDGED} SELECT * FROM f"
ORACLE["classification_summary"] = f"WITH {JUDGED} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(sum(support * f1) / sum(support), 6) AS f1_weighted FROM f"
