"""Evidence: materialising candidates from chunks, verifying quotes against the source, registering, auditing citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators.retrieval import pages_for_spans
from lexloom.operators.slices import slices
from lexloom.session import written

#: A section of at most so many estimated tokens becomes evidence as a whole.
SECTION_TOKENS = 3000
COVERAGE, TOLERANCE = 0.98, 1
NOTE_SIZE = 500


def _spans(chunks: DataFrame) -> DataFrame:
    lo, hi = F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))
    return chunks.select("id", "doc_id", F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), F.when(F.size("charspan") == 2, lo).alias("lo"), F.when(F.size("charspan") == 2, hi).alias("hi"))


def document_sizes(documents: DataFrame) -> DataFrame:
    return documents.filter("full_text != ''").select("doc_id", F.length("full_text").alias("size"))


def materialize(candidates: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per candidate (``key, source_chunk_ids, relevance_note``): its evidence span, or why it has none.

    Gives ``key, reason, doc_id, section_path, start_offset, end_offset, chunk_ids, page_no, note``. A candidate is rejected, by the first
    reason that holds, if it names no chunk (``no-chunks``), one that doesn't exist (``missing-chunk``), chunks of several
    documents (``cross-document``), of a document without text (``no-full-text``), with an impossible span (``invalid-span``), or of
    several sections (``cross-section``). Otherwise the whole section is the evidence if it is small enough, else the union of
    the named chunks; a union with a hole is rejected (``hole``), and so is a blank span (``blank``).
    """
    ids = F.array_distinct(F.filter(F.transform("source_chunk_ids", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "")))
    asked = candidates.select("key", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.left(F.coalesce("relevance_note", F.lit("")), F.lit(NOTE_SIZE)).alias("note"))
    spans, sizes = _spans(chunks), document_sizes(documents)
    placed = spans.join(sizes, "doc_id", "left")

    named = asked.select("key", F.posexplode("ids").alias("pos", "id")).join(placed, "id", "left")
    follows = W.partitionBy("key").orderBy("lo", "hi")
    named = named.withColumn("gap", F.lag("hi").over(follows) < F.col("lo"))
    valid = (F.col("lo") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") <= F.col("size"))
    facts = named.groupBy("key").agg(
        F.bool_or(F.col("doc_id").isNull()).alias("missing"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other_doc"), F.bool_or(F.col("size").isNull()).alias("textless"),
        F.bool_or(~F.coalesce(valid, F.lit(False))).alias("invalid"), F.min("section_path").alias("section_path"), F.max("section_path").alias("other_path"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("hole"),
        F.min("lo").alias("union_lo"), F.max_by("hi", F.struct("lo", "hi")).alias("union_hi"),
    )
    # Written, as are the rows below, because several branches read them.
    facts = written(facts)

    # Every section with its span, chunks in order and size in tokens; the token counts come from its chunks' blocks of text.
    sections = spans.filter(F.size("section_path") > 0).groupBy("doc_id", "section_path").agg(
        F.min("lo").alias("sec_lo"), F.max("hi").alias("sec_hi"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("lo").isNull().alias("n"), "lo", "id"))), lambda x: x["id"]).alias("sec_ids")
    )
    used = sections.join(facts.filter("doc_id = other_doc and section_path = other_path").select("doc_id", "section_path").distinct(), ["doc_id", "section_path"])
    texts = documents.select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text"))
    wanted = used.select(F.lit("section").alias("kind"), F.array_join("section_path", "\u001f").alias("id"), F.col("doc_id").alias("doc"), F.col("sec_lo").alias("lo"), F.col("sec_hi").alias("hi"), F.lit(None).cast("string").alias("text"))
    measured = slices(wanted, texts).select(F.col("doc").alias("doc_id"), F.col("id").alias("trail"), tx.estimated_tokens(F.col("slice")).alias("sec_tokens"))
    used = used.withColumn("trail", F.array_join("section_path", "\u001f")).join(measured, ["doc_id", "trail"], "left").drop("trail")

    rows = asked.join(facts, "key", "left").join(used, ["doc_id", "section_path"], "left")
    whole = F.coalesce((F.size("section_path") > 0) & (F.col("sec_tokens") <= SECTION_TOKENS), F.lit(False))
    reason = (
        F.when(F.size("ids") == 0, "no-chunks").when(F.col("missing"), "missing-chunk").when(F.col("doc_id") != F.col("other_doc"), "cross-document").when(F.col("textless"), "no-full-text")
        .when(F.col("invalid"), "invalid-span").when(F.col("section_path") != F.col("other_path"), "cross-section").when(~whole & F.col("hole"), "hole")
    )
    rows = rows.select(
        "key", reason.alias("reason"), "doc_id", "section_path", "note", F.when(whole, F.col("sec_lo")).otherwise(F.col("union_lo")).alias("start_offset"),
        F.when(whole, F.col("sec_hi")).otherwise(F.col("union_hi")).alias("end_offset"), F.when(whole, F.col("sec_ids")).otherwise(F.col("ids")).alias("chunk_ids"),
    )
    rows = written(rows)
    good = rows.filter("reason is null")
    text = slices(good.select(F.lit("evidence").alias("kind"), F.col("key").alias("id"), F.col("doc_id").alias("doc"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"), F.lit(None).cast("string").alias("text")), texts)
    filled = text.filter(F.trim(F.regexp_replace("slice", f"[{tx.BLANK}]+", "")) != "").select(F.col("id").alias("key"), F.lit(True).alias("filled"))
    paged = pages_for_spans(good.select("key", "doc_id", F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi")), chunks).select("key", "page_no")
    rows = rows.join(filled, "key", "left").join(paged, "key", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("filled").isNull(), "blank").otherwise(F.col("reason")))
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return rows.select("key", "reason", *[kept(c) for c in ("doc_id", "section_path", "start_offset", "end_offset", "chunk_ids", "page_no", "note")])


def verify(evidence: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(evidence_id, verified, reason)``: whether every evidence is exactly its source text and is covered by its chunks.

    The first failing check gives the reason: ``no-full-text``, ``offsets-not-int`` (a null offset), ``offsets-out-of-range``,
    ``quote-mismatch``; then per chunk, in the order named, ``missing-chunk``, ``off-doc-chunk``, ``off-section-chunk``,
    ``invalid-chunk-span``, ``chunk-text-mismatch``; then ``chunks-no-overlap``, ``low-coverage``, ``start-outside``, ``end-outside``.
    Texts are compared where spans meet blocks of a document; a hot document is shared among tasks.
    """
    sizes = document_sizes(documents)
    texts = documents.select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text"))
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    rows = evidence.select("evidence_id", F.col("document_id").alias("doc_id"), F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.coalesce("quote", F.lit("")).alias("quote"), path.alias("path"), "source_chunk_ids").join(sizes, "doc_id", "left")

    quoted = slices(rows.select(F.lit("quote").alias("kind"), F.col("evidence_id").alias("id"), F.col("doc_id").alias("doc"), F.col("s").alias("lo"), F.col("e").alias("hi"), F.col("quote").alias("text")), texts)
    exact = quoted.filter("text = slice").select(F.col("id").alias("evidence_id"), F.lit(True).alias("exact"))
    rows = rows.join(exact, "evidence_id", "left")
    before = (
        F.when(F.col("size").isNull(), "no-full-text").when(F.col("s").isNull() | F.col("e").isNull(), "offsets-not-int")
        .when(~((F.col("s") >= 0) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("size"))), "offsets-out-of-range")
        .when(~(F.coalesce("exact", F.lit(False)) | ((F.col("s") == F.col("e")) & (F.col("quote") == ""))), "quote-mismatch")
    )
    rows = written(rows.withColumn("before", before).drop("quote"))

    named = rows.filter("before is null").select("evidence_id", "doc_id", "path", "s", "e", "size", F.posexplode("source_chunk_ids").alias("pos", "id"))
    lookup = _spans(chunks).join(chunks.select("id", F.col("text")), "id")
    used = lookup.join(named.select("id").distinct(), "id")
    stored = slices(used.select(F.lit("chunk").alias("kind"), "id", F.col("doc_id").alias("doc"), "lo", "hi", "text"), texts)
    right = stored.filter("text = slice").select("id", F.lit(True).alias("right"))
    used = used.select("id", F.col("doc_id").alias("chunk_doc"), F.col("section_path").alias("chunk_path"), "lo", "hi").join(right, "id", "left")
    named = named.join(used, "id", "left")
    fails = (
        F.when(F.col("chunk_doc").isNull(), "missing-chunk").when(F.col("chunk_doc") != F.col("doc_id"), "off-doc-chunk").when(F.col("chunk_path") != F.col("path"), "off-section-chunk")
        .when(~F.coalesce((F.col("lo") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") <= F.col("size")), F.lit(False)), "invalid-chunk-span").when(F.col("right").isNull(), "chunk-text-mismatch")
    )
    named = named.withColumn("fails", fails).withColumn("c_lo", F.greatest("lo", "s")).withColumn("c_hi", F.least("hi", "e"))
    named = written(named.drop("path", "chunk_path", "chunk_doc", "right"))
    first = named.filter("fails is not null").groupBy("evidence_id").agg(F.min_by("fails", "pos").alias("chunk_reason"))

    clipped = named.filter("fails is null and c_lo < c_hi")
    reach = F.max("c_hi").over(W.partitionBy("evidence_id").orderBy("c_lo", "c_hi").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.col("c_hi") - F.greatest(F.col("c_lo"), F.coalesce(reach, F.col("c_lo"))), F.lit(0))
    near = lambda c: (F.col("c_lo") - TOLERANCE <= F.col(c)) & (F.col(c) <= F.col("c_hi") + TOLERANCE)
    cover = clipped.withColumn("added", added).groupBy("evidence_id").agg(F.sum("added").alias("covered"), F.bool_or(near("s")).alias("starts"), F.bool_or(near("e")).alias("ends"))
    rows = rows.join(first, "evidence_id", "left").join(cover, "evidence_id", "left")
    after = (
        F.when(F.col("covered").isNull(), "chunks-no-overlap").when(F.col("covered") / (F.col("e") - F.col("s")) + 1e-9 < COVERAGE, "low-coverage")
        .when(~F.col("starts"), "start-outside").when(~F.col("ends"), "end-outside")
    )
    reason = F.coalesce("before", "chunk_reason", after, F.lit(""))
    return rows.select("evidence_id", (reason == "").alias("verified"), reason.alias("reason"))


def evidence_number(n: Column) -> Column:
    """``E001`` and so on; numbers above 999 just get longer."""
    return F.concat(F.lit("E"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def register(evidence: DataFrame, run: str, order: list, period: Column | None = None) -> DataFrame:
    """``evidence`` with the number of its span within each run: equal spans share the number of the first.

    Adds ``number`` (``E001`` ...) and ``first`` (whether the row is the one registered). Rows without a document or
    offsets are left out. ``order`` is the order of arrival. The distinct spans of a run are numbered period by period: ``period`` must never fall as rows arrive, such as the
    hour of the first column of ``order``; without it a run is one period.
    """
    rows = evidence.filter("document_id is not null and start_offset is not null and end_offset is not null")
    span = W.partitionBy(run, "document_id", "start_offset", "end_offset")
    rows = rows.withColumn("_arrival", F.struct(*order)).withColumn("_first", F.min("_arrival").over(span))
    rows = rows.withColumn("_period", F.lit(0) if period is None else period).withColumn("_period", F.min("_period").over(span))
    spans = rows.select(run, "_period", "_first").distinct()
    before = F.sum("_spans").over(W.partitionBy(run).orderBy("_period").rowsBetween(W.unboundedPreceding, -1))
    periods = spans.groupBy(run, "_period").agg(F.count("*").alias("_spans")).select(run, "_period", F.coalesce(before, F.lit(0)).alias("_before"))
    spans = spans.join(periods, [run, "_period"]).withColumn("_n", F.row_number().over(W.partitionBy(run, "_period").orderBy("_first")) + F.col("_before"))
    rows = rows.drop("_period").join(spans.drop("_period", "_before"), [run, "_first"])
    return rows.withColumn("number", evidence_number(F.col("_n"))).withColumn("first", F.col("_arrival") == F.col("_first")).drop("_arrival", "_first", "_n")


def audit_citations(cited: DataFrame, store: DataFrame) -> DataFrame:
    """Per report of ``cited`` (``report, evidence_id``): its distinct citations, how many exist, are missing, and are verified.

    ``store`` has ``evidence_id`` and ``verified``. A report that cites nothing has no row; its rates would be 0.
    """
    used = cited.filter("evidence_id is not null").select("report", "evidence_id").distinct().join(store.select("evidence_id", F.coalesce("verified", F.lit(False)).alias("ok"), F.lit(1).alias("there")), "evidence_id", "left")
    counts = used.groupBy("report").agg(F.count("*").alias("total"), F.count("there").alias("existing"), F.count(F.when(F.col("ok"), 1)).alias("matched"))
    return counts.select("report", "total", "existing", (F.col("total") - F.col("existing")).alias("missing"), "matched", F.round(F.col("matched") / F.col("total"), 6).alias("rate"))


def conflicting_spans(evidence: DataFrame, width: int = 4096) -> DataFrame:
    """All overlapping spans of a question and document with different verdicts, once each, and how much evidence stands on either side.

    ``(question_id, document_id, s_a, e_a, v_a, n_a, s_b, e_b, v_b, n_b)``: equal spans of one verdict are one class (a null verdict is -1 and differs from both others), so many rows
    on one span don't multiply. Classes meet in blocks of ``width`` characters and count in the block where their overlap begins.
    """
    place = ["question_id", "document_id"]
    side = lambda df, n: df.select(*place, *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c not in place])
    classes = _verdicts(evidence).groupBy(*place, "s", "e", "v").agg(F.count("*").alias("n"))
    cut = classes.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    a, b = side(cut, "a").withColumnRenamed("block_a", "block"), side(cut, "b").withColumnRenamed("block_b", "block")
    met = a.join(b, [*place, "block"]).filter((F.col("v_a") < F.col("v_b")) & (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")))
    return met.filter(F.col("block") == F.floor(F.greatest("s_a", "s_b") / width)).drop("block")


def _verdicts(evidence: DataFrame) -> DataFrame:
    rows = evidence.filter("question_id is not null and document_id is not null and start_offset < end_offset")
    return rows.select("question_id", "document_id", "evidence_id", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.coalesce(F.col("verified").cast("int"), F.lit(-1)).alias("v"))


def conflicting_pairs(evidence: DataFrame, width: int = 4096) -> DataFrame:
    """``(question_id, id_a, id_b)``: the pairs of evidence behind :func:`conflicting_spans`, each unordered pair once."""
    rows, met, place = _verdicts(evidence), conflicting_spans(evidence, width).drop("n_a", "n_b"), ["question_id", "document_id"]
    for n in "ab":
        members = rows.select(*place, *[F.col(c).alias(f"{c}_{n}") for c in ("evidence_id", "s", "e", "v")])
        met = met.join(members, [*place, f"s_{n}", f"e_{n}", f"v_{n}"])
    return met.select("question_id", F.least("evidence_id_a", "evidence_id_b").alias("id_a"), F.greatest("evidence_id_a", "evidence_id_b").alias("id_b"))
