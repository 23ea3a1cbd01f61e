"""Lookups of sections, chunks and documents for tables of requests, within the session of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators.slices import slices


def sections(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``asked`` (``doc_id, path``) with the chunks of exactly that section path or, where there are none, of all below it.

    An empty path has no section. The result has the columns of ``chunks`` and ``path``; a request without any chunk has no row.
    """
    asked = asked.filter(F.size("path") > 0).select("doc_id", "path").distinct()
    exact = asked.join(chunks, (asked["doc_id"] == chunks["doc_id"]) & (asked["path"] == chunks["section_path"])).drop(asked["doc_id"])
    # Every chunk under each path above its own.
    above = F.transform(F.sequence(F.lit(1), F.size("section_path") - 1), lambda n: F.slice("section_path", F.lit(1), n))
    below = chunks.filter(F.size("section_path") > 1).select("*", F.explode(above).alias("path"))
    unmet = asked.join(exact.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")
    return exact.unionByName(unmet.join(below, ["doc_id", "path"]).select(*exact.columns))


def section_texts(asked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, path, start_offset, end_offset, text, chunk_ids)``: the continuous text of asked sections.

    It is the document's text from the first start to the last end of the section's chunks; where that is impossible, the chunks' texts joined by line breaks, with both offsets 0.
    ``chunks`` have ``id, doc_id, section_path, charspan, text``, ``documents`` ``doc_id, full_text``. Texts meet spans block by block.
    """
    pair = F.size("charspan") == 2
    rows = sections(asked, chunks).select("doc_id", "path", "id", F.when(pair, F.get("charspan", F.lit(0))).alias("lo"), F.when(pair, F.get("charspan", F.lit(1))).alias("hi"), "text")
    part = F.struct(F.col("lo").isNull().alias("n"), "lo", "id", "text")
    held = rows.groupBy("doc_id", "path").agg(F.min("lo").alias("s"), F.max("hi").alias("t"), F.array_sort(F.collect_list(part)).alias("parts"))
    sizes = documents.filter("full_text != ''").select("doc_id", F.length("full_text").alias("size"))
    held = held.join(sizes, "doc_id", "left").withColumn("name", F.array_join("path", "\u001f"))
    fits = held.filter("s >= 0 and s <= t and t <= size")
    spans = fits.select(F.lit("section").alias("kind"), F.col("name").alias("id"), F.col("doc_id").alias("doc"), F.col("s").alias("lo"), F.col("t").alias("hi"), F.lit(None).cast("string").alias("text"))
    cut = slices(spans, documents.select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text"))).select(F.col("doc").alias("doc_id"), F.col("id").alias("name"), "slice")
    rows = held.join(cut, ["doc_id", "name"], "left")
    whole = F.coalesce((F.col("s") >= 0) & (F.col("s") <= F.col("t")) & (F.col("t") <= F.col("size")), F.lit(False))
    text = F.when(whole, F.coalesce("slice", F.lit(""))).otherwise(F.array_join(F.col("parts.text"), "\n"))
    return rows.select("doc_id", "path", F.when(whole, F.col("s")).otherwise(0).alias("start_offset"), F.when(whole, F.col("t")).otherwise(0).alias("end_offset"), text.alias("text"), F.col("parts.id").alias("chunk_ids"))


def _out_of_session(session: str) -> F.Column:
    return F.when(F.coalesce(F.trim("session"), F.lit("")) == "", "outside").when(~F.col(session).eqNullSafe(F.col("session")), "outside")


def chunks_by_id(asked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``asked`` (``session, id``) with ``outcome`` and, where it is ``found``, the facts of the chunk and its document.

    An id that is no document id with an index is ``invalid``; a document that is not in the session, or unknown, is ``outside``; otherwise a chunk that doesn't exist is ``missing``.
    An empty session sees nothing.
    """
    doc, index = tx.chunk_key_parts(F.col("id"))
    rows = asked.filter("id is not null").withColumn("_doc", F.when(index.isNotNull() & (doc != ""), doc))
    known = documents.select(F.col("doc_id").alias("_doc"), "title", "source_format", F.col("session_id").alias("_session"))
    rows = rows.join(known, "_doc", "left").join(chunks.select("id", "doc_id", "text", "section_path", "page_no", "charspan"), "id", "left")
    outcome = F.when(F.col("_doc").isNull(), "invalid").otherwise(F.coalesce(_out_of_session("_session"), F.when(F.col("doc_id").isNull(), "missing"), F.lit("found")))
    rows = rows.withColumn("outcome", outcome)
    found = lambda c, empty=None: F.when(F.col("outcome") == "found", F.col(c) if empty is None else F.coalesce(F.col(c), empty)).alias(c)
    paths = F.array().cast("array<string>")
    return rows.select("session", "id", "outcome", found("doc_id"), found("title"), found("source_format", F.lit("")), found("section_path", paths), found("page_no", F.lit(0)), found("charspan"), found("text"))


def documents_by_id(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """``asked`` (``session, doc_id``) with ``outcome`` (``found``, ``outside``, or ``invalid`` for a blank id) and, where found, title, format and text."""
    known = documents.select("doc_id", "title", "source_format", F.col("session_id").alias("_session"), "full_text")
    rows = asked.join(known, "doc_id", "left")
    outcome = F.when(F.coalesce(F.trim("doc_id"), F.lit("")) == "", "invalid").otherwise(F.coalesce(_out_of_session("_session"), F.lit("found")))
    rows = rows.withColumn("outcome", outcome)
    return rows.select("session", "doc_id", "outcome", *[F.when(F.col("outcome") == "found", F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "source_format", "full_text")])
