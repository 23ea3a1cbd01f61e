"""Maintenance of the document and chunk tables: upserts, sessions, repairs, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators.slices import slices


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of the same key; of several new rows of a key the last by ``order`` counts."""
    columns = stored.columns
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), order).alias("row")).select(*[F.col(key) if c == key else F.col("row")[c].alias(c) for c in columns])
    return stored.join(latest.select(key), key, "left_anti").select(*columns).unionByName(latest)


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that occur in ``new`` are replaced by those in ``new``."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def assign_session(documents: DataFrame, chosen: Column, session: str) -> DataFrame:
    """The chosen documents in a session; the empty session takes them out of any."""
    return documents.withColumn("session_id", F.when(chosen, F.lit(session)).otherwise(F.col("session_id")))


def restore_texts(documents: DataFrame, exported: DataFrame) -> DataFrame:
    """Documents whose text is empty get the one of ``exported`` (``doc_id, full_text``), if it has one."""
    there = exported.groupBy("doc_id").agg(F.max("full_text").alias("_text"))
    return documents.join(there, "doc_id", "left").withColumn("full_text", F.when(F.coalesce("full_text", F.lit("")) == "", F.coalesce("_text", "full_text")).otherwise(F.col("full_text"))).drop("_text")


def pending_tokens(chunks: DataFrame) -> DataFrame:
    """``(id, search_tokens)`` of the chunks whose search tokens are missing or empty; a text without tokens keeps the empty string."""
    missing = chunks.filter(F.coalesce("search_tokens", F.lit("")) == "")
    return missing.select("id", F.coalesce(F.array_join(tx.search_tokens(F.col("text")), " "), F.lit("")).alias("search_tokens"))


def _stored(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    lo, hi = F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))
    spans = chunks.select(F.lit("chunk").alias("kind"), "id", F.col("doc_id").alias("doc"), lo.alias("lo"), hi.alias("hi"), "text")
    return slices(spans, documents.select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text")))


def repaired_spans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, start_offset, end_offset)`` of the chunks whose span wrongly begins one character early, at a line break.

    Such a span is one longer than the text, and without its first character it is the text.
    """
    off = _stored(chunks, documents).filter(F.col("hi") - F.col("lo") == F.length("text") + 1)
    off = off.filter(F.col("slice") == F.concat(F.lit("\n"), F.col("text")))
    return off.select("id", (F.col("lo") + 1).alias("start_offset"), F.col("hi").alias("end_offset"))


def misaligned(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, reason)`` of the chunks whose span is impossible (``span``) or whose text is not the slice of their document (``text``)."""
    lo, hi = F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))
    sizes = documents.select("doc_id", F.length("full_text").alias("size"))
    fits = F.coalesce((lo >= 0) & (lo < hi) & (hi <= F.col("size")), F.lit(False))
    right = _stored(chunks, documents).filter("text = slice").select("id", F.lit(True).alias("right"))
    rows = chunks.join(sizes, "doc_id", "left").join(right, "id", "left")
    return rows.select("id", F.when(~fits, "span").when(F.col("right").isNull(), "text").alias("reason")).filter("reason is not null")


def export_documents(documents: DataFrame, path: str) -> None:
    """One JSON line per document, spread over files by document."""
    documents.write.mode("overwrite").json(path)
