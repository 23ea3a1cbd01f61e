"""Folders of text files as documents and chunks, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import chunking


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, text)`` of all ``.txt`` files below a folder, whole, with line breaks of any system as ``\\n`` and bytes that are no UTF-8 replaced. Spark passes over files without a single byte."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    return rows.select(F.col("path").alias("file_path"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"))


def corpus_documents(files: DataFrame, corpus: str, session: str) -> DataFrame:
    """``files`` (``file_path, text``) as documents of a session, named by corpus and file; ``skipped`` tells why a file is none (``empty``), else it is null."""
    name, stem = F.regexp_extract("file_path", "[^/]*$", 0), F.regexp_replace(F.regexp_extract("file_path", "[^/]*$", 0), "\\.[^.]*$", "")
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{tx.BLANK}]+", "") == ""
    return files.select(
        F.left(F.concat(F.lit(corpus + ":"), name), F.lit(200)).alias("doc_id"), "file_path", F.left(stem, F.lit(200)).alias("title"), F.lit("txt").alias("source_format"), F.col("text").alias("full_text"),
        F.lit(session).alias("session_id"), F.when(blank, "empty").alias("skipped"),
    )


def ingested(files: DataFrame, corpus: str, session: str, *, cap: int = 500, overlap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Documents and chunk records of text files; see :func:`corpus_documents` and :func:`lexloom.operators.chunking.chunk_rows`.

    Documents come with the number of their chunks; one without any is skipped as ``no chunks``. Chunks carry their title, format, session and search tokens.
    """
    documents = corpus_documents(files, corpus, session)
    kept = documents.filter("skipped is null")
    chunks = chunking.chunk_rows(kept, chunking.token_budget_chunks(kept, cap=cap, overlap=overlap))
    chunks = chunks.join(kept.select("doc_id", F.col("title").alias("doc_title"), "source_format", "session_id"), "doc_id").withColumn("search_tokens", F.array_join(tx.search_tokens(F.col("text")), " "))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    documents = documents.join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("skipped", F.when(F.col("skipped").isNull() & (F.col("chunks") == 0), "no chunks").otherwise(F.col("skipped")))
    return documents, chunks


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what the folder holds."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; arrays, maps and structs as JSON text."""
    nested = lambda kind: kind.startswith(("array", "map", "struct"))
    flat = rows.select(*[F.to_json(n).alias(n) if nested(t) else F.col(n) for n, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true").option("nullValue", "\\N").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
