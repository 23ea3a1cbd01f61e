"""Queries that run the incremental jobs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans import common
from lexloom.session import shared_dir
from lexloom.streaming import jobs


def _run(job, spark: SparkSession, folder: str, name: str, *options) -> DataFrame:
    path, place = f"{folder}/{name}.parquet", f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    # As a pattern, so that the table may be a single file or a folder of files.
    return job(spark, f"{folder}/{name}.parque[t]", spark.read.parquet(path).schema, *options, f"{place}/out", f"{place}/checkpoint")


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _run(jobs.ingest, spark, folder, "parsed_document", "doc_id")
    return rows.select("doc_id", "source_format", F.length("full_text").alias("size"))


def stream_backfill(spark: SparkSession, folder: str) -> DataFrame:
    rows = _run(jobs.backfill_tokens, spark, folder, "chunks")
    return rows.select("id", F.md5(F.col("search_tokens").cast("binary")).alias("digest"))


def stream_registry(spark: SparkSession, folder: str) -> DataFrame:
    return _run(jobs.register_spans, spark, folder, "evidence")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _run(jobs.windowed_counts, spark, folder, "events")
    return rows.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "events", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_backfill, stream_registry, stream_windows)}
ORACLE = {
    "stream_ingest": f"WITH {common.SQL_P} SELECT doc_id, source_format, length(full_text) AS size FROM p",
    "stream_backfill": f"WITH {common.SQL_C} SELECT id, md5(array_to_string({common.sql_tokens('text')}, ' ')) AS digest FROM c",
    "stream_registry": "SELECT DISTINCT document_id, start_offset, end_offset FROM evidence WHERE document_id IS NOT NULL AND start_offset IS NOT NULL AND end_offset IS NOT NULL",
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
