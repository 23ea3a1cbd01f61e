"""Incremental jobs on Structured Streaming, run with ``availableNow``: each call takes in what has arrived since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.functions import text as tx


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def _finish(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _stored(spark: SparkSession, schema: StructType | str, out: str) -> DataFrame:
    """Rows of all batches in ``out``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out)


def _append_new(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """The rows whose keys no earlier batch had, however late they come.

    Keys seen are kept as state, partitioned by key and on the executors' disks, so a batch costs what it brings and not what came before. There is no watermark: no key
    is ever forgotten and no row is too late.
    """
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finish(rows.dropDuplicates(keys).writeStream.format("parquet").option("path", out), checkpoint)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def ingest(spark: SparkSession, path: str, schema: StructType, key: str, out: str, checkpoint: str) -> DataFrame:
    """Rows of new files whose key isn't stored yet, appended to ``out``; a key delivered again, now or later, changes nothing."""
    _append_new(_read(spark, path, schema), [key], out, checkpoint)
    return spark.read.schema(schema).parquet(out)


def backfill_tokens(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str) -> DataFrame:
    """``(id, search_tokens)`` of every new chunk, once."""
    # The texts are tokenised before they are compared by id, so the state holds tokens and no texts.
    made = _read(spark, path, schema).select("id", F.array_join(tx.search_tokens(F.col("text")), " ").alias("search_tokens"))
    _append_new(made, ["id"], out, checkpoint)
    return spark.read.schema("id string, search_tokens string").parquet(out)


def register_spans(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str) -> DataFrame:
    """Distinct evidence spans, each once, whenever it comes again."""
    span = ["document_id", "start_offset", "end_offset"]
    rows = _read(spark, path, schema).filter("document_id is not null and start_offset is not null and end_offset is not null")
    _append_new(rows.select(span), span, out, checkpoint)
    return spark.read.schema("document_id string, start_offset int, end_offset int").parquet(out)


def windowed_counts(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str, width: str = "1 hour") -> DataFrame:
    """``(start, event_type, events, total)`` per window, late rows included: each batch stores its share of every window, and shares add up."""
    rows = _read(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))

    def take(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
        counts.select(F.col("w.start").alias("start"), "event_type", "events", "total").write.mode("overwrite").parquet(f"{out}/batch={number}")

    _finish(rows.writeStream.foreachBatch(take), checkpoint)
    every = _stored(spark, "start timestamp, event_type string, events long, total double", out)
    return every.groupBy("start", "event_type").agg(F.sum("events").alias("events"), F.sum("total").alias("total"))
