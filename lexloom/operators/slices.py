"""Slices of document texts by spans, met block by block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import written

#: Documents are cut into blocks of BLOCK characters, each followed by the next REACH characters again.
BLOCK, REACH = 8192, 2048
#: A block that more spans ask for is copied, so that no task meets more than about so many of them.
CROWD = 100_000


def text_blocks(documents: DataFrame, crowded: DataFrame) -> DataFrame:
    """``(doc, block, copy, body)`` of ``(doc, text)``, with as many copies as ``crowded`` (``doc, block, copies``) says, else one; equal repeated deliveries are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                cuts = range(0, len(text), BLOCK)
                bodies = [text[lo : lo + BLOCK + REACH] for lo in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cuts), pa.string()), pa.array(range(len(cuts)), pa.int32()), pa.array(bodies, pa.string())], names=["doc", "block", "body"])

    cut = documents.filter("doc is not null and text is not null").select("doc", "text").mapInArrow(run, "doc string, block int, body string")
    # Copied before they are merged, so that texts are shuffled once.
    copied = cut.join(crowded, ["doc", "block"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    return copied.groupBy("doc", "block", "copy").agg(F.first("body").alias("body"))


def slices(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``spans`` (``kind, id, doc, lo, hi, text``) plus ``slice``: the characters ``[lo, hi)`` of the document.

    ``documents`` has ``doc`` and ``text``. Only spans with 0 <= lo < hi that begin within their document come out; an end
    beyond it is cut off. Texts meet spans block by block, so neither a huge document nor one that holds most
    spans is gathered in one task. Repeated rows of a span come out as often as they occur, or once for long spans.
    """
    longest = documents.agg(F.max(F.length("text"))).first()[0] or 0
    spans = spans.filter("kind is not null and id is not null and lo >= 0 and lo < hi").withColumn("end", F.least("hi", F.lit(longest)))
    at = F.col("lo") - F.col("block") * BLOCK
    kept = ("kind", "id", "doc", "lo", "hi", "text")
    near = spans.filter(F.col("end") - F.col("lo") <= REACH).withColumn("block", F.floor(F.col("lo") / BLOCK).cast("int"))
    far = spans.filter(F.col("end") - F.col("lo") > REACH)
    far = far.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK).cast("int"), F.floor((F.col("end") - 1) / BLOCK).cast("int"))))

    # Crowded blocks are few, at most one per CROWD spans, and written, so that the planner knows how small they are.
    asked = near.select("doc", "block").unionAll(far.select("doc", "block")).groupBy("doc", "block").agg(F.count("*").alias("n"))
    crowded = written(asked.filter(F.col("n") > CROWD).select("doc", "block", F.ceil(F.col("n") / CROWD).cast("int").alias("copies")))
    blocks = text_blocks(documents, crowded)

    def met(some: DataFrame) -> DataFrame:
        some = some.join(crowded, ["doc", "block"], "left").withColumn("copy", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        return some.join(blocks, ["doc", "block", "copy"])

    near = met(near).select(*kept, F.substring("body", at + 1, F.col("end") - F.col("lo")).alias("slice"))
    begin, end = F.greatest(at, F.lit(0)), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK))
    far = met(far).select(*kept, F.struct("block", F.substring("body", begin + 1, end - begin).alias("part")).alias("part"))
    far = far.groupBy("kind", "id", "doc", "lo", "hi").agg(F.first("text").alias("text"), F.array_sort(F.collect_set("part")).alias("parts"))
    return near.unionByName(far.select(*kept, F.array_join(F.col("parts.part"), "").alias("slice"))).filter("slice != ''")
