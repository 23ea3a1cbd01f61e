"""Lines and blocks of documents, with offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as tx


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, start_offset, end_offset, line)`` of every line, without the last empty one."""
    body = F.regexp_replace(F.col(text), "\\n$", "")
    rows = documents.filter(F.length(text) > 0).select(key, F.posexplode(F.split(body, "\\n", -1)).alias("line_no", "line"))
    end = F.sum(F.length("line") + 1).over(W.partitionBy(key).orderBy("line_no")) - 1
    return rows.select(key, "line_no", (end - F.length("line")).alias("start_offset"), end.alias("end_offset"), "line")


def parsed_blocks(documents: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """``(key, block_no, kind, level, text, start_offset, end_offset)``: the stripped non-blank lines as heading and content blocks.

    Offsets lie in the text made of the blocks joined by single line breaks; see :func:`assembled`.
    """
    rows = lines(documents, key, text).select(key, "line_no", F.regexp_replace("line", f"^[{tx.BLANK}]+|[{tx.BLANK}]+$", "").alias("text")).filter("text != ''")
    order = W.partitionBy(key).orderBy("line_no")
    end = F.sum(F.length("text") + 1).over(order) - 1
    level = tx.heading_level(F.col("text"))
    return rows.select(key, (F.row_number().over(order) - 1).alias("block_no"), F.when(level.isNull(), "content").otherwise("heading").alias("kind"), level.alias("level"), "text", (end - F.length("text")).alias("start_offset"), end.alias("end_offset"))


def assembled(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, full_text)``: the blocks of each document in order, joined by line breaks."""
    held = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return held.select(key, F.array_join(F.col("b.text"), "\n").alias("full_text"))
