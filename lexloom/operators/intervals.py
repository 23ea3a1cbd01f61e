"""Periods and gaps of intervals per entity, and other interval algebra.

Starts and ends are sorted independently of each other. The interval structure of an entity is then
read off the ranks: there is a gap exactly where the start of rank r + 1 exceeds the end of rank r,
and between two gaps lies one continuous period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import written

#: Width of the value blocks that share the ranking of one entity among tasks, and at most so many of them meet in one window.
BLOCK = 4096


def levels_for(reach: int, block: int = BLOCK) -> int:
    """How many levels of blocks bring values that span ``reach`` down to at most ``block`` blocks."""
    levels = 1
    while reach // block**levels >= block:
        levels += 1
    return levels


def running_totals(df: DataFrame, key: str, value: str, amount: str, block: int = BLOCK, levels: int = 1) -> DataFrame:
    """``df`` plus ``before``, the sum of ``amount`` over rows of the same key with a smaller ``value``, and ``total``, that of all its rows.

    ``value`` must be a whole number, unique per key. Rows of one key are ranked in blocks of
    ``block`` values, the blocks in blocks of blocks, and so on for ``levels`` levels (see :func:`levels_for`); so no task ever sorts more than ``block`` rows of
    a key at once, however sparse its values are.
    """
    blocked = df.withColumn("_block", F.floor(F.col(value) / block) if block < 1 << 30 else F.expr(f"`{value}` div {block}"))
    totals = blocked.groupBy(key, "_block").agg(F.sum(amount).alias("_total"))
    if levels > 1:
        upper = running_totals(totals.withColumnRenamed("_block", "_value").withColumnRenamed("_total", "_amount"), key, "_value", "_amount", block, levels - 1)
        offsets = upper.select(key, F.col("_value").alias("_block"), F.col("before").alias("_offset"), "total")
    else:
        earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.select(key, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"), F.sum("_total").over(W.partitionBy(key)).alias("total"))
    inside = W.partitionBy(key, "_block").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = blocked.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return ranked.join(offsets, [key, "_block"]).withColumn("before", F.col("before") + F.col("_offset")).drop("_block", "_offset")


def periods_and_gaps(df: DataFrame, entity: str | Column, start: str | Column, end: str | Column, block: int = BLOCK) -> DataFrame:
    """``(entity, kind, start, end)``: the continuous ``period``s of every entity and the ``gap``s between them.

    Intervals are half-open with whole-number bounds. Overlapping, nested and touching ones form one period; nothing precedes
    the first period or follows the last. Rows with a null entity or bound, or whose start is not
    below the end, do not count. Repeated rows change nothing. Entities keep their type, the empty string is an entity like others; an empty
    table gives no rows; other columns are ignored, whatever their names.

    Equal starts (and equal ends) of an entity are counted together before anything is sorted, so an entity
    that holds most rows is pre-aggregated to its distinct bounds, and these are ranked in blocks. Bounds may be sparse, such as times in
    microseconds: the span of all bounds, which is looked up first, tells how many levels of blocks that takes.
    """
    bound = lambda c: (F.col(c) if isinstance(c, str) else c).cast("bigint")
    spans = df.select((F.col(entity) if isinstance(entity, str) else entity).alias("entity"), bound(start).alias("start"), bound(end).alias("end"))
    spans = spans.filter(F.col("entity").isNotNull() & (F.col("start") < F.col("end")))

    first, last, count = spans.agg(F.min("start"), F.max("end"), F.count("*")).first()
    levels = levels_for((last or 0) - (first or 0), block)
    # Rank of the first of equal starts, and of the last of equal ends.
    starts = running_totals(spans.groupBy("entity", F.col("start").alias("at")).agg(F.count("*").alias("n")), "entity", "at", "n", block, levels)
    starts = starts.select("entity", F.col("before").alias("rank"), F.col("at").alias("next_start"))
    ends = running_totals(spans.groupBy("entity", F.col("end").alias("at")).agg(F.count("*").alias("n")), "entity", "at", "n", block, levels)
    ends = ends.select("entity", (F.col("before") + F.col("n")).alias("rank"), F.col("at").alias("last_end"), "total")

    # The start of rank r + 1 beside the end of rank r. A side is missing before the first period, after the last,
    # and where equal bounds hide a rank; the latter is no edge, as the neighbour in rank lies across it.
    edges = starts.join(ends, ["entity", "rank"], "full_outer")
    opens = F.col("next_start").isNotNull() & ((F.col("rank") == 0) | (F.col("next_start") > F.col("last_end")))
    closes = F.col("last_end").isNotNull() & ((F.col("rank") == F.col("total")) | (F.col("next_start") > F.col("last_end")))
    edges = edges.select("entity", "rank", F.when(opens, F.col("next_start")).alias("opening"), F.when(closes, F.col("last_end")).alias("closing"))
    # Written, as three branches read it.
    edges = written(edges.filter(F.col("opening").isNotNull() | F.col("closing").isNotNull()))

    # Pair the n-th opening with the n-th closing; a row that has both is the gap between two periods.
    numbered = running_totals(edges.withColumn("one", F.when(F.col("opening").isNotNull(), 1).otherwise(0)), "entity", "rank", "one", block, levels_for(count, block))
    firsts = numbered.filter("opening is not null").select("entity", (F.col("before") + 1).alias("n"), F.col("opening").alias("start"))
    lasts = numbered.filter("closing is not null").select("entity", F.col("before").alias("n"), F.col("closing").alias("end"))
    periods = firsts.join(lasts, ["entity", "n"]).select("entity", F.lit("period").alias("kind"), "start", "end")
    gaps = edges.filter("opening is not null and closing is not null")
    return periods.unionByName(gaps.select("entity", F.lit("gap").alias("kind"), F.col("closing").alias("start"), F.col("opening").alias("end")))
