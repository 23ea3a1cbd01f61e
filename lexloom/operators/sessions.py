"""Order-dependent analysis of agent logs: turns, budgets, merged messages, bounded histories, layers of dependent tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators.metrics import largest_remainder
from lexloom.session import written


def turns(log: DataFrame, run: str, order: list) -> DataFrame:
    """``log`` plus ``turn``: 1, 2, ... within each run."""
    return log.withColumn("turn", F.row_number().over(W.partitionBy(run).orderBy(*order)))


def budgeted(log: DataFrame, run: str, order: list, uses: Column, allowed: int) -> DataFrame:
    """``log`` plus ``blocked``: rows that use the run's budget after it has been used ``allowed`` times; blocked rows use nothing."""
    spent = F.sum(F.when(uses, 1).otherwise(0)).over(W.partitionBy(run).orderBy(*order))
    return log.withColumn("blocked", uses & (spent > allowed))


def merged_messages(log: DataFrame, run: str, order: list, role: str, size: str) -> DataFrame:
    """``(run, n, role, messages, size)``: consecutive messages of one role as one."""
    window = W.partitionBy(run).orderBy(*order)
    marked = log.withColumn("_new", F.when(F.lag(role).over(window).eqNullSafe(F.col(role)) & (F.row_number().over(window) > 1), 0).otherwise(1))
    numbered = marked.withColumn("n", F.sum("_new").over(window))
    return numbered.groupBy(run, "n").agg(F.first(role).alias(role), F.count("*").alias("messages"), F.sum(size).alias(size))


def bounded_history(log: DataFrame, run: str, order: list, size: str, budget: int, least: int = 3) -> DataFrame:
    """The rows of each run that fit into ``budget``, oldest dropped first, but never fewer than the last ``least``."""
    back = W.partitionBy(run).orderBy(*[F.desc(c) for c in order])
    rows = log.withColumn("_sum", F.sum(size).over(back)).withColumn("_last", F.row_number().over(back))
    return rows.filter((F.col("_sum") <= budget) | (F.col("_last") <= least)).drop("_sum", "_last")


def islands(log: DataFrame, run: str, time: str, gap_seconds: int) -> DataFrame:
    """``(run, n, first, last, rows)``: stretches of a run without a pause longer than ``gap_seconds``."""
    window = W.partitionBy(run).orderBy(time)
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(F.col(time).cast("timestamp")).over(window)) > gap_seconds * 1_000_000
    rows = log.withColumn("_new", F.when(F.coalesce(pause, F.lit(True)), 1).otherwise(0)).withColumn("n", F.sum("_new").over(window))
    return rows.groupBy(run, "n").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows"))


def layers(edges: DataFrame, parent: str = "parent", child: str = "child", most: int = 1000) -> DataFrame:
    """``(node, layer)``: nodes that depend on nothing are layer 0, others one beyond their furthest parent.

    Each round moves on the nodes whose parents are all placed, and is written to the shared folder. A cycle, or more than ``most`` layers, is an error.
    """
    edges = written(edges.select(F.col(parent).alias("u"), F.col(child).alias("v")).filter("u is not null and v is not null").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    placed = written(nodes.join(edges.select(F.col("v").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0)))
    total, known, layer = nodes.count(), placed.count(), 0
    while known < total:
        layer += 1
        open_ = edges.join(placed.select(F.col("node").alias("v")), "v", "left_anti").join(placed.select(F.col("node").alias("u"), F.lit(1).alias("done")), "u", "left")
        ready = open_.groupBy("v").agg(F.count("*").alias("n"), F.count("done").alias("d")).filter("n = d").select(F.col("v").alias("node"), F.lit(layer).alias("layer"))
        placed = written(placed.unionByName(ready))
        now = placed.count()
        if now == known or layer > most:
            raise ValueError("the dependencies have a cycle")
        known = now
    return placed


def stratified(rows: DataFrame, stratum: str, key: str, shares: DataFrame, seed: str = "0") -> DataFrame:
    """From each stratum as many rows as ``shares`` (``stratum, share``) says, by the md5 of seed and key.

    Hash order stands in for a shuffled list: reproducible, and without gathering anything.
    """
    hashed = rows.withColumn("_md5", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")))
    # Strata are cut by the first digits of the hash: only the range in which the last row taken lies is sorted, never a whole stratum.
    cut = hashed.withColumn("_range", F.conv(F.left("_md5", F.lit(4)), 16, 10).cast("int"))
    before = F.sum("_n").over(W.partitionBy(stratum).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = cut.groupBy(stratum, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    wanted = ranges.join(shares, stratum).filter(F.col("_before") < F.col("share")).select(stratum, "_range", "_before", "share")
    place = F.row_number().over(W.partitionBy(stratum, "_range").orderBy("_md5", key)) + F.col("_before")
    taken = cut.join(wanted, [stratum, "_range"]).withColumn("_place", place).filter(F.col("_place") <= F.col("share"))
    return taken.select(*rows.columns)


def subsample(rows: DataFrame, stratum: str, key: str, ratio: float, seed: str = "0") -> DataFrame:
    """The share ``ratio`` of the rows, at least one, spread over the strata in proportion; see :func:`stratified`."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = max(1, round((sizes.agg(F.sum("n")).first()[0] or 0) * ratio))
    return stratified(rows, stratum, key, largest_remainder(sizes, stratum, "n", total), seed)


def map_sums(df: DataFrame, counts: str) -> DataFrame:
    """``(reason, n)``: the sums of a map column of counts, entries that are no numbers left out."""
    entries = df.select(F.explode(counts).alias("reason", "value"))
    return entries.select("reason", F.col("value").cast("string").try_cast("bigint").alias("value")).filter("value is not null").groupBy("reason").agg(F.sum("value").alias("n"))


def arm_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(metric, a, b, delta)`` of two arms' metrics (``metric, value``); the delta is null unless both arms have the metric."""
    one, two = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    return one.join(two, "metric", "full_outer").select("metric", "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("delta"))
