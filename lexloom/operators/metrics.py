"""Retrieval, span and classification metrics, as aggregations over all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.intervals import periods_and_gaps


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.round(F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0))), 6)


def overlap_lengths(a: DataFrame, b: DataFrame, width: int = 4096) -> DataFrame:
    """``(entity, a_length, b_length, overlap)`` of two tables of intervals (``entity, start, end``), each merged first."""
    merged = lambda df: periods_and_gaps(df, "entity", "start", "end").filter("kind = 'period'").drop("kind")
    x, y = merged(a), merged(b)
    blocks = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    # Cut at block borders, pieces meet only within one block; their overlaps add up.
    cut = lambda df, s, e: df.withColumn("block", blocks).select("entity", "block", F.greatest("start", F.col("block") * width).alias(s), F.least("end", (F.col("block") + 1) * width).alias(e))
    met = cut(x, "s", "e").join(cut(y, "t", "u"), ["entity", "block"]).filter("s < u and t < e")
    shared = met.groupBy("entity").agg(F.sum(F.least("e", "u") - F.greatest("s", "t")).alias("overlap"))
    lengths = lambda df, n: df.groupBy("entity").agg(F.sum(F.col("end") - F.col("start")).alias(n))
    rows = lengths(x, "a_length").join(lengths(y, "b_length"), "entity", "full_outer").join(shared, "entity", "left")
    return rows.select("entity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_length", "b_length", "overlap")])


def span_scores(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Characters retrieved, gold and shared over all entities, with precision, recall and F1; one row."""
    sums = overlap_lengths(retrieved, gold).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a_length", "b_length", "overlap")])
    p, r = F.col("overlap") / F.nullif(F.col("a_length"), F.lit(0)), F.col("overlap") / F.nullif(F.col("b_length"), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return sums.select(F.col("a_length").alias("retrieved"), F.col("b_length").alias("gold"), "overlap", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def hit_rate(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """How many retrieved intervals (``key, entity, start, end``) share a character with a gold one; one row."""
    width = 4096
    blocks = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    rows = retrieved.filter("entity is not null and start < end")
    known = gold.filter("start < end").select("entity", F.col("start").alias("g_start"), F.col("end").alias("g_end")).distinct().withColumn("block", blocks("g_start", "g_end"))
    hits = rows.withColumn("block", blocks("start", "end")).join(known, ["entity", "block"]).filter("g_start < end and start < g_end").select("key").distinct()
    counts = rows.select("key").distinct().join(hits.withColumn("hit", F.lit(1)), "key", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("returned"))
    return counts.select("hits", "returned", ratio(F.col("hits"), F.col("returned")).alias("rate"))


def ranking_scores(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: recall and precision at each k, and the reciprocal rank of the first gold document.

    ``ranked`` has ``query, document, rank`` (repeats of a document count once), ``gold`` ``query, document``. Queries
    without gold or without results score 0.
    """
    known = gold.select("query", "document").distinct().withColumn("gold", F.lit(1))
    best = ranked.groupBy("query", "document").agg(F.min("rank").alias("rank"))
    found = best.join(known, ["query", "document"], "left")
    sizes = known.groupBy("query").agg(F.count("*").alias("n_gold"))
    hits = [F.count(F.when((F.col("rank") <= k) & F.col("gold").isNotNull(), 1)).alias(f"hits_{k}") for k in ks]
    scores = found.groupBy("query").agg(*hits, F.min(F.when(F.col("gold").isNotNull(), F.col("rank"))).alias("first")).join(sizes, "query", "full_outer")
    at = [x for k in ks for x in (ratio(F.coalesce(f"hits_{k}", F.lit(0)), F.coalesce("n_gold", F.lit(0))).alias(f"recall_{k}"), F.round(F.coalesce(f"hits_{k}", F.lit(0)) / k, 6).alias(f"precision_{k}"))]
    return scores.select("query", *at, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(label, support, predicted, hits, f1)`` for every class that occurs as truth or guess; nulls are the class ``None``."""
    pairs = df.select(F.coalesce(F.col(truth).cast("string"), F.lit("None")).alias("t"), F.coalesce(F.col(guess).cast("string"), F.lit("None")).alias("g"))
    counted = pairs.groupBy("t", "g").agg(F.count("*").alias("n"))
    sides = counted.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")))).alias("x"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("h"))
    sums = sides.groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("x.s") > 0, F.col("h")).otherwise(0)).alias("hits"))
    return sums.select("label", "support", "predicted", "hits", ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def classification_summary(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows, accuracy and support-weighted F1; one row, zeros for no rows."""
    scores = class_scores(df, truth, guess)
    sums = scores.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.col("support") * F.col("f1")), F.lit(0.0)).alias("weighted"))
    return sums.select("n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(F.col("weighted"), F.col("n")).alias("f1_weighted"))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``(key, share)``: ``total`` split in proportion to the weights into whole numbers that add up to it.

    Everyone gets the whole part, the largest remainders one more; ties go to the smaller key.
    """
    whole = weights.agg(F.sum(weight)).first()[0]
    raw = weights.select(key, (F.lit(total) * F.col(weight) / F.lit(whole)).alias("raw")).withColumn("whole", F.floor("raw"))
    left = total - (raw.agg(F.sum("whole")).first()[0] or 0)
    # The limit is how many get one more; Spark takes them without sorting all keys in one task.
    more = raw.orderBy(F.desc(F.round(F.col("raw") - F.col("whole"), 9)), key).limit(max(left, 0)).select(key, F.lit(1).alias("more"))
    return raw.join(more, key, "left").select(key, (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("share"))
