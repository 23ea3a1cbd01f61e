"""Summaries of runs: scores, counters, rates and reasons over all records at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.metrics import classification_summary, ratio
from lexloom.operators.sessions import map_sums

#: Counters of a record that are summed.
COUNTERS = ("candidates", "verified", "rejected", "failed", "cited", "cited_existing", "cited_matched", "rounds", "searches", "tokens")


def document_scores(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """``(query, retrieved, gold, shared, precision, recall)`` by distinct documents (``query, document``); a side without any document scores 0."""
    both = retrieved.select("query", "document", F.lit(1).alias("r"), F.lit(0).alias("g")).unionByName(gold.select("query", "document", F.lit(0).alias("r"), F.lit(1).alias("g")))
    each = both.filter("query is not null and document is not null").groupBy("query", "document").agg(F.max("r").alias("r"), F.max("g").alias("g"))
    sums = each.groupBy("query").agg(F.sum("r").alias("retrieved"), F.sum("g").alias("gold"), F.sum(F.col("r") * F.col("g")).alias("shared"))
    return sums.select("*", ratio(F.col("shared"), F.col("retrieved")).alias("precision"), ratio(F.col("shared"), F.col("gold")).alias("recall"))


def run_summary(records: DataFrame) -> DataFrame:
    """One row for all ``records`` of runs: their number, sums of ``COUNTERS`` (a missing one is 0), averages per completed run, rates, scores of labels, and sums of reasons.

    A record has ``completed``, ``valid``, ``gold_label``, ``label``, ``stop_reason`` and ``reasons`` (a map of counts) besides the counters. Records that are not valid count as errors
    and have no part in the scores. Averages are per completed run, or per record if none is completed.
    """
    missing = [c for c in COUNTERS if c not in records.columns]
    records = records.select("*", *[F.lit(0).alias(c) for c in missing])
    valid, completed = F.coalesce("valid", F.lit(False)), F.coalesce("completed", "valid", F.lit(False))
    sums = records.agg(F.count("*").alias("records"), F.count(F.when(~valid, 1)).alias("errors"), F.count(F.when(completed, 1)).alias("completed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    runs = F.when(F.col("completed") > 0, F.col("completed")).otherwise(F.greatest("records", F.lit(1)))
    scores = classification_summary(records.filter(valid), "gold_label", "label")
    reasons = map_sums(records, "reasons").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))), ",").alias("reasons"))
    stops = records.filter("stop_reason != ''").groupBy("stop_reason").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stop_reason", "n"))), ",").alias("stop_reasons"))
    # One row each, so these joins pair single rows.
    rows = sums.join(F.broadcast(scores.drop("n"))).join(F.broadcast(reasons)).join(F.broadcast(stops))
    return rows.select(
        "records", "errors", "accuracy", "f1_weighted", *COUNTERS, ratio(F.col("cited_matched"), F.col("cited")).alias("citation_rate"), F.round(F.col("rounds") / runs, 6).alias("rounds_avg"),
        F.round(F.col("searches") / runs, 6).alias("searches_avg"), "reasons", "stop_reasons",
    )
