"""Benchmarks as they are published: JSON lines of premises with hypotheses, and JSON files of queries with gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.slices import slices

#: Formats of the files (fixed values).
NLI = "premise string, subset string, `hypothesises/labels` array<struct<hypothesis: string, label: string>>"
SPANS = "tests array<struct<query: string, snippets: array<struct<file_path: string, span: array<int>, answer: string>>>>"


def _lines(spark: SparkSession, path: str, subsets: list[str] | None) -> DataFrame:
    rows = spark.read.schema(NLI).json(path).select(F.coalesce("premise", F.lit("")).alias("premise"), F.coalesce("subset", F.lit("")).alias("subset"), F.col("hypothesises/labels").alias("pairs"))
    rows = rows.filter(F.col("subset").isin(list(subsets))) if subsets else rows
    # Files are read in parts, so lines have no number; the text of the premise identifies it.
    return rows.withColumn("premise_id", F.left(F.md5(F.concat_ws("\u001f", "subset", "premise").cast("binary")), F.lit(16)))


def nli_instances(spark: SparkSession, path: str, subsets: list[str] | None = None) -> DataFrame:
    """``(instance_id, premise_id, premise, hypothesis, label, subset, n)``: one row per hypothesis of a line, ``n`` its place in the line."""
    rows = _lines(spark, path, subsets).select("premise_id", "premise", "subset", F.posexplode("pairs").alias("n", "pair"))
    text = lambda c: F.coalesce(F.col(f"pair.{c}"), F.lit("")).alias(c)
    return rows.select(F.concat_ws("-", F.lit("nli"), "subset", "premise_id", "n").alias("instance_id"), "premise_id", "premise", text("hypothesis"), text("label"), "subset", "n")


def nli_premises(spark: SparkSession, path: str, subsets: list[str] | None = None) -> DataFrame:
    """``(premise_id, subset, premise, premise_len, n_hypotheses)``: premises once each, as documents to take in; lines without a premise are left out."""
    rows = _lines(spark, path, subsets).filter("premise != ''").groupBy("premise_id").agg(F.first("subset").alias("subset"), F.first("premise").alias("premise"), F.sum(F.coalesce(F.size("pairs"), F.lit(0))).alias("n_hypotheses"))
    return rows.select("premise_id", "subset", "premise", F.length("premise").alias("premise_len"), "n_hypotheses")


def span_queries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(benchmark, instance_id, query, file_path, start, end, answer)``: a row per gold span; snippets without a file or a pair of offsets are left out.

    Each file is one benchmark, named by its stem; with ``lines`` it may have several objects, one a line, and is read in parts.
    """
    files = spark.read.schema(SPANS).option("multiLine", str(not lines).lower()).json(path).select("tests", F.regexp_extract("_metadata.file_path", "([^/]*)\\.json$", 1).alias("benchmark"))
    tests = files.select("benchmark", F.posexplode("tests").alias("n", "test"))
    rows = tests.select("benchmark", F.concat_ws("-", "benchmark", "n").alias("instance_id"), F.coalesce("test.query", F.lit("")).alias("query"), F.explode("test.snippets").alias("s"))
    return rows.filter((F.coalesce("s.file_path", F.lit("")) != "") & (F.size("s.span") == 2)).select("benchmark", "instance_id", "query", "s.file_path", F.col("s.span")[0].alias("start"), F.col("s.span")[1].alias("end"), "s.answer")


def gold_alignment(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """``gold`` (``key, file_path, start, end, answer``) plus ``aligned``: whether the span's text in ``texts`` (``file_path, text``) is the answer.

    It is if there is no answer, if both are equal, if the text holds the answer with its line breaks as blanks, or the answer holds the text. A span outside of its text is cut to it, and an unknown text is empty.
    """
    spans = gold.select(F.lit("gold").alias("kind"), F.col("key").alias("id"), F.col("file_path").alias("doc"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit(None).cast("string").alias("text"))
    cut = slices(spans, texts.select(F.col("file_path").alias("doc"), "text")).select(F.col("id").alias("key"), "slice")
    rows = gold.join(cut, "key", "left").withColumn("slice", F.coalesce("slice", F.lit("")))
    answer, cut_text = F.col("answer"), F.col("slice")
    return rows.withColumn("aligned", answer.isNull() | (answer == cut_text) | cut_text.contains(F.replace(answer, F.lit("\n"), F.lit(" "))) | answer.contains(cut_text)).drop("slice")
