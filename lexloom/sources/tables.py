"""The given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder, as it lies there."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows delivered twice count once.

    Repeated deliveries of a key are equal but for ``ingested_at``, so any row of a key will do.
    """
    return df.dropDuplicates([key])


def normal_source(col) -> "F.Column":
    """A source name without case, padding or separator differences; null stays null."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(col)), r"[\s\-./]+", "_"), F.lit(""))
