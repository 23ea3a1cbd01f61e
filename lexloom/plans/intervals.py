"""Queries on intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators import intervals
from lexloom.sources.tables import once, table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "evidence").select("evidence_id", "document_id", "start_offset", "end_offset")
    found = intervals.periods_and_gaps(spans, "document_id", "start_offset", "end_offset")
    return found.selectExpr("entity as document_id", "kind", "cast(start as int) as start_offset", "cast(end as int) as end_offset")


QUERIES = {"p3_found": p3_found}

ORACLE = {
    "p3_found": """
WITH spans AS (
  SELECT DISTINCT document_id, start_offset AS s, end_offset AS e FROM evidence
  WHERE document_id IS NOT NULL AND start_offset < end_offset
), marked AS (
  SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans
), grouped AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked
), periods AS (
  SELECT document_id, n, min(s) AS s, max(e) AS e FROM grouped GROUP BY document_id, n
)
SELECT document_id, 'period' AS kind, s AS start_offset, e AS end_offset FROM periods
UNION ALL
SELECT a.document_id, 'gap' AS kind, a.e AS start_offset, b.s AS end_offset FROM periods a JOIN periods b ON a.document_id = b.document_id AND b.n = a.n + 1
""",
}
