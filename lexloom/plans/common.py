"""Given tables with repeated deliveries merged, for queries and for the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.sources.tables import once, table


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "chunks").select("id", *[c for c in columns if c != "id"]), "id")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "parsed_document").select("doc_id", *[c for c in columns if c != "doc_id"]), "doc_id")


def evidence(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return once(table(spark, folder, "evidence").select("evidence_id", *[c for c in columns if c != "evidence_id"]), "evidence_id")


def span() -> tuple[F.Column, F.Column]:
    """Start and end of a chunk's span."""
    return F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))


#: The same in SQL: c, p and e are chunks, parsed documents and evidence, each row once.
SQL_C = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
SQL_P = "p AS (SELECT * FROM parsed_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at) = 1)"
SQL_E = "e AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at) = 1)"
CJK, BLANK = tx.CJK, tx.BLANK


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def sql_tokens(text: str) -> str:
    """Search tokens of a text in SQL."""
    for char, form in tx.LONGER.items():
        text = f"replace({text}, '{char}', '{form}')"
    raw = f"regexp_extract_all(regexp_replace(lower(translate({text}, '{_quoted(tx.WIDE)}', '{_quoted(tx.NARROW)}')), '([{CJK}]+)', ' \\1 ', 'g'), '{tx.TOKEN}')"
    pairs = "list_transform(range(1, greatest(length(t) - 1, 1) + 1), lambda i: substring(t, i, 2))"
    return f"flatten(list_transform(list_filter({raw}, lambda t: NOT regexp_matches(t, '^_+$')), lambda t: CASE WHEN regexp_matches(t, '^[{CJK}]') THEN {pairs} ELSE [t] END))"


def sql_estimate(text: str) -> str:
    """Estimated tokens of a text in SQL."""
    return f"CAST(floor(0.6::DOUBLE * len(regexp_extract_all({text}, '[{CJK}]')) + len(regexp_extract_all(regexp_replace({text}, '[{CJK}]', ' ', 'g'), '[^{BLANK}]+'))) AS BIGINT)"


def sql_label(text: str) -> str:
    """The label that a lower-cased text names, in SQL."""
    cases = [f"WHEN regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){label}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{label}'" for label in tx.LABELS]
    cases += [f"WHEN regexp_matches({text}, '(^|[^a-z])({words})([^a-z]|$)') THEN '{label}'" for label, words in tx.LABELS.items()]
    return f"CASE {' '.join(cases)} END"


def sql_fixed(most: int, least: int) -> str:
    """``fixed``: spans of at most ``most`` characters of ``p``, for a recursive query; the first row of each document (``n = -1``) is none."""
    return f"""fixed(doc_id, n, s, e) AS (SELECT doc_id, -1, 0, 0 FROM p WHERE full_text <> '' UNION ALL
SELECT doc_id, n + 1, e, e + CASE WHEN len - e <= {most} THEN len - e WHEN line > {least + 1} THEN line - 1 WHEN mark > {least + 1} THEN mark ELSE {most} END
FROM (SELECT *, {most} - length(regexp_extract(w, '[^\\n]*$')) AS line, {most} - length(regexp_extract(w, '[^.!?。！？]*$')) AS mark FROM (SELECT f.*, length(full_text) AS len, substring(full_text, e + 1, {most}) AS w FROM fixed f JOIN p USING (doc_id) WHERE e < length(full_text))))"""
