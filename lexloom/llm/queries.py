"""Registered queries of the training-data operators, and SQL for those SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import confusables, leakage, mixing, near_duplicates, residue, similar_vectors, splitting
from lexloom.sources.tables import normal_source, table

#: Vocabulary and split pattern of the public tokenizer that sizes are counted in.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.similar_pairs(table(spark, folder, "chunks"), k=5, min_sim=0.9)


def p1_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = similar_vectors.most_similar(table(spark, folder, "embeddings"), "vec_id", "embedding", k=5)
    return near.selectExpr("cast(id as bigint) as vec_id", "cast(neighbour as bigint) as neighbour", "round(sim, 6) as sim", "rank")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and parsed documents as one table of ``kind``, ``id`` and ``text``."""
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), "id", "text")
    return chunks.unionByName(table(spark, folder, "parsed_document").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("full_text").alias("text")))


def _pieces(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    """Pieces of chunks and documents; a chunk's spans point into its document where its own span fits its text."""
    chunks, documents = table(spark, folder, "chunks"), table(spark, folder, "parsed_document")
    lo, hi = F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))
    chunks = chunks.select(F.lit("chunk").alias("kind"), "id", "text", F.when(hi - lo == F.length("text"), lo).alias("offset"))
    documents = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("full_text").alias("text"), F.lit(0).alias("offset"))
    return splitting.split_oversized(chunks.unionByName(documents), "kind", "id", "text", F.col("offset"), with_text=with_text)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _pieces(spark, folder, with_text=False)
    return pieces.select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "cut").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, with_text=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(_texts(spark, folder), "kind", "id", "text", width=3, threshold=0.7)
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.kind").alias("item_kind"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_texts(spark, folder), "kind", "id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), "id", F.col("doc_id").alias("doc"), F.get("charspan", F.lit(0)).alias("lo"), F.get("charspan", F.lit(1)).alias("hi"), "text")
    evidence = table(spark, folder, "evidence").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), F.col("document_id").alias("doc"), F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"), F.col("quote").alias("text"))
    documents = table(spark, folder, "parsed_document").select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text"))
    return confusables.lookalike_slices(chunks.unionByName(evidence), documents).toDF("item_kind", "item_id")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "chunks").select("id", "text").unionByName(table(spark, folder, "evidence").select(F.col("evidence_id").alias("id"), F.col("quote").alias("text")))
    return confusables.lookalike_groups(texts, "id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "test_item"), "item_id", "text", length=30)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).selectExpr("cast(id as bigint) as doc_id", "cast(item as bigint) as item_id").distinct()


def p6_removal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.removal_spans(_leaks(spark, folder)).selectExpr("cast(id as bigint) as doc_id", "start", "end", "items")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from public_tokenizers import PATTERN

    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), normal_source(F.col("source")).alias("source"), "text")
    targets = table(spark, folder, "source_target").select(normal_source(F.col("source")).alias("source"), F.col("target_weight").alias("weight"), "max_repeats")
    return mixing.mixture(mixing.with_tokens(documents, "text", VOCABULARY, PATTERN), targets)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text").selectExpr("cast(id as bigint) as doc_id").distinct()


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text").selectExpr("cast(id as bigint) as doc_id", "kind", "round(score, 3) as score", "units")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_embedding_neighbours": p1_embedding_neighbours, "p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_removal_spans": p6_removal_spans, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_reasons": p8_reasons}


USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0"
CJK = "\u3400-\u4dbf\u4e00-\u9fff"
ITEMS = """items AS (SELECT DISTINCT 'chunk' AS kind, id, text FROM chunks WHERE text IS NOT NULL UNION SELECT DISTINCT 'document' AS kind, doc_id AS id, full_text AS text FROM parsed_document WHERE full_text IS NOT NULL)"""


def _sql_tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({text}), '([{CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _sql_size(text: str) -> str:
    blank = "\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return f"CAST(floor(0.6::DOUBLE * len(regexp_extract_all({text}, '[{CJK}]')) + len(regexp_extract_all(regexp_replace({text}, '[{CJK}]', ' ', 'g'), '[^{blank}]+'))) AS BIGINT)"


def _sql_windows(width: int) -> str:
    """``sh``: every item's distinct runs of ``width`` tokens, of a table ``tk`` with ``kind``, ``id`` and ``ts``."""
    return f"sh AS (SELECT DISTINCT kind, id, md5(array_to_string(ts[i:i + {width - 1}], ' ')) AS h FROM (SELECT kind, id, ts, unnest(range(1, len(ts) - {width - 2})) AS i FROM tk WHERE len(ts) >= {width}))"


def _sql_reach(width: int, threshold: str) -> str:
    """``reach``: every item with all items of its group, itself included, by the similarity of their runs of ``width`` tokens."""
    return f"""WITH RECURSIVE {ITEMS}, tk AS (SELECT kind, id, {_sql_tokens('text')} AS ts FROM items), {_sql_windows(width)}, n AS (SELECT kind, id, count(*) AS n FROM sh GROUP BY kind, id),
shared AS (SELECT a.kind, a.id AS x, b.id AS y, count(*) AS s FROM sh a JOIN sh b ON a.kind = b.kind AND a.h = b.h AND a.id < b.id GROUP BY ALL),
links AS (SELECT shared.kind, x, y FROM shared JOIN n a ON a.kind = shared.kind AND a.id = x JOIN n b ON b.kind = shared.kind AND b.id = y WHERE s >= {threshold}::DOUBLE * (a.n + b.n - s)),
both_ AS (SELECT kind, x, y FROM links UNION SELECT kind, y, x FROM links), reach(kind, x, y) AS (SELECT kind, x, y FROM both_ UNION SELECT r.kind, r.x, b.y FROM reach r JOIN both_ b ON r.kind = b.kind AND r.y = b.x)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS v FROM chunks WHERE {USABLE} GROUP BY id), s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.id <> b.id),
n AS (SELECT x, y FROM s WHERE sim >= 0.9 - 1e-12 QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) <= 5) SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM n""",
        "p1_embedding_neighbours": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE {USABLE}), s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.id <> b.id)
SELECT x AS vec_id, y AS neighbour, round(sim, 6) AS sim, row_number() OVER (PARTITION BY x ORDER BY sim DESC, CAST(y AS VARCHAR)) AS rank FROM s QUALIFY rank <= 5""",
        "p2_found": f"""WITH {ITEMS}, big AS (SELECT * FROM items WHERE {_sql_size('text')} > 600),
parts AS (SELECT kind, id, unnest(string_split(regexp_replace(regexp_replace(text, '([.])(\\s)', '\\1' || chr(31) || '\\2', 'g'), '([。！？!?；;\\n\\r])', '\\1' || chr(31), 'g'), chr(31))) AS s FROM big)
SELECT kind AS item_kind, id AS item_id, CASE WHEN max({_sql_size('s')}) > 600 THEN 'forced' ELSE 'natural' END AS cut FROM parts GROUP BY kind, id""",
        "p4_found": f"{_sql_reach(3, '0.7')} SELECT DISTINCT kind AS item_kind, x AS id_a, y AS id_b FROM reach WHERE x < y",
        "p4_groups": f"{_sql_reach(5, '0.8')} SELECT r.kind, x AS id, least(x, min(y)) AS group_id, count(DISTINCT md5(array_to_string(ts, ' '))) AS n_texts FROM reach r JOIN tk ON tk.kind = r.kind AND tk.id = y GROUP BY r.kind, x",
        "p6_found": f"""WITH tk AS (SELECT 'd' AS kind, doc_id AS id, {_sql_tokens('text')} AS ts FROM documents WHERE text IS NOT NULL UNION ALL SELECT 't' AS kind, item_id AS id, {_sql_tokens('text')} AS ts FROM test_item WHERE text IS NOT NULL), {_sql_windows(30)}
SELECT DISTINCT d.id AS doc_id, t.id AS item_id FROM sh d JOIN sh t ON d.kind = 'd' AND t.kind = 't' AND d.h = t.h""",
    }
