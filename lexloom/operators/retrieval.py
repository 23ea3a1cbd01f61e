"""Scoped retrieval over chunks: vector, BM25, fused and reranked search, exact grep, sections and pages.

Searches take a table of queries and answer all of them in one plan. Scopes are ordinary filters, so a
session or document restriction reaches the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.session import written

TOP_K, CANDIDATES, RRF_K = 10, 100, 60
VECTOR_WEIGHT = BM25_WEIGHT = 0.5
K1, B = 1.2, 0.75
#: Query vectors of one block: the block is sent to the tasks, so it is bounded.
QUERY_BLOCK = 4096


def scoped(chunks: DataFrame, session: str, documents: Sequence[str] | None = None) -> DataFrame:
    """Chunks of one session; of no document for an empty list, of all for ``None``.

    A blank session is an error: unassigned documents can't be searched.
    """
    if not (session or "").strip():
        raise ValueError("a session is required")
    rows = chunks.filter(F.col("session_id") == session)
    if documents is None:
        return rows
    return rows.filter(F.col("doc_id").isin(list(documents))) if documents else rows.filter(F.lit(False))


def effective_documents(requested: Sequence[str] | None, allowed: Sequence[str] | None) -> list[str] | None:
    """The documents a search may see: those requested, all of which must be allowed, or everything that is allowed."""
    if allowed is None:
        return list(requested) if requested else None
    outside = set(requested or ()) - set(allowed)
    if outside:
        raise ValueError(f"documents outside the scope: {sorted(outside)}")
    return list(requested) if requested else list(allowed)


# BM25 ---------------------------------------------------------------------------------------------


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(token, id, tf, length)``: how often each token occurs in each text, beside the text's number of tokens."""
    tokens = chunks.select(F.col(id_col).alias("id"), tx.search_tokens(F.col(text_col)).alias("tokens")).withColumn("length", F.size("tokens"))
    return tokens.select("id", "length", F.explode("tokens").alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def tokenised(chunks: DataFrame, *columns: str | Column) -> DataFrame:
    """``(id, chunk_index, tokens, length)`` and other columns of all chunks, written, so that texts are tokenised once for any number of searches."""
    rows = chunks.select("id", "chunk_index", *columns, tx.search_tokens(F.col("text")).alias("tokens"))
    return written(rows.withColumn("length", F.size("tokens")))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, scope: Column | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best chunks for every query, by BM25 over all its tokens.

    ``queries`` has ``query_id`` and ``query``; ``chunks`` are given with texts or :func:`tokenised`. Statistics cover all chunks; ``scope``, a condition on
    chunks, filters afterwards. A query without tokens, and a chunk that shares none, has no row. Ties go to the lower chunk index, then id.

    The stated queries go out in blocks of ``QUERY_BLOCK`` with the weights of their tokens. Every task scores its chunks against a block and keeps its own best ``k``, so
    only ``k`` rows per query and task are shuffled, and a token that occurs in most chunks and queries costs no more than a look at each of them.
    """
    context = chunks.sparkSession.sparkContext
    indexed = chunks if "tokens" in chunks.columns else tokenised(chunks, *([scope.alias("inside")] if scope is not None else []))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.array_distinct(tx.search_tokens(F.col("query"))).alias("tokens"))
    asked = written(asked.filter(F.size("tokens") > 0))
    words = asked.select(F.explode("tokens").alias("token")).distinct()
    frequency = indexed.select(F.explode(F.array_distinct("tokens")).alias("token")).join(words, "token").groupBy("token").agg(F.count("*").alias("df")).toArrow()
    count, mean = indexed.agg(F.count("*"), F.avg("length")).first()
    df = frequency["df"].to_numpy()
    known, weight = frequency["token"].combine_chunks(), np.log(1 + (count - df + 0.5) / (df + 0.5))
    blocks, sent = max(1, -(-asked.count() // QUERY_BLOCK)), []
    for block in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        tokens = held["tokens"].combine_chunks()
        token = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy()
        query = np.repeat(np.arange(held.num_rows), np.diff(tokens.offsets.to_numpy()))
        query, token = query[token >= 0], token[token >= 0]
        order = np.argsort(token, kind="stable")
        sent.append(context.broadcast((held["query_id"].combine_chunks(), query[order], np.searchsorted(token[order], np.arange(len(known) + 1)))))
    shared = context.broadcast((known, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch in batches:
            tokens, n = batch.column("tokens"), batch.num_rows
            offsets = tokens.offsets.to_numpy()
            token = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy()
            chunk = np.repeat(np.arange(n), np.diff(offsets))[token >= 0]
            pair, tf = np.unique(chunk * np.int64(len(known) + 1) + token[token >= 0], return_counts=True)
            chunk, token = pair // (len(known) + 1), pair % (len(known) + 1)
            length = batch.column("length").to_numpy()[chunk]
            part = weight[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))
            place, ids = batch.column("chunk_index").to_numpy(zero_copy_only=False), batch.column("id")
            order = np.lexsort((np.array(ids.to_pylist(), object).astype(str), place))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            for block in sent:
                names, query, first = block.value
                # Some queries at a time, so that scores of a batch stay small.
                for low in range(0, len(names), 256):
                    high = min(low + 256, len(names))
                    each = first[token + 1] - first[token]
                    at = np.arange(each.sum()) + np.repeat(first[token] - np.r_[0, np.cumsum(each)[:-1]], each) if len(token) else np.empty(0, np.int64)
                    own = query[at]
                    some = (own >= low) & (own < high)
                    cell = (own[some] - low) * n + np.repeat(chunk, each)[some]
                    sums = np.round(np.bincount(cell, np.repeat(part, each)[some], minlength=(high - low) * n).astype(np.float64).reshape(high - low, n), 6)
                    hit = np.bincount(cell, minlength=(high - low) * n).reshape(high - low, n) > 0
                    sums[~hit] = -np.inf
                    take = min(k, n)
                    floor = -np.partition(-sums, take - 1, axis=1)[:, take - 1]
                    q, c = np.nonzero(hit & (sums >= floor[:, None]))
                    best = np.lexsort((rank[c], -sums[q, c], q))
                    q, c = q[best], c[best]
                    q, c = (x[np.arange(len(q)) - np.searchsorted(q, q) < k] for x in (q, c))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + low)), ids.take(pa.array(c)), batch.column("chunk_index").take(pa.array(c)), pa.array(sums[q, c])], names=["query_id", "id", "chunk_index", "score"])

    inside = indexed.filter("inside") if scope is not None else indexed
    found = inside.select("id", "chunk_index", "tokens", "length").filter(F.size("tokens") > 0).mapInArrow(score, "query_id string, id string, chunk_index int, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


# Vectors ------------------------------------------------------------------------------------------


def vectors(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, dim: int = 64) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` chunks of highest cosine similarity for every query vector, exactly.

    ``queries`` has ``query_id`` and ``vector``. Vectors that are null, of another length, all zero or not finite
    take no part on either side. The stated queries go out in blocks of ``QUERY_BLOCK``; every task reads its chunks once, multiplies them with each block and
    keeps its own best ``k``, so only ``k`` rows per query and task are shuffled. Ties go to the lower chunk index, then id.
    """

    def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        size = np.sqrt((rows * rows).sum(axis=1))
        usable = np.isfinite(size) & (size > 0)
        return usable, rows[usable] / size[usable, None]

    asked = queries.filter(F.size("vector") == dim).select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    rows = chunks.filter(F.size("embedding") == dim).select("id", "chunk_index", F.col("embedding").cast("array<float>").alias("embedding"))
    blocks, sent = max(1, -(-asked.count() // QUERY_BLOCK)), []
    for block in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        usable, wanted = unit(held["vector"]) if held.num_rows else (np.empty(0, bool), np.empty((0, dim)))
        sent.append(chunks.sparkSession.sparkContext.broadcast((wanted, [n for n, u in zip(held["query_id"].to_pylist(), usable) if u])))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, own = unit(batch.column("embedding"))
            kept = pa.array(np.flatnonzero(usable))
            for block in sent:
                wanted, names = block.value
                if not len(own) or not names:
                    continue
                sims = wanted @ own.T
                take = min(k, sims.shape[1])
                # all that tie with the k-th come along; the ranking below settles ties
                floor = -np.partition(-sims, take - 1, axis=1)[:, take - 1]
                q, c = np.nonzero(np.round(sims, 6) >= np.round(floor, 6)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(names, object)[q], pa.string()), batch.column("id").take(kept).take(pa.array(c)), batch.column("chunk_index").take(kept).take(pa.array(c)), pa.array(sims[q, c])],
                    names=["query_id", "id", "chunk_index", "score"],
                )

    found = rows.mapInArrow(near, "query_id string, id string, chunk_index int, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index", "id")
    found = found.withColumn("score", F.round("score", 6)).dropDuplicates(["query_id", "id"])
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def fused(by_vector: DataFrame, by_bm25: DataFrame, k: int = TOP_K) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings; ties go to the better vector rank, then to the better BM25 rank.

    Takes ``(query_id, id, rank)`` twice and gives ``(query_id, id, score, rank, vector_rank, bm25_rank)``.
    """
    v = by_vector.select(F.col("query_id").cast("string").alias("query_id"), "id", F.col("rank").alias("vector_rank"))
    b = by_bm25.select(F.col("query_id").cast("string").alias("query_id"), "id", F.col("rank").alias("bm25_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    both = v.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(part("vector_rank", VECTOR_WEIGHT) + part("bm25_rank", BM25_WEIGHT), 9))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "vector_rank", "bm25_rank")


def shown(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (``query_id, id, rank, score``) as a search shows them: with the facts of their chunks and the head of the text."""
    rows = hits.select("query_id", "rank", "id", "score").join(chunks, "id")
    return rows.select("query_id", "rank", "id", "doc_id", "doc_title", "session_id", "page_no", "section_path", tx.head_snippet(F.col("text")).alias("snippet"), "score")


def candidates(k: int = TOP_K) -> int:
    """How many candidates each search gives to the fusion."""
    return max(4 * k, CANDIDATES)


def reranked(hits: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=None, k: int = TOP_K) -> DataFrame:
    """``(query_id, id, score, rank)``: hits in the order of ``scorer(query text, chunk text)``, ties by their rank before.

    The default scorer is the share of the query's distinct tokens that the chunk has; a cross encoder can be given as a
    pandas UDF.
    """
    # Chunks that come tokenised are not tokenised again for the default scorer.
    known = scorer is None and "tokens" in chunks.columns
    words = (lambda t: t) if known else tx.search_tokens
    scorer = scorer or (lambda q, t: F.size(F.array_intersect(tx.search_tokens(q), words(t))) / F.greatest(F.size(F.array_distinct(tx.search_tokens(q))), F.lit(1)))
    before = hits.select(F.col("query_id").cast("string").alias("query_id"), "id", F.col("rank").alias("before"))
    pairs = before.join(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), "query_id").join(chunks.select("id", F.col("tokens" if known else "text").alias("text")), "id")
    scored = pairs.select("query_id", "id", "before", F.round(scorer(F.col("query"), F.col("text")), 6).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


# Exact search -------------------------------------------------------------------------------------


def grep(chunks: DataFrame, pattern: str, *, mode: str = "literal", case_sensitive: bool = False, k: int | None = None) -> DataFrame:
    """``(id, doc_id, chunk_index, match_count, snippet)`` of the chunks that hold a pattern, by document and chunk index.

    A literal is taken as it is, a regular expression in one dialect for filter, count and snippet. With
    ``k`` at most ``max(k, 1)`` rows come out. An empty pattern is an error.
    """
    if not pattern:
        raise ValueError("a pattern is required")
    if mode not in ("literal", "regex"):
        raise ValueError("mode is literal or regex")
    body = F.col("text")
    if mode == "literal":
        hay, needle = (body, pattern) if case_sensitive else (F.lower(body), pattern.lower())
        hit = hay.contains(needle)
        count = ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
        start, length = F.locate(needle, hay) - 1, F.lit(len(needle))
    else:
        dialect = pattern if case_sensitive else f"(?i){pattern}"
        hit = body.rlike(dialect)
        count = F.regexp_count(body, F.lit(dialect))
        start = F.length(F.regexp_extract(body, f"(?s)^(.*?)(?:{dialect})", 1))
        length = F.length(F.regexp_extract(body, dialect, 0))
    rows = chunks.filter(hit).select("id", "doc_id", "chunk_index", count.alias("match_count"), tx.around_snippet(body, start, length).alias("snippet"))
    return rows if k is None else rows.orderBy("doc_id", "chunk_index", "id").limit(max(k, 1))


# Documents, sections, pages -----------------------------------------------------------------------


def outline(chunks: DataFrame) -> DataFrame:
    """``(doc_id, section_path, start_offset, end_offset, chunks)``: the span of every non-empty section path of every document."""
    rows = chunks.filter(F.size("section_path") > 0)
    lo, hi = F.get("charspan", F.lit(0)), F.get("charspan", F.lit(1))
    return rows.groupBy("doc_id", "section_path").agg(F.min(lo).alias("start_offset"), F.max(hi).alias("end_offset"), F.count("*").alias("chunks"))


def section(chunks: DataFrame, path: Sequence[str]) -> DataFrame:
    """Chunks of exactly one section path, or of everything below it where a document has no such section."""
    path = list(path)
    exact = chunks.filter(F.col("section_path") == F.array(*map(F.lit, path)))
    below = chunks.filter(F.slice("section_path", 1, len(path)) == F.array(*map(F.lit, path)))
    return exact.unionByName(below.join(exact.select("doc_id").distinct(), "doc_id", "left_anti").select(*exact.columns))


def pages_for_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """``spans`` (``key, doc_id, lo, hi``) plus ``page_no``: the page of the earliest chunk that overlaps each, 0 without one.

    Spans and chunks meet in blocks of 4096 characters of a document, so a document with most of the spans is shared among tasks.
    """
    width = 4096
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((F.greatest(hi, lo + 1) - 1) / width)))
    known = chunks.select("doc_id", "id", "chunk_index", "page_no", F.get("charspan", F.lit(0)).alias("c_lo"), F.get("charspan", F.lit(1)).alias("c_hi")).filter("c_lo < c_hi")
    asked = spans.filter("lo < hi").withColumn("block", blocks(F.col("lo"), F.col("hi")))
    known = known.withColumn("block", blocks(F.col("c_lo"), F.col("c_hi")))
    met = asked.join(known, ["doc_id", "block"]).filter("c_hi > lo and c_lo < hi")
    pages = met.groupBy("key").agg(F.min_by("page_no", F.struct("c_lo", "chunk_index", "id")).alias("page_no"))
    return spans.join(pages, "key", "left").withColumn("page_no", F.coalesce("page_no", F.lit(0)))
