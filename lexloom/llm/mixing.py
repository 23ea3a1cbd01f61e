"""Mixing sources to target weights: exact quotas, drawn in blocks and dealt to output shards by a splitting tree.

Every source's records are hashed into blocks of about equal size. A source gives whole passes over its blocks
plus part of one more, so that its share is met to within one record. The drawn blocks are dealt to the shards
by a tree that splits the vector of block counts in two, again and again, with multivariate
hypergeometric draws; each shard finds its own branch alone, so the tree is never built anywhere. Within a shard the records are shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators.intervals import running_totals
from lexloom.session import written

BLOCK_TOKENS, SHARD_TOKENS = 50_000, 2_000_000
#: Blocks are larger where there would be more than so many in all, which is what the draws can handle.
MOST_BLOCKS = 500_000_000
#: A random order of numbered things: so many random bits before the number, and rows of a source that are ranked together.
ORDER_BITS, NUMBER_BITS, RANKED = 23, 38, 65_536


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text_col: str, vocabulary: str, pattern: str, out: str = "tokens") -> DataFrame:
    """``df`` without its text but with ``out``: the number of tokens of the whole text, 0 for null.

    ``vocabulary`` is the path of a tiktoken rank file on the driver, which Spark sends to the executors. Strings of special tokens are ordinary text.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name
    kept = [c for c in df.columns if c not in (text_col, out)]
    source = df.select(*kept, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{n}` {t}" for n, t in df.select(*kept).dtypes] + [f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64())], names=[*kept, out])

    return source.mapInArrow(run, schema)


def _random_place(number: Column, *salt: Column) -> Column:
    """A whole number that is unique to ``number`` and orders by chance."""
    return F.shiftright(F.xxhash64(number, *salt), 64 - ORDER_BITS).bitwiseAND((1 << ORDER_BITS) - 1) * F.lit(1 << NUMBER_BITS) + number


def _place_width(rows: int) -> int:
    """Width of the ranges of places in which about ``RANKED`` of ``rows`` rows lie."""
    return max(1, (1 << ORDER_BITS + NUMBER_BITS) // max(1, rows // RANKED))


def shard_quotas(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first, number)``: how many blocks of every source fall to a shard, and how many fall to the shards before it.

    Walks from the root of the splitting tree to the shard's leaf. A node that covers some shards splits its
    blocks in proportion to the shards on either side; which sources the left ones come from is a multivariate hypergeometric draw
    seeded by the node, so all shards below agree on it. The numbers of all shards add up to ``counts`` exactly.
    """
    low, high = 0, shards
    first, number = np.zeros(len(counts), np.int64), counts.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        take = int(number.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(number, take, method="marginals")
        if shard < middle:
            number, high = left, middle
        else:
            first, number, low = first + left, number - left, middle
    return first, number


def _draws(sized: DataFrame, targets: DataFrame, total: int | None) -> tuple[list[dict], int]:
    """Per listed source its target share, what is there, and its quota; and the sum of all quotas."""
    available = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records")).join(targets.select("source").distinct(), "source").collect()}
    rows = []
    wanted = targets.filter("source is not null").groupBy("source").agg(F.sum(F.coalesce(F.col("weight"), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    for row in wanted.orderBy("source").collect():
        have = available.get(row["source"])
        rows.append({"source": row["source"], "weight": max(row["weight"], 0.0), "max_repeats": max(row["max_repeats"], 0), "available": have["tokens"] if have else 0, "records": have["records"] if have else 0})
    weight_sum = sum(r["weight"] for r in rows)
    usable = [r for r in rows if r["weight"] > 0 and r["available"] * r["max_repeats"] > 0]
    reachable = sum(r["weight"] for r in usable)
    largest = min((r["available"] * r["max_repeats"] * reachable / r["weight"] for r in usable), default=0)
    size = int(largest if total is None else total)
    for r in rows:
        r["target_share"] = r["weight"] / weight_sum if weight_sum else 0.0
        r["reachable_share"] = r["weight"] / reachable if r in usable else 0.0
        r["quota"] = min(int(r["reachable_share"] * size), r["available"] * r["max_repeats"])
    return rows, sum(r["quota"] for r in rows)


def mixture(records: DataFrame, targets: DataFrame, *, total: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixed records and the shares reached.

    ``records`` has ``id``, ``source`` and ``tokens``, ``targets`` has ``source``, ``weight`` (relative) and ``max_repeats``. Without
    ``total`` the mixture is as large as the shares allow: the first source that is used up as often as it may ends it.
    With a larger ``total`` such sources fall short, which the report shows.

    The first result is ``(shard, position, id, source, copy, tokens)``: no record has more than ``max_repeats`` copies. The second has, for every listed
    source, the share wanted, the share reachable given that absent sources give nothing, quota, tokens,
    records and uses drawn, and the actual share; sources that are not listed come last with a target of 0.

    Records with a null id or source, or without tokens, are left out; repeated ids count once. A null weight is 0, a null ``max_repeats`` 1; a source
    with a weight of 0 or repeats below 1 gives nothing. Without any usable source both results are
    empty but for the report's rows. Only one row per listed source, never one per record, reaches the driver.
    """
    spark = records.sparkSession
    sized = records.select(F.col("id"), F.col("source"), F.col("tokens").cast("long").alias("tokens")).filter("id is not null and source is not null and tokens > 0").dropDuplicates(["id"])
    sized = written(sized)
    plan, drawn = _draws(sized, targets, total)
    block_tokens = max(block_tokens, -(-max(drawn, sum(r["available"] for r in plan)) // MOST_BLOCKS))
    most = max((-(-r["available"] // block_tokens) for r in plan), default=1)
    repeats = max((r["quota"] // r["available"] + 1 for r in plan if r["available"]), default=1)
    names = [r["source"] for r in plan]
    facts = spark.createDataFrame(
        [(r["source"], k, max(1, -(-r["available"] // block_tokens)), r["quota"] // r["available"] if r["available"] else 0, r["quota"] % r["available"] if r["available"] else 0) for k, r in enumerate(plan)] or [("", 0, 1, 0, 0)],
        "source string, number int, blocks long, passes long, rest long",
    )
    blocked = sized.join(F.broadcast(facts), "source").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")))

    # Drawn blocks: whole passes, and in the last one the first blocks of a random order up to the rest of the quota.
    blocks = blocked.groupBy("source", "number", "passes", "rest", "block").agg(F.sum("tokens").alias("tokens"))
    whole = blocks.filter("passes > 0").select("source", "number", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"), F.lit(None).cast("long").alias("upto"))
    # Ranked range by range of a random place, so that a source with very many blocks is no single window.
    last = running_totals(blocks.withColumn("place", _random_place(F.col("block"), F.lit(seed), F.lit("rest"))), "source", "place", "tokens", _place_width(most)).drop("place", "total").filter("before < rest")
    last = last.select("source", "number", "block", F.col("passes").alias("copy"), F.when(F.col("before") + F.col("tokens") > F.col("rest"), F.col("rest") - F.col("before")).alias("upto"))
    taken = written(whole.unionByName(last))
    counts = {r[0]: r[1] for r in taken.groupBy("number").count().collect()}
    vector = np.array([counts.get(k, 0) for k in range(len(names))], np.int64)
    shards = max(1, -(-drawn // shard_tokens))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first, number = shard_quotas(vector, shards, shard, seed)
                source = np.repeat(np.arange(len(vector)), number)
                rank = np.arange(len(source)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(source.astype(np.int32)), pa.array(rank)], names=["shard", "number", "rank"])

    dealt = spark.range(shards).mapInArrow(deal, "shard long, number int, rank long")
    use = F.col("block") * repeats + F.col("copy")
    permuted = running_totals(taken.withColumn("place", _random_place(use, F.lit(seed))).withColumn("one", F.lit(1)), "number", "place", "one", _place_width(most * repeats))
    placed = permuted.withColumn("rank", F.col("before").cast("long")).join(dealt, ["number", "rank"]).select("source", "block", "copy", "upto", "shard")

    within = W.partitionBy("source", "block").orderBy(F.xxhash64("id", F.lit(seed), F.lit("in")), "id").rowsBetween(W.unboundedPreceding, -1)
    rows = blocked.select("id", "source", "block", "tokens", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("before"))
    rows = rows.join(placed, ["source", "block"]).filter("upto is null or before < upto")
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64("id", "copy", "shard", F.lit(seed)), "id", "copy")
    mixed = rows.select("shard", F.row_number().over(shuffled).alias("position"), "id", "source", F.col("copy").cast("int").alias("copy"), "tokens")

    wanted = spark.createDataFrame([(r["source"], r["target_share"], r["reachable_share"], r["max_repeats"], r["available"], r["quota"]) for r in plan], "source string, target_share double, reachable_share double, max_repeats int, available long, quota long")
    used = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("copy") + 1).cast("int").alias("most_uses"))
    everything = sized.groupBy("source").agg(F.sum("tokens").alias("there"))
    share = F.coalesce(F.col("tokens") / F.sum("tokens").over(W.partitionBy()), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = wanted.join(everything, "source", "full_outer").join(used, "source", "left")
    report = report.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("reachable_share", F.lit(0.0)).alias("reachable_share"), share.alias("actual_share"), F.coalesce("there", F.lit(0)).alias("available"), zero("quota"), zero("tokens"), zero("records"), zero("most_uses"), zero("max_repeats"))
    return mixed, report
