"""Held-out passages inside a training corpus, found through an FM-index per shard of the corpus.

Every task packs its rows into shards of bounded size. A shard's token sequence is suffix-sorted,
its Burrows-Wheeler transform is stored as a wavelet matrix, and all phrases of the held-out
passages are searched backward at once. Occurrences are located by walking to sampled suffix positions, and overlapping ones merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.tokens import sequence_hash, token_stream

#: Tokens of a shard; a longer text makes a shard by itself.
SHARD_TOKENS = 1_000_000
#: Every so many text positions one suffix position is kept.
SAMPLE = 16
#: Passages are searched in blocks of so many rows: the driver holds one at a time, and a task meets them one after the other.
ITEM_BLOCK = 20_000
SEPARATOR, OTHER = 0, 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order; every separator (0) counts as a symbol of its own, by position.

    Prefix doubling from the first packed symbols on; positions whose rank is already unique are left alone.
    """
    n = len(symbols)
    order_of = symbols.astype(np.int64)
    ends = np.flatnonzero(symbols == SEPARATOR)
    order_of += len(ends)
    order_of[ends] = np.arange(len(ends))
    bits = max(1, int(order_of.max(initial=1)).bit_length())
    packed = max(1, min(4, 62 // bits))
    key = np.zeros(n, np.int64)
    padded = np.r_[order_of, np.zeros(packed, np.int64)]
    for i in range(packed):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:n]
    # The rank of a group of equal prefixes is the place of its first member.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = packed
    while True:
        alone = new & np.r_[new[1:], True][:n]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        behind = at + depth
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        first = rank[at]
        key = first * np.int64(n + 1) + second
        local = np.argsort(key, kind="stable")
        at, key = at[local], key[local]
        order[open_] = at
        changed = np.r_[True, key[1:] != key[:-1]]
        new[open_] = changed
        rank[at] = np.maximum.accumulate(np.where(changed, open_, 0))
        depth *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence, in as many steps as symbols have bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            before = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(sequence) - int(before[-1]))
            up = bit.astype(bool)
            sequence = np.concatenate([sequence[~up], sequence[up]])
        # Where each symbol's run begins after the last level.
        self.begin = np.zeros(1 << bits, np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(sequence)) + 1] if len(sequence) else np.empty(0, int)
        self.begin[sequence[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``, elementwise."""
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones = self.ones[level][at]
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at - self.begin[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self.ones[level][at]
            bit = self.ones[level][at + 1] - ones
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            symbol = (symbol << 1) | bit
        return symbol


class FMIndex:
    """Index of a token sequence in which every record ends with a separator."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        self.tree = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        counts = np.bincount(symbols, minlength=sigma)
        self.before = np.r_[0, np.cumsum(counts)][:sigma]
        self.n = len(symbols)
        starts = np.r_[True, symbols[:-1] == SEPARATOR][: self.n]
        kept = (order % SAMPLE == 0) | starts[order]
        self.kept_before = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept_before[1:])
        self.positions = order[kept]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(phrase, position)`` of all occurrences of the rows of ``phrases``."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column].astype(np.int64)
            low = self.before[symbol] + self.tree.rank(symbol, low)
            high = self.before[symbol] + self.tree.rank(symbol, high)
            stays = low < high
            alive, low, high = alive[stays], low[stays], high[stays]
            if not len(alive):
                break
        each = high - low
        phrase = np.repeat(alive, each)
        row = np.arange(each.sum()) + np.repeat(low - np.r_[0, np.cumsum(each)[:-1]], each) if len(each) else np.empty(0, np.int64)
        # Step back through the text until a kept position.
        steps = np.zeros(len(row), np.int64)
        found = np.empty(len(row), np.int64)
        waiting = np.arange(len(row))
        while len(waiting):
            at = row[waiting]
            kept = self.kept_before[at + 1] > self.kept_before[at]
            done = waiting[kept]
            found[done] = self.positions[self.kept_before[row[done]]] + steps[done]
            waiting, at = waiting[~kept], at[~kept]
            symbol = self.tree.access(at)
            row[waiting] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[waiting] += 1
        return phrase, found


class Vocabulary:
    """Symbols of the tokens of all passages; other tokens are one and the same symbol."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens)
        self.sigma = len(self.tokens) + 2
        size = 1 << max(12, 4 * len(self.tokens)).bit_length()
        slot = (self.tokens & np.uint64(size - 1)).astype(np.int64)
        self.shared = np.bincount(slot, minlength=size) > 1
        self.slot = np.zeros(size, np.int32)
        self.slot[slot] = np.arange(len(slot))

    def symbols(self, token: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(token), OTHER, np.int32)
        place = (token & np.uint64(len(self.slot) - 1)).astype(np.int64)
        at = self.slot[place]
        check = np.flatnonzero(self.shared[place])
        at[check] = np.minimum(np.searchsorted(self.tokens, token[check]), len(self.tokens) - 1)
        return np.where(self.tokens[at] == token, at + 2, OTHER).astype(np.int32)


class Phrases:
    """All runs of ``length`` symbols of passages of at least that many, and the passages that hold each."""

    def __init__(self, record: np.ndarray, symbol: np.ndarray, length: int):
        n = len(symbol) - length + 1
        windows = np.lib.stride_tricks.sliding_window_view(symbol, length) if n > 0 else np.empty((0, length), np.int32)
        whole = record[: max(n, 0)] == record[length - 1 :] if n > 0 else np.empty(0, bool)
        windows, owner = windows[whole], record[: max(n, 0)][whole]
        self.rows, same = np.unique(windows, axis=0, return_inverse=True)
        order = np.argsort(same.ravel(), kind="stable")
        self.owner, self.first = owner[order], np.r_[0, np.cumsum(np.bincount(same.ravel(), minlength=len(self.rows)))]
        self.length = length

    def owners(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``phrase`` and the passages that hold each."""
        each = self.first[phrase + 1] - self.first[phrase]
        index = np.repeat(np.arange(len(phrase)), each)
        return index, self.owner[np.arange(each.sum()) + np.repeat(self.first[phrase] - np.r_[0, np.cumsum(each)[:-1]], each)] if len(phrase) else index


SPANS = pa.schema([("id", pa.string()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())])


def _block(items: list[str], texts: list[str], vocabulary: Vocabulary, length: int, short: bool) -> tuple[list[str], list[Phrases]]:
    """The phrases of a block of passages: runs of ``length`` tokens and, with ``short``, the whole of every shorter passage."""
    record, token = token_stream(texts)
    symbol = vocabulary.symbols(token)
    found = [Phrases(record, symbol, length)]
    sizes = np.bincount(record, minlength=len(texts))
    for size in np.unique(sizes[(sizes > 0) & (sizes < length)]).tolist() if short else ():
        own = sizes[record] == size
        found.append(Phrases(record[own], symbol[own], size))
    return items, [p for p in found if len(p.rows)]


def _original(text: str, at: np.ndarray, end: bool) -> np.ndarray:
    """Positions in the lower-cased text as positions in the text itself; lower case of some characters is longer."""
    grown = np.cumsum([len(c.lower()) for c in text])
    return np.searchsorted(grown, at, side="left") + 1 if end else np.searchsorted(grown, at, side="right")


def _search(ids: list[str], texts: list[str], vocabulary: Vocabulary, blocks: list) -> Iterator[pa.RecordBatch]:
    """Merged spans of one shard, which is indexed once and searched for the phrases of every block."""
    record, token, begin, end = token_stream(texts, offsets=True)
    for n, text in enumerate(texts):
        if not text.isascii() and len(text.lower()) != len(text):
            own = slice(*np.searchsorted(record, [n, n + 1]))
            begin[own], end[own] = _original(text, begin[own], False), _original(text, end[own], True)
    counts = np.bincount(record, minlength=len(texts))
    symbols = np.zeros(len(token) + len(texts), np.int32)
    symbols[np.arange(len(token)) + record] = vocabulary.symbols(token)
    starts = np.r_[0, np.cumsum(counts + 1)][:-1]
    index = FMIndex(symbols, vocabulary.sigma)
    for block in blocks:
        items, each = block.value
        for phrases in each:
            phrase, at = index.find(phrases.rows)
            place, passage = phrases.owners(phrase)
            at = at[place]
            doc = np.searchsorted(starts, at, side="right") - 1
            order = np.lexsort((at, passage, doc))
            doc, passage, at = doc[order], passage[order], at[order]
            # Overlapping occurrences of one passage in one text are one span.
            new = np.r_[True, (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1]) | (at[1:] > at[:-1] + phrases.length)][: len(at)]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.r_[first[1:] - 1, len(at) - 1]
            lo, hi = at[first] - doc[first], at[last] - doc[last] + phrases.length - 1
            text_ids, item_ids = np.array(ids, object)[doc[first]], np.array(items, object)[passage[first]]
            yield pa.RecordBatch.from_arrays([pa.array(text_ids, pa.string()), pa.array(item_ids, pa.string()), pa.array(begin[lo]), pa.array(end[hi]), pa.array(hi - lo + 1)], schema=SPANS)


def leaked_spans(
    corpus: DataFrame, id_col: str, text_col: str, passages: DataFrame, item_col: str, passage_col: str, *, length: int = 30, short: bool = False, item_block: int | None = None
) -> DataFrame:
    """``(id, item, start, end, tokens)``: every maximal stretch of a text in which all runs of ``length`` tokens come from one passage.

    Offsets are code points of the text. Passages and texts are tokenised alike: punctuation, blanks and
    letter case do not matter. Passages shorter than ``length`` tokens cannot leak, unless ``short`` asks for their occurrences as a whole. The passages, a
    stated query set, are broadcast in blocks of at most about ``item_block`` rows (``ITEM_BLOCK`` by default); the corpus is neither moved nor
    sampled, and each shard of it is indexed once for all blocks. Texts are indexed whole; one that exceeds the shard size is a shard by itself.
    Rows with a null id or text give nothing, on either side; ids come out as strings; copies each have their rows, a repeated row its rows once. Empty tables give no rows; extra columns
    are ignored.
    """
    context = corpus.sparkSession.sparkContext
    queries = passages.select(F.col(item_col).cast("string").alias("item"), F.col(passage_col).alias("text")).filter("item is not null and text is not null").distinct()
    texts = corpus.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(token_stream(batch.column("text").to_pylist())[1]).view(np.int64))], names=["token"])

    tokens = queries.select("text").mapInArrow(words, "token long").distinct().toArrow()["token"].to_numpy()
    vocabulary = Vocabulary(tokens.astype(np.int64).view(np.uint64))
    blocks, sent = max(1, -(-queries.count() // (item_block or ITEM_BLOCK))), []
    for block in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "text").toArrow()
        sent.append(context.broadcast(_block(held["item"].to_pylist(), held["text"].to_pylist(), vocabulary, length, short)))
    shared = context.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                bodies.append(t)
                size += len(t) if not t.isascii() else len(t) // 5
                if size >= SHARD_TOKENS:
                    yield from _search(ids, bodies, shared.value, sent)
                    ids, bodies, size = [], [], 0
        if ids:
            yield from _search(ids, bodies, shared.value, sent)

    return texts.mapInArrow(run, "id string, item string, start long, end long, tokens long").distinct()


def removal_spans(leaks: DataFrame) -> DataFrame:
    """``(id, start, end, items)``: the spans to remove from every text, overlaps between passages merged, with the number of passages in each."""
    order = W.partitionBy("id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end").over(order)
    spans = leaks.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    spans = spans.withColumn("n", F.sum("new").over(W.partitionBy("id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("id", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("item").alias("items")).drop("n")
