"""Cutting oversized texts into pieces at natural boundaries, by dynamic programming.

Sizes are ``int(0.6 * c + w)``: c characters of the CJK blocks, w whitespace-separated words after those
characters are replaced by blanks. A natural boundary lies after sentence punctuation, after a line break, and
after a full stop that whitespace follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 50
#: Marks that end a sentence wherever they stand (fixed values).
TERMINATORS = "。！？!?；;"
#: Costs of a cut: after a blank line, at a line break, at a sentence end, elsewhere within an oversized stretch.
PARAGRAPH, LINE, SENTENCE, WORD = 0.0, 0.02, 0.05, 1.0
#: Cost of an overlap that had to shrink.
SHORT_OVERLAP = 0.5


BLANK, CJK, MARK, BREAK, STOP = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits of every code point."""
    bits = np.zeros(0x110000, np.uint8)
    bits[[c for c in range(0x3001) if chr(c).isspace()]] = BLANK
    bits[0x4E00:0xA000] = bits[0x3400:0x4DC0] = CJK
    bits[[ord(c) for c in TERMINATORS]] |= MARK
    bits[[0x0A, 0x0D]] |= BREAK
    bits[0x2E] |= STOP
    return bits


class Measured:
    """A text with running counts, so that the size of any stretch takes constant time."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = _classes()[self.points]
        self.word = (self.bits & (BLANK | CJK)) == 0
        head = self.word.copy()
        head[1:] &= ~self.word[:-1]
        self.cjk_before, self.heads_before = np.zeros((2, len(self.points) + 1), np.int32)
        np.cumsum(self.bits & CJK == CJK, out=self.cjk_before[1:])
        np.cumsum(head, out=self.heads_before[1:])
        # 1 where a stretch that begins here begins inside a word, which then counts too
        self.inside = np.r_[self.word & ~head, False].astype(np.int32)

    def size(self, lo, hi):
        words = self.heads_before[hi] - self.heads_before[lo] + np.where(np.asarray(hi) > lo, self.inside[lo], 0)
        return (0.6 * (self.cjk_before[hi] - self.cjk_before[lo]) + words).astype(np.int64)

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural cut positions inside the text, and the cost of each."""
        ends = (self.bits & (MARK | BREAK)) != 0
        stops = np.flatnonzero(self.bits[:-1] & STOP)
        ends[stops] = (self.bits[stops + 1] & BLANK) != 0
        at = np.flatnonzero(ends[:-1]) + 1
        broken = (self.bits & BREAK) != 0
        # What stands before the line break, a carriage return being part of it.
        before = at - 2 - ((self.points[at - 1] == 0x0A) & (at > 1) & (self.points[at - 2] == 0x0D))
        blank = broken[at - 1] & (before >= 0) & broken[before]
        return at, np.where(blank, PARAGRAPH, np.where(broken[at - 1], LINE, SENTENCE))


def _inside_stretch(m: Measured, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions within a stretch that has no natural boundary: beside blanks and CJK characters.

    A word counts 1 however long it is, so no cut inside a word is ever needed.
    """
    inner = np.arange(lo + 1, hi)
    positions = inner[~(m.word[inner - 1] & m.word[inner])]
    return positions, np.full(len(positions), WORD)


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int], bool]:
    """Starts and ends of the pieces, and whether a stretch between natural boundaries exceeds the limit alone.

    The dynamic program runs over cut positions. It minimises the penalties of the cuts plus the squared
    deviation of every piece from the even size, relative to the limit; no piece exceeds the limit.
    A piece begins before the previous cut, at the first natural boundary that keeps the overlap within ``overlap``;
    if natural boundaries give less than half of that, at the word or character that gives all of it.
    Only where the full overlap leaves no room for the next stretch may it shrink, at a cost.
    """
    m = Measured(text)
    n = len(m.points)
    total = int(m.size(0, n))
    if total <= limit:
        return [0], [n], False
    inner, costs = m.boundaries()
    cuts = inner
    bounds = np.r_[0, cuts, n]
    wide = np.flatnonzero(m.size(bounds[:-1], bounds[1:]) > limit)
    forced = bool(len(wide))
    if forced:
        extra = [_inside_stretch(m, int(bounds[i]), int(bounds[i + 1])) for i in wide]
        cuts, costs = np.r_[cuts, np.concatenate([e[0] for e in extra])], np.r_[costs, np.concatenate([e[1] for e in extra])]
        order = np.argsort(cuts, kind="stable")
        cuts, costs = cuts[order], costs[order]
    at = np.r_[0, cuts, n].astype(np.int64)
    cost = np.r_[0.0, costs, 0.0]
    count = len(at)
    starts = np.zeros(count, np.int64)
    if overlap > 0:
        # Sizes of all stretches that end at a cut can be searched, as running counts only grow.
        ruler = 0.6 * m.cjk_before + m.heads_before
        natural = np.r_[0, inner].astype(np.int64)
        first = np.minimum(np.searchsorted(ruler[natural], ruler[at] - overlap), len(natural) - 1)
        starts = np.minimum(natural[first], at)
        over = (m.size(starts, at) > overlap) & (first + 1 < len(natural))
        starts[over] = np.minimum(natural[first[over] + 1], at[over])
        exact = np.minimum(np.searchsorted(ruler, ruler[at] - overlap + 1), at)
        poor = (m.size(starts, at) * 2 < overlap) | (m.size(starts, at) > overlap)
        starts[poor] = exact[poor]
        starts[0] = 0
    else:
        starts = at.copy()
    aim = total / -(-total // limit)
    best = np.full(count, np.inf)
    best[0] = 0.0
    origin = np.zeros(count, np.int64)
    began = np.zeros(count, np.int64)
    lo = 0
    cjk, heads, inside = m.cjk_before, m.heads_before, m.inside
    cjk_at, heads_at = cjk[at], heads[at]
    cjk_start, heads_start = cjk[starts], heads[starts] - inside[starts]
    cjk_bare, heads_bare = cjk_at, heads_at - inside[at]
    for j in range(1, count):
        while lo < j - 1 and int(0.6 * (cjk_at[j] - cjk_bare[lo]) + (heads_at[j] - heads_bare[lo])) > limit:
            lo += 1
        full = (0.6 * (cjk_at[j] - cjk_start[lo:j]) + (heads_at[j] - heads_start[lo:j])).astype(np.int64)
        price = best[lo:j] + ((full - aim) / limit) ** 2
        price[full > limit] = np.inf
        i = int(np.argmin(price))
        value, start = price[i], starts[lo + i]
        if not np.isfinite(value):  # no room for the full overlap
            bare = (0.6 * (cjk_at[j] - cjk_bare[lo:j]) + (heads_at[j] - heads_bare[lo:j])).astype(np.int64)
            price = best[lo:j] + ((bare - aim) / limit) ** 2 + SHORT_OVERLAP
            price[bare > limit] = np.inf
            i = int(np.argmin(price))
            value = price[i]
            start = _least_start(m, int(starts[lo + i]), int(at[lo + i]), int(at[j]), limit)
        best[j], origin[j], began[j] = value + cost[j], lo + i, start
    chain, j = [], count - 1
    while j > 0:
        chain.append(j)
        j = int(origin[j])
    chain.reverse()
    return [int(began[j]) for j in chain], [int(at[j]) for j in chain], forced


def _least_start(m: Measured, earliest: int, latest: int, end: int, limit: int) -> int:
    """The earliest start from which the piece up to ``end`` still fits."""
    positions = np.arange(earliest, latest + 1)
    fits = m.size(positions, np.full(len(positions), end)) <= limit
    return int(positions[np.argmax(fits)]) if fits.any() else latest


def split_oversized(df: DataFrame, kind: str, id_col: str, text_col: str, offset: Column | None = None, *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every text whose size exceeds ``limit``; texts within it have no row.

    Gives ``(kind, id, piece, start, end, span_start, span_end, size, cut, text)``: half-open code-point offsets
    into the text, the same moved by ``offset`` (null where the offset is null), the piece's size and text (unless ``with_text`` is false), and ``cut``:
    ``forced`` if some stretch between neighbouring natural boundaries exceeds the limit alone, else ``natural``.
    Every size is at most ``limit``; the pieces cover the text in order and overlap as :func:`split_points` says.

    Rows with a null kind, id or text, and blank texts, give nothing. Texts are split whole, each within one row, in time and memory linear
    in its length. A row that is repeated gives its pieces once. An empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids, texts, offsets = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for k, i, text, moved in zip(kinds, ids, texts, offsets):
                if len(text) * 0.8 + 1 <= limit:  # the densest text has a word and a CJK character by turns
                    continue
                begins, ends, forced = split_points(text, limit, overlap)
                if len(ends) == 1 and not forced:
                    continue
                m = Measured(text)
                sizes = m.size(np.array(begins), np.array(ends)).tolist()
                for n, (lo, hi, size) in enumerate(zip(begins, ends, sizes)):
                    span = (None, None) if moved is None else (moved + lo, moved + hi)
                    out.append((k, i, n, lo, hi, *span, size, "forced" if forced else "natural", text[lo:hi] if with_text else None))
            columns = list(zip(*out)) if out else [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)

    rows = df.select(F.col(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.lit(None) if offset is None else offset).cast("int").alias("offset"))
    rows = rows.filter("kind is not null and id is not null and text is not null")
    pieces = rows.mapInArrow(run, "kind string, id string, piece int, start int, end int, span_start int, span_end int, size long, cut string, text string")
    return pieces.dropDuplicates(["kind", "id", "piece", "start", "end"])


ARROW = pa.schema([("kind", pa.string()), ("id", pa.string()), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("size", pa.int64()), ("cut", pa.string()), ("text", pa.string())])
