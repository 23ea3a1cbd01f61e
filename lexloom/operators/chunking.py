"""Chunkers. Each is a fold over the lines or blocks of one document, so documents are the unit of distribution."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions import text as tx

_CJK = re.compile(f"[{tx.CJK}]")
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_SENTENCE = re.compile(f"[^{tx.TERMINATORS}]*[{tx.TERMINATORS}][{tx.BLANK}]*|[^{tx.TERMINATORS}]+$")


def estimate(text: str) -> int:
    """The estimate of :func:`lexloom.functions.text.estimated_tokens`, for one string."""
    bare, characters = _CJK.subn(" ", text)
    return int(0.6 * characters + len(bare.split()))


class Sizes:
    """A text with running counts, so that the estimate of any stretch takes constant time."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cjk = ((points >= 0x3400) & (points <= 0x4DBF)) | ((points >= 0x4E00) & (points <= 0x9FFF))
        word = ~cjk & ~np.isin(points, _BLANKS)
        head = word.copy()
        head[1:] &= ~word[:-1]
        self._cjk, self._heads = np.r_[0, np.cumsum(cjk)].tolist(), np.r_[0, np.cumsum(head)].tolist()
        # A stretch that begins inside a word counts what is left of it, too.
        self._inside = np.r_[word & ~head, False].tolist()

    def __call__(self, lo: int, hi: int) -> int:
        return int(0.6 * (self._cjk[hi] - self._cjk[lo]) + (self._heads[hi] - self._heads[lo] + (hi > lo and self._inside[lo])))


def budget_cuts(sizes: list[int], levels: list[int | None], cap: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """``(first line, last line, heading line or -1)`` of every chunk of sized lines.

    Lines gather until the next one would exceed ``cap``; a longer line stays whole. The next chunk begins with the last lines
    whose sizes add up to at most ``overlap``. A heading (its level is not null) ends the chunk, and nothing overlaps across it.
    """
    held: list[int] = []
    total, heading = 0, -1
    for n, (size, level) in enumerate(zip(sizes, levels)):
        if level is not None:
            if held:
                yield held[0], held[-1], heading
            held, total, heading = [], 0, n
            continue
        if held and total + size > cap:
            yield held[0], held[-1], heading
            carried, keep = 0, len(held)
            while keep and carried + sizes[held[keep - 1]] <= overlap:
                keep -= 1
                carried += sizes[held[keep]]
            held, total = held[keep:], carried
        held.append(n)
        total += size
    if held:
        yield held[0], held[-1], heading


def heading_paths(levels: list[int], titles: list[str]) -> list[list[str]]:
    """The section path below each heading in turn.

    A heading of level n replaces what is at least n deep, counted by depth and not by level: after a
    skipped level, siblings nest.
    """
    path: list[str] = []
    paths = []
    for level, title in zip(levels, titles):
        path = [*path[: max(level - 1, 0)], title]
        paths.append(path)
    return paths


def token_budget_chunks(documents: DataFrame, key: str = "doc_id", text: str = "full_text", *, cap: int = 600, overlap: int = 50, headings: bool = True) -> DataFrame:
    """``(key, n, start_offset, end_offset, section_path)``: chunks of whole lines within a token budget, on the text as it is.

    Sizes and heading levels of the lines are column expressions on the array of lines; only the greedy fold over them is a
    function, so a document stays one row from start to end and nothing is shuffled. Blank lines belong to no chunk of their own. Texts that are null or empty have no chunk.
    """
    level = tx.stripped_raw_heading_level if headings else lambda t: F.lit(None).cast("int")
    # In three steps, as every step works out its columns once for each line.
    split = F.split(F.regexp_replace(F.col(text), "\\n$", ""), "\\n", -1)
    bare = F.transform(split, lambda line: F.struct(line.alias("line"), tx.stripped(line).alias("t")))
    found = F.transform(bare, lambda x: F.struct(F.length(x["line"]).alias("length"), tx.estimated_tokens(x["line"]).alias("size"), level(x["t"]).alias("level"), x["t"].alias("t")))
    facts = F.transform(found, lambda x: F.struct(x["length"].alias("length"), x["size"].alias("size"), (x["t"] == "").alias("blank"), x["level"].alias("level"), F.when(x["level"].isNotNull(), F.left(x["t"], F.lit(120))).alias("title")))
    rows = documents.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, facts.alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, held in zip(batch.column(key).to_pylist(), batch.column("lines").to_pylist()):
                end = -1
                for line in held:
                    line["start"], end = end + 1, end + 1 + line["length"]
                    line["end"] = end
                held = [x for x in held if not x["blank"]]
                heads = [i for i, x in enumerate(held) if x["level"] is not None]
                paths = dict(zip(heads, heading_paths([held[i]["level"] for i in heads], [held[i]["title"] for i in heads])))
                cuts = budget_cuts([x["size"] for x in held], [x["level"] for x in held], cap, overlap)
                out += [(name, n, held[a]["start"], held[b]["end"], paths.get(h, [])) for n, (a, b, h) in enumerate(cuts)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=[key, "n", "start_offset", "end_offset", "section_path"])

    return rows.mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, n int, start_offset long, end_offset long, section_path array<string>")


def character_cuts(text: str, most: int = 600, least: int = 100) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters, ending at a line break, else at a sentence end, if one lies beyond ``least``."""
    spans, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            window = text[start:end]
            cut = window.rfind("\n")
            if cut <= least:
                cut = max(window.rfind(c) for c in ".!?。！？") + 1
                cut = cut if cut > least + 1 else len(window)
            end = start + cut
        spans.append((start, end))
        start = end
    return spans


def _spans(documents: DataFrame, key: str, text: str, cuts: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(name, n, lo, hi) for name, body in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()) for n, (lo, hi) in enumerate(cuts(body))]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64()))], names=[key, "n", "start_offset", "end_offset"])

    rows = documents.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull())
    return rows.mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, n int, start_offset long, end_offset long")


def fixed_chunks(documents: DataFrame, key: str = "doc_id", text: str = "full_text", *, most: int = 600, least: int = 100) -> DataFrame:
    """``(key, n, start_offset, end_offset)``: chunks of at most ``most`` characters; see :func:`character_cuts`."""
    return _spans(documents, key, text, lambda body: character_cuts(body, most, least))


def hard_cuts(size: Sizes, start: int, end: int, cap: int) -> list[tuple[int, int]]:
    """Spans that tile ``[start, end)``, each the longest that fits into ``cap`` tokens, and at least one character."""
    spans = []
    while start < end:
        low, high = start + 1, end
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(start, middle) <= cap else (low, middle - 1)
        spans.append((start, low))
        start = low
    return spans


def sentence_groups(text: str, cap: int) -> list[tuple[int, int]]:
    """Spans of whole sentences within ``cap`` tokens each; they tile the text. A longer sentence is cut by :func:`hard_cuts`."""
    if cap <= 0:
        raise ValueError("the cap must be positive")
    size = Sizes(text)
    spans: list[tuple[int, int]] = []
    start = before = 0
    for match in _SENTENCE.finditer(text):
        end = match.end()
        if size(start, end) > cap:
            if before > start:
                spans.append((start, before))
                start = before
            if size(start, end) > cap:
                spans += hard_cuts(size, start, end, cap)
                start = end
        before = end
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def structural_cuts(text: str, blocks: list[tuple[int, int, int | None]], cap: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """``(start, end, heading block or -1)`` of every chunk of blocks ``(start, end, level)`` of a text; headings are in no chunk.

    Content gathers up to ``cap`` tokens. When it is full, the next chunk repeats its last parts of at most ``overlap`` tokens; a
    chunk always has something new. A block that is too large by itself comes in groups of sentences.
    """
    held: list[tuple[int, int]] = []
    fresh, heading = False, -1
    measure = Sizes(text)
    size = lambda: measure(held[0][0], held[-1][1]) if held else 0

    def flush(repeat: bool) -> list[tuple[int, int, int]]:
        nonlocal held, fresh
        made = [(held[0][0], held[-1][1], heading)] if held and fresh else []
        keep, total = len(held), 0
        while repeat and fresh and keep and total + measure(*held[keep - 1]) <= overlap:
            keep -= 1
            total += measure(*held[keep])
        held, fresh = held[keep:], False
        return made

    for n, (lo, hi, level) in enumerate(blocks):
        if level is not None:
            yield from flush(False)
            held, heading = [], n
            continue
        whole = measure(lo, hi)
        if held and size() + whole > cap:
            yield from flush(True)
        for a, b in [(lo + a, lo + b) for a, b in sentence_groups(text[lo:hi], cap)] if whole > cap else [(lo, hi)]:
            if whole > cap and held and size() + measure(a, b) > cap:
                yield from flush(True)
            held.append((a, b))
            fresh = True
        if whole > cap or size() >= cap:
            yield from flush(True)
    yield from flush(False)


def structural_chunks(blocks: DataFrame, key: str = "doc_id", *, cap: int = 600, overlap: int = 50) -> DataFrame:
    """``(key, n, start_offset, end_offset, section_path)``: chunks of parsed blocks; see :func:`structural_cuts`.

    Offsets lie in the assembled text of the blocks.
    """
    held = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", "start_offset", "end_offset", "level", "text"))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, rows in zip(batch.column(key).to_pylist(), batch.column("blocks").to_pylist()):
                heads = [i for i, x in enumerate(rows) if x["level"] is not None]
                paths = dict(zip(heads, heading_paths([rows[i]["level"] for i in heads], [rows[i]["text"] for i in heads])))
                cuts = structural_cuts("\n".join(x["text"] for x in rows), [(x["start_offset"], x["end_offset"], x["level"]) for x in rows], cap, overlap)
                out += [(name, n, lo, hi, paths.get(h, [])) for n, (lo, hi, h) in enumerate(cuts)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=[key, "n", "start_offset", "end_offset", "section_path"])

    return held.mapInArrow(run, f"{key} {dict(blocks.dtypes)[key]}, n int, start_offset long, end_offset long, section_path array<string>")


def sentence_chunks(documents: DataFrame, key: str = "doc_id", text: str = "full_text", *, cap: int = 600) -> DataFrame:
    """``(key, n, start_offset, end_offset)``: groups of whole sentences within a token cap; they tile the text."""
    return _spans(documents, key, text, lambda body: sentence_groups(body, cap))


def chunk_rows(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """Chunk records of the spans a chunker gave (``key, n, start_offset, end_offset`` and perhaps ``section_path``).

    ``(id, doc_id, chunk_index, text, section_path, chapter, section, page_no, charspan)``: the text is the exact slice; a span with nothing but blanks makes no chunk and its number is
    left out, so indexes may have gaps. Plain text has no pages, so ``page_no`` is 0. Spans of one document meet its text in its own row.
    """
    paths = F.col("section_path") if "section_path" in spans.columns else F.array().cast("array<string>")
    held = spans.select(key, F.struct("n", "start_offset", "end_offset", paths.alias("section_path")).alias("s")).groupBy(key).agg(F.collect_list("s").alias("s"))
    rows = documents.select(key, text).join(held, key).select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.explode("s").alias("s")).select("doc_id", "s.*", F.substring("_text", F.col("s.start_offset") + 1, F.col("s.end_offset") - F.col("s.start_offset")).alias("text"))
    rows = rows.filter(F.regexp_replace("text", f"[{tx.BLANK}]+", "") != "")
    part = lambda n: F.coalesce(F.try_element_at("section_path", F.lit(n)), F.lit(""))
    span = F.array(F.col("start_offset").cast("int"), F.col("end_offset").cast("int"))
    return rows.select(F.concat_ws(":", "doc_id", "n").alias("id"), "doc_id", F.col("n").alias("chunk_index"), "text", "section_path", part(1).alias("chapter"), part(-1).alias("section"), F.lit(0).alias("page_no"), span.alias("charspan"))


@F.pandas_udf(StringType())
def _trimmed(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(body: str | None, most: int) -> str | None:
        if body is None or most <= 0:
            return None if body is None else ""
        size, low, high = Sizes(body), 0, len(body)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(0, middle) <= most else (low, middle - 1)
        return body[:low]

    return pd.Series([one(t, k) for t, k in zip(text, keep)])


def trimmed(text: Column, keep: int) -> Column:
    """The longest beginning of a text within ``keep`` estimated tokens; null stays null."""
    return _trimmed(text, F.lit(keep))
