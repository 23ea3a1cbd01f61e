"""Template residue and error pages: a positive-unlabelled naive Bayes fitted by expectation-maximization.

Three kinds of units are judged, each by a model of its own: bracketed or marked expressions (is it a value slot
left unfilled?), passages (filler instead of a clause?) and whole documents (nothing but an error
message or script notice?). A few units that hold one of a handful of seed wordings stay positive while the
models are fitted; all others are unlabelled, taken as clean at first, and the models find the other forms and wordings through what these share with the seeds. A document is
excluded if any of its expressions or passages, or the sum of all its evidence on errors, is more likely positive than not; the seeds themselves decide nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.tokens import mix, token_stream
from lexloom.session import written

#: The rounds end when the number of positive units of no kind changes by more than this share, after ``ROUNDS`` at the latest.
ROUNDS, SETTLED = 8, 0.01
FEATURES = 1 << 20
#: Every feature counts as if it had been seen so many times more, in positive and other units as often as all features are; so a rare one says little.
PSEUDO = 5.0
#: Prior log odds are at most this, so that without evidence nothing is excluded, however many units are trusted.
MOST_PRIOR = -2.0
SLOT, FILLER, ERROR = range(3)
NAMES = ("slot", "filler", "error")

#: Expressions that could be value slots, of any length within a line.
CANDIDATE = re.compile(
    r"(?P<curl>\{\{[^{}\n]+\}\})|(?P<dollar>\$\{[^{}\n]+\})|(?P<brace>\{[^{}\n]+\})|(?P<square>\[{1,2}[^\[\]\n]+\]{1,2})"
    r"|(?P<angle2><<[^<>\n]+>>)|(?P<angle><[^<>\n]+>)|(?P<lens>【[^【】\n]+】)|(?P<title>《[^《》\n]+》)"
    r"|(?P<line>[_＿]{2,}[ ]?[（(][^（）()\n]+[）)])|(?P<paren>（[^（）\n]+）)|(?P<at>@@[^@\n]+@@)|(?P<percent>%[^\W\d]\w+%)"
    r"|(?P<cross>××[^×\n]+××)|(?P<hash>#{1,2}[^\W\d]\w+#{1,2})|(?P<blank>[_＿]{3,}|\.{5,}|…{3,})"
)
#: Characters a candidate can begin with; dots are rare enough to be asked for first.
OPENER = re.compile(r"[{$\[<【《_＿（@%×#…]")
#: Seeds (fixed values): forms of slots, how a slot asks for its value, filler, and what error pages say. Those of filler and errors count
#: where they make up ``SEED_SHARE`` of the passage or document, so an agreement that talks about such things is no seed.
SEED_FORMS = {"curl", "dollar"}
SEED_ASKING = re.compile(r"(?i)^\W*(insert\b|请填写|此处填)")
SEED_FILLER = ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "placeholder", "sample text", "sample clause", "your text", "text text", "asdf", "示例文字", "样本文字", "此处填写正文")
SEED_ERROR = (
    "404 not found", "page not found", "access denied", "enable javascript", "requires javascript", "service unavailable", "internal server error", "页面不存在", "访问被拒绝", "请启用 javascript", "系统繁忙",
    "zugriff verweigert", "angeforderte seite", "aktivieren sie javascript", "accès refusé", "page demandée", "activer javascript",
)
SEED_SHARE = {SEED_FILLER: 1 / 4, SEED_ERROR: 1 / 5}


@dataclass
class Units:
    """The units of one kind in a batch of texts: their documents, features, and which are seeds."""

    owner: np.ndarray
    unit: np.ndarray
    feature: np.ndarray
    trusted: np.ndarray

    def score(self, weights: np.ndarray | None, prior: float) -> np.ndarray:
        """Log odds of being positive, without what is known of a unit."""
        if weights is None:
            return np.full(len(self.owner), -np.inf)
        return np.bincount(self.unit, weights[self.feature], minlength=len(self.owner)) + prior


def _candidates(text: str) -> Iterator[re.Match]:
    """The matches of ``CANDIDATE``, tried only where one can begin."""
    if "....." in text:
        yield from CANDIDATE.finditer(text)
        return
    end = 0
    for opener in OPENER.finditer(text):
        if opener.start() >= end and (match := CANDIDATE.match(text, opener.start())):
            end = match.end()
            yield match


def _slots(text: str) -> Iterator[tuple[list[str], bool]]:
    """Marks of every candidate of a text, and whether it is a seed."""
    for match in _candidates(text):
        form, whole = match.lastgroup, match.group()
        inner = whole.strip("{}$[]<>【】《》_＿ （）()@%×#.…")
        lower = inner.lower()
        # Nothing inside names no value (a line to sign on, an ellipsis); quoted keys are data.
        if '"' in inner or not inner:
            continue
        runs = re.findall(r"[^\W\d_]+", lower)
        digits = bool(re.search(r"\d", inner))
        marks = ["form " + form, "digit" if digits else "plain", "quote" if re.search(r"[\"'“”:：]", inner) else "bare", "words " + str(min(len(runs), 5)), "length " + str(min(len(inner) // 8, 6))]
        marks += ["upper"] * (inner.isupper() and inner.isascii()) + ["snake"] * ("_" in inner) + ["empty"] * (not runs)
        marks += ["word " + w for w in runs] + ["whole " + " ".join(runs)]
        # Chinese has no blanks between words: pairs of characters stand in for them.
        marks += ["pair " + w[i : i + 2] for w in runs if not w.isascii() for i in range(len(w) - 1)]
        marks += ["before " + text[max(0, match.start() - 2) : match.start()].lower(), "after " + text[match.end() : match.end() + 2].lower()]
        marks += ["first " + runs[0][:2], "last " + runs[-1][-2:]] if runs else []
        yield marks, (form in SEED_FORMS or bool(SEED_ASKING.search(inner))) and bool(runs) and not digits


def _ends(texts: list[str]) -> np.ndarray:
    """Where passages end in the joined texts: after sentence marks and line breaks, at stops before blanks, and at dashes between blanks."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 0x20) | (points == 0x0A) | (points == 0x09)
    ends = np.isin(points, [ord(c) for c in "。！？!?；;\n"])
    ends[:-1] |= (points[:-1] == 0x2E) & blank[1:]
    ends[1:-1] |= (points[1:-1] == 0x2D) & blank[:-2] & blank[2:]
    return ends


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, kind))


ENCODED = "id string, tokens array<int>, passages array<int>, filler array<boolean>, error boolean, marks array<int>, slots array<int>, named array<boolean>"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers: tokens, the sizes of passages and which are seeds; marks of candidate slots likewise."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        lowered = [t.lower() for t in texts]
        record, token, begin, _ = token_stream(lowered, offsets=True)
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        starts = np.cumsum(lengths) - lengths
        ends = _ends(lowered)
        passage = np.cumsum(ends)[begin + starts[record]] if len(record) else np.empty(0, np.int64)
        first = np.flatnonzero(np.r_[True, np.diff(passage) != 0][: len(passage)])
        sizes = np.diff(np.r_[first, len(passage)])
        owner = record[first]
        # Seeds of filler: only texts that hold one are looked at.
        joined, cut = "\n".join([*lowered, ""]), np.r_[0, np.flatnonzero(ends) + 1]
        seeded = np.zeros(len(first), bool)
        likely = [i for i, t in enumerate(lowered) if any(p in t for p in SEED_FILLER)]
        for n in np.flatnonzero(np.isin(owner, likely)) if likely else ():
            text = joined[cut[passage[first[n]]] : cut[min(passage[first[n]] + 1, len(cut) - 1)]]
            seeded[n] = _seeded(text, SEED_FILLER)
        errors = [_seeded(t, SEED_ERROR) for t in lowered]
        marks, slot_sizes, named, slots = [], [], [], []
        for text in texts:
            before = len(slot_sizes)
            for own, seed in _slots(text):
                marks += [crc32(m.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for m in own]
                slot_sizes.append(len(own))
                named.append(seed)
            slots.append(len(slot_sizes) - before)
        slots, slot_sizes = np.array(slots, np.int64), np.array(slot_sizes, np.int64)
        own_marks = np.bincount(np.repeat(np.arange(len(texts)), slots), slot_sizes, minlength=len(texts)).astype(np.int64)
        count, passages = np.bincount(record, minlength=len(texts)), np.bincount(owner, minlength=len(texts))
        columns = [
            batch.column("id"), _lists((token & np.uint64(FEATURES - 1)).astype(np.int32), count, pa.int32()), _lists(sizes, passages, pa.int32()), _lists(seeded, passages, pa.bool_()), pa.array(errors, pa.bool_()),
            _lists(np.array(marks, np.int32), own_marks, pa.int32()), _lists(slot_sizes, slots, pa.int32()), _lists(np.array(named, bool), slots, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "tokens", "passages", "filler", "error", "marks", "slots", "named"])


def _seeded(lower: str, seeds: tuple[str, ...]) -> bool:
    """Whether seeds make up enough of a lower-cased text."""
    said = sum(len(p) * lower.count(p) for p in seeds if p in lower)
    return said > 0 and said >= SEED_SHARE[seeds] * len(lower.strip())


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)


def _mark(name: str) -> int:
    return crc32(name.encode()) & (FEATURES - 1)


LENGTHS = np.array([_mark(f"log length {i}") for i in range(64)])
#: A passage repeats itself if at least this share of its tokens occurred just before in it.
REPEATS = ((0.25, _mark("repeats a quarter")), (0.5, _mark("repeats half")))


def _units(batch: pa.RecordBatch) -> tuple[Units, Units, Units]:
    """The units of encoded documents: slots, passages for the filler model, documents for the error model.

    Passages and documents share tokens and pairs of tokens; a document also has its length, and a passage its repetitions.
    """
    token, count = _flat(batch.column("tokens"))
    token = token.astype(np.uint64)
    sizes, passages = _flat(batch.column("passages"))
    record = np.repeat(np.arange(batch.num_rows), count)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    owner = np.repeat(np.arange(batch.num_rows), passages)
    pair = np.flatnonzero(record[1:] == record[:-1])
    twin = mix(token[pair] * np.uint64(0x9E3779B97F4A7C15) + token[pair + 1]) & np.uint64(FEATURES - 1)
    both = np.r_[token, twin].astype(np.int64)
    # Tokens that say again what stands one, two or four before.
    said = np.zeros(len(token), bool)
    for back in (1, 2, 4):
        said[back:] |= (token[back:] == token[:-back]) & (unit[back:] == unit[:-back])
    repeats = np.bincount(unit[said], minlength=len(sizes))
    again = [(np.flatnonzero((repeats >= share * sizes) & (sizes > 2)), mark) for share, mark in REPEATS]
    # A passage of one token, such as a number, is too little to tell.
    at = np.r_[unit, unit[pair]]
    told = sizes[at] > 1
    fillers = Units(owner, np.concatenate([at[told], *(at for at, _ in again)]), np.concatenate([both[told], *(np.full(len(at), mark) for at, mark in again)]), _flat(batch.column("filler"))[0].astype(bool))
    # A text without any token has no evidence, not even its length.
    told = np.flatnonzero(count)
    size = LENGTHS[np.log2(count[told]).astype(np.int64)]
    errors = Units(np.arange(batch.num_rows), np.r_[record, record[pair], told], np.r_[both, size], batch.column("error").to_numpy(zero_copy_only=False).astype(bool))
    mark, _ = _flat(batch.column("marks"))
    marks, slots = _flat(batch.column("slots"))
    named = _flat(batch.column("named"))[0].astype(bool)
    found = Units(np.repeat(np.arange(batch.num_rows), slots), np.repeat(np.arange(len(marks)), marks), mark.astype(np.int64), named)
    return found, fillers, errors


Model = list[tuple[np.ndarray | None, float]]


def _counting(model, first: bool):
    """One expectation step: per kind, features weighted by the chance that their unit is positive; in the first round also how often they occur at all. One table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The two numbers past all features count the units and the features.
        positive, every = np.zeros((2, 3, FEATURES + 2))
        for batch in batches:
            for kind, units in enumerate(_units(batch)):
                weights, prior = model.value[kind]
                chance = np.zeros(len(units.owner)) if weights is None else 1 / (1 + np.exp(-np.clip(units.score(weights, prior), -50, 50)))
                chance[units.trusted] = 1
                share = chance[units.unit]
                positive[kind] += np.bincount(units.feature, share, minlength=FEATURES + 2)
                positive[kind, FEATURES:] += chance.sum(), share.sum()
                if first:
                    every[kind] += np.bincount(units.feature, minlength=FEATURES + 2)
                    every[kind, FEATURES:] += len(chance), len(share)
        for kind in range(3):
            at = np.flatnonzero(every[kind] if first else positive[kind] > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(positive[kind][at]), pa.array(every[kind][at])], names=["kind", "feature", "positive", "every"])

    return run


def encoded(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All documents as numbers, written: texts are tokenised once, however many rounds follow. Rows with a null id or text are left out."""
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return written(rows.mapInArrow(_encode, ENCODED))


def fit(documents: DataFrame, *, rounds: int = ROUNDS) -> Model:
    """The three models of :func:`encoded` documents: a weight per feature and the prior log odds of each.

    All documents take part. Each round counts, in Spark, the features of all units weighted by their current chance; only feature totals
    reach the driver, and their number is bounded by ``FEATURES``. Features that no document has say nothing. A kind without any seed gets no model and finds nothing.
    """
    context = documents.sparkSession.sparkContext
    model: Model = [(None, -np.inf)] * 3
    every, before = np.zeros((3, FEATURES + 2)), np.zeros(3)
    for n in range(rounds):
        shared = context.broadcast(model)
        counts = documents.mapInArrow(_counting(shared, n == 0), "kind int, feature int, positive double, every double").groupBy("kind", "feature").agg(F.sum("positive").alias("positive"), F.sum("every").alias("every"))
        # How often a feature occurs at all stays the same.
        table = (counts if n == 0 else counts.filter(F.col("positive") > 0.01).drop("every")).toArrow()
        at = table["kind"].to_numpy(), table["feature"].to_numpy()
        positive = np.zeros((3, FEATURES + 2))
        positive[at] = table["positive"].to_numpy()
        if n == 0:
            every[at] = table["every"].to_numpy()
        model = [_weights(positive[kind], every[kind]) for kind in range(3)]
        found, before = positive[:, FEATURES], positive[:, FEATURES] - before
        if (np.abs(before) <= SETTLED * found).all():
            break
        before = found
    return model


def _weights(positive: np.ndarray, every: np.ndarray) -> tuple[np.ndarray | None, float]:
    """One maximization step, from the counts of a kind."""
    found, units = positive[FEATURES], every[FEATURES]
    n_pos, n_all = positive[FEATURES + 1], every[FEATURES + 1]
    if found < 1 or n_pos >= n_all:
        return None, -np.inf
    share, other = n_pos / n_all, np.maximum(every - positive, 0)[:FEATURES]
    weights = np.log((positive[:FEATURES] + PSEUDO * share) / n_pos) - np.log((other + PSEUDO * (1 - share)) / (n_all - n_pos))
    return weights.astype(np.float32), min(float(np.log(found / max(units - found, 1.0))), MOST_PRIOR)


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """``(id, kind, score, units)`` for every reason to exclude one of the :func:`encoded` documents: the highest log odds of its units of a kind, and how many are positive.

    Whole texts are scored, all of them. Blank texts have no evidence. A
    repeated row gives its reasons once. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count = batch.column("id"), batch.num_rows
            for kind, units in enumerate(_units(batch)):
                odds = units.score(*shared.value[kind])
                hits = odds > 0
                best = np.full(count, -np.inf)
                np.maximum.at(best, units.owner[hits], odds[hits])
                at = np.flatnonzero(best > 0)
                number = np.bincount(units.owner[hits], minlength=count)[at]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([NAMES[kind]] * len(at), pa.string()), pa.array(best[at]), pa.array(number.astype(np.int64))], names=["id", "kind", "score", "units"])

    return documents.mapInArrow(run, "id string, kind string, score double, units long").distinct()


def residue(documents: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Fit on ``documents`` and judge all of them; see :func:`fit` and :func:`judge`. Other columns are ignored."""
    rows = encoded(documents, id_col, text_col)
    return judge(rows, fit(rows, **options))
