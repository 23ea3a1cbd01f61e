"""Token streams of whole batches of texts as numpy arrays.

Tokens are single characters in U+4E00-9FFF or U+3400-4DBF and maximal runs of other letters or
digits of the lower-cased text; everything else separates. A token is represented by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: 0 separates, 1 is a token by itself, 2 belongs to a run."""
    classes = np.fromiter((2 if chr(c).isalnum() else 0 for c in range(0x110000)), np.uint8, 0x110000)
    classes[0x4E00:0xA000] = 1
    classes[0x3400:0x4DC0] = 1
    return classes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _STEP | np.uint64(1), np.uint64))


def token_stream(texts: list[str | None], offsets: bool = False) -> tuple[np.ndarray, ...]:
    """``(record, token)`` per token, in order; with ``offsets`` also its start and end in its lower-cased text.

    Null and blank texts have no tokens.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = char_classes()[points]
    before = np.r_[np.uint8(0), kind[:-1]] if len(kind) else kind
    begins = (kind == 1) | ((kind == 2) & (before != 2))
    starts = np.flatnonzero(begins)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    bounds = np.cumsum(lengths)
    record = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, np.searchsorted(starts, bounds)]))
    if not len(starts):
        empty = np.empty(0, np.int64)
        return (record, np.empty(0, np.uint64), empty, empty) if offsets else (record, np.empty(0, np.uint64))
    inside = np.flatnonzero(kind)
    owner = np.cumsum(begins[inside]) - 1
    place = inside - starts[owner]
    value = (points[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    first = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
    token = mix(np.add.reduceat(value, first))
    if not offsets:
        return record, token
    shift = (bounds - lengths)[record]
    ends = inside[np.r_[first[1:] - 1, len(inside) - 1]] + 1
    return record, token, starts - shift, ends - shift


def text_parts(text: pa.StringScalar, size: int) -> Iterator[str]:
    """A long text in parts of about ``size`` bytes, none of which begins or ends within a token.

    A part ends behind white space or a character that is a token by itself. Neither has a bearing on how letters beside it are lower-cased,
    so the parts have the tokens of the whole text. Where there is no such place, a part is longer.
    """
    data = memoryview(text.as_buffer() or b"")
    at, rest = 0, ""
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        known = len(rest)
        rest += str(data[at:end], "utf-8")
        at = end
        cut = len(rest) if at == len(data) else next((i for i in range(len(rest), known, -1) if rest[i - 1].isspace() or char_classes()[ord(rest[i - 1])] == 1), 0)
        if cut:
            yield rest[:cut]
            rest = rest[cut:]


def shingle_stream(record: np.ndarray, token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(record, shingle)`` of every run of ``width`` tokens within one record, repeats included."""
    n = len(token) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, power in enumerate(_powers(width)):
        total += token[i : i + n] * power
    whole = record[:n] == record[width - 1 :]
    return record[:n][whole], mix(total[whole])


def joined_hash(tokens: Iterator[np.ndarray]) -> np.uint64:
    """The :func:`sequence_hash` of one record whose tokens come in parts."""
    total, before = 0, 0
    for token in tokens:
        if len(token):
            total += int(np.sum(token * _powers(len(token)))) * pow(int(_STEP | np.uint64(1)), before, 1 << 64)
            before += len(token)
    return mix(np.array([total % (1 << 64)], np.uint64))[0] if before else np.uint64(0)


def sequence_hash(record: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash of the token sequence of each of ``n`` records; 0 where there is no token."""
    out = np.zeros(n, np.uint64)
    if len(record):
        first = np.r_[0, np.flatnonzero(np.diff(record)) + 1]
        place = np.arange(len(record)) - np.repeat(first, np.diff(np.r_[first, len(record)]))
        out[record[first]] = mix(np.add.reduceat(token * _powers(int(place.max()) + 1)[place], first))
    return out
