"""Anchors: the candidate search behind the two exact repeat operators.

Every window of ``window`` symbols is led by its smallest ``gram`` hash (the
leftmost on ties), so equal windows have equal leaders at equal places. Windows
led by one place form a run; a run with the text it covers is a segment. Equal
windows therefore always meet in the group of their leader's hash, and a window
whose leader occurs once in the corpus is unique. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from weirflow.llm.common import BLOCK_BYTES, spans
from weirflow.llm.tokens import SPACED, U, grams, mix, power, row_ends, words

_BITS = U(24)
#: Bytes of rows whose hashes are taken at once, so that they stay in a core's cache.
_CACHED = 1 << 16
_LOW = U((1 << 24) - 1)
_MIXED_BYTES = mix(np.arange(256, dtype=np.uint64) + U(77))


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``bytes`` of the text or white-space ``words``.

    ``crowd``: different segments of one leader beyond which they are not brought
    together.
    """

    kind: str
    window: int
    gram: int
    crowd: int = 256


@dataclass
class Runs:
    """Runs of windows: row, first and last window start, leader's place and hash.

    Places count symbols from the row's first. ``content`` hashes the covered
    symbols together with the leader's place among them.
    """

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray
    hash: np.ndarray


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def _byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes, 16 <= k <= 24."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)

    def eight(at: int) -> np.ndarray:
        return np.ndarray((n,), "<u8", data, at, (1,))

    t = eight(0) * U(0xE7037ED1A0B428DB)
    t ^= t >> U(32)
    t += eight(8)
    t *= U(0x8EBC6AF09C88C6E3)
    t ^= t >> U(29)
    t += eight(k - 8)
    return mix(t)


def _runs(g: np.ndarray, ends: np.ndarray, n: int, unit: Unit):
    """Runs over ``n`` concatenated symbols whose rows end at ``ends``; places are global."""
    count = n - unit.window + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(g), dtype=np.uint64)
    led = _sliding_min((g & ~_LOW) | at, unit.window - unit.gram + 1)[:count]
    valid = ends[:count] >= np.arange(unit.window, count + unit.window)
    change = led[1:] != led[:-1]
    begins = valid.copy()
    begins[1:] &= change | ~valid[:-1]
    closes = valid.copy()
    closes[:-1] &= change | ~valid[1:]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(closes), (led[first] & _LOW).astype(np.int64)


def _pieces(g, ends, base: np.ndarray, rows: np.ndarray, n: int, unit: Unit) -> Iterator[Runs]:
    """Runs in blocks of symbols, so that a long row needs no more memory than a block."""
    step = BLOCK_BYTES
    for low in range(0, max(n - unit.window + 1, 0), step):
        high = min(n, low + step + unit.window - 1)
        first, last, lead = _runs(
            g[low : high - unit.gram + 1], ends[low:high] - low, high - low, unit
        )
        if len(first):
            shift = low - base[first + low]
            yield Runs(
                rows[first + low], first + shift, last + shift, lead + shift, g[lead + low]
            )


def runs(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[Runs]:
    """All runs of the rows of a text buffer."""
    if unit.kind == "bytes":
        for low, high in spans(offsets, _CACHED):
            begin, end = int(offsets[low]), int(offsets[high])
            sizes = np.diff(offsets[low : high + 1])
            ends = np.repeat(offsets[low + 1 : high + 1] - begin, sizes)
            base = np.repeat(offsets[low:high] - begin, sizes)
            rows = np.repeat(np.arange(low, high), sizes)
            g = _byte_grams(data[begin:end], unit.gram)
            yield from _pieces(g, ends, base, rows, end - begin, unit)
    else:
        for low, high, hashes, _, _, first in words(data, offsets, SPACED):
            sizes = np.diff(first)
            base = np.repeat(first[:-1], sizes)
            rows = np.repeat(np.arange(low, high), sizes)
            g = grams(hashes, unit.gram)
            yield from _pieces(g, row_ends(first), base, rows, len(hashes), unit)


class Prefix:
    """Hashes of any run of a symbol sequence, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self._down = power("down", n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        mixed = _MIXED_BYTES[symbols] if symbols.dtype == np.uint8 else mix(symbols + U(77))
        np.cumsum(mixed * power("up", n)[:n], out=self._sum[1:], dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def pack(r: Runs) -> np.ndarray:
    """First window, further windows and the leader's distance in one integer."""
    return (r.first << 16) | ((r.last - r.first) << 8) | (r.lead - r.first)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and leader of packed places."""
    first = place >> 16
    return first, first + ((place >> 8) & 255), first + (place & 255)
