"""Vectorised word hashing of whole text columns.

A word is a maximal run of bytes that a table maps to a non-zero code. Its
64-bit hash is a polynomial of the codes modulo 2**64 with a final mix, got
from prefix sums, so no Python object is made for a word. Separators are ASCII
in every table, so words never split a UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np

from weirflow.llm.common import BLOCK_BYTES, spans

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _codes(separators: set[int], lower: bool) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if lower:
        values[65:91] += U(32)
    codes = mix((values + U(1)) * U(0xE7037ED1A0B428DB)) | U(1)
    codes[sorted(separators)] = 0
    return codes


_SPACES = {0x20, *range(0x09, 0x0E)}
#: Words between white space, case kept.
SPACED = _codes(_SPACES, lower=False)
#: Words between white space, A-Z as a-z.
SPACED_LOWER = _codes(_SPACES, lower=True)
#: Runs of digits, letters and all beyond ASCII, A-Z as a-z.
ALNUM_LOWER = _codes(
    {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True
)


def power(kind: str, n: int) -> np.ndarray:
    """Powers of the base (``up``) or of its inverse (``down``), ``n`` or more."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _INVERSE
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have


def _block_words(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray):
    """Hashes, first bytes and ends of the words of one block; ``bounds``: its rows' offsets."""
    values = codes[data]
    word = values != 0
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    inner = bounds[1:-1]
    before[inner[inner < len(word)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    cut = inner[(inner > 0) & (inner < len(word))] - 1
    after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power("up", n)[:n], out=total[1:], dtype=np.uint64)
    hashes = (total[ends] - total[starts]) * power("down", n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def _long_row(data: np.ndarray, codes: np.ndarray):
    """As :func:`_block_words` for one long row, in blocks that end at separators."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and codes[data[end]] != 0:  # never inside a word
            tail = np.flatnonzero(codes[data[end : end + BLOCK_BYTES]] == 0)
            end = end + int(tail[0]) if len(tail) else min(len(data), end + BLOCK_BYTES)
        h, s, e = _block_words(data[at:end], np.array([0, end - at]), codes)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray):
    """Yield blocks of rows as ``(low, high, hashes, starts, ends, first)``.

    ``low`` and ``high`` bound the rows; ``starts`` and ``ends`` are byte places
    in ``data``; row ``low + i`` has the words ``first[i]`` to ``first[i + 1]``.
    """
    for low, high in spans(offsets):
        begin, end = int(offsets[low]), int(offsets[high])
        bounds = offsets[low : high + 1] - begin
        if begin == end:
            empty = np.zeros(0, np.int64)
            yield low, high, np.zeros(0, np.uint64), empty, empty, np.zeros(high - low + 1, np.int64)
            continue
        if end - begin > BLOCK_BYTES:
            hashes, starts, ends = _long_row(data[begin:end], codes)
        else:
            hashes, starts, ends = _block_words(data[begin:end], bounds, codes)
        yield low, high, hashes, starts + begin, ends + begin, np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` hashes; the caller drops runs across rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * U(0xFF51AFD7ED558CCD) + hashes[j : j + n]
    return mix(total)


def row_ends(first: np.ndarray) -> np.ndarray:
    """For each word the index after the last word of its row."""
    return np.repeat(first[1:], np.diff(first))


def coverage(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` places a run from one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0
