"""External induced suffix sorting with common-prefix values.

Suffixes are never compared. The suffixes that start a rise after a fall (the
seeds) are sorted by recursion on the string of their names; two sweeps then
induce the order of all others: each extracted suffix ``i`` inserts ``i - 1``
into the queue of its first symbol. Insertions into a queue arrive in order, so
the priority queue is one first-in-first-out run for each symbol; runs beyond
the memory limit go to a scratch file of the task (in its temporary folder, which
no other task reads) and are read back block by block.

Entries are tuples (place, common prefix with the entry before). An induced
entry's common prefix is one more than the least value between the entry that
induced it and the one that induced its neighbour. Values stop at ``cap``.
Symbols are handled in whole waves with numpy, not suffix by suffix.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that queues and a level sorted in memory may take.
MEMORY = 192 << 20
#: Entries of a chunk in a queue at most, chunks that are read together, and entries with which no more are read.
BLOCK, _CHUNKS, _ENTRIES = 1 << 14, 64, 1 << 17
_FAR = np.uint8(255)


def _stored(n: int) -> np.dtype:
    """The smallest type that queues store places of ``n`` symbols in."""
    return np.dtype(np.int32 if n < 1 << 31 else np.int64)


def _packed(text: np.ndarray, beyond: int) -> tuple[np.ndarray, int]:
    """As many symbols from each place as 64 bits hold, zeros after the end, and their number."""
    size = text.dtype.itemsize
    padded = np.concatenate([text, np.zeros(beyond + 8 // size, text.dtype)])
    return np.ndarray((len(text) + beyond,), "<u8", padded, 0, (size,)), 8 // size


class Queues:
    """Runs of (place, prefix) for each symbol, on disk beyond ``limit`` bytes."""

    def __init__(self, limit: int, kind: np.dtype):
        self._limit, self._held, self._file, self._kind = limit, 0, None, kind
        self._chunks: dict[int, list] = defaultdict(list)

    def push(self, symbol: int, place: np.ndarray, prefix: np.ndarray) -> None:
        chunks = self._chunks[symbol]
        for low in range(0, len(place), BLOCK):
            chunks.append((place[low : low + BLOCK].astype(self._kind), prefix[low : low + BLOCK].copy()))
            self._held += (self._kind.itemsize + 1) * min(BLOCK, len(place) - low)
        if self._held > self._limit:
            self._spill()

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile(prefix="weirflow-queues-")
        self._file.seek(0, 2)
        for chunks in self._chunks.values():
            for i, chunk in enumerate(chunks):
                if len(chunk) == 2:
                    at = self._file.tell()
                    self._file.write(chunk[0].tobytes())
                    self._file.write(chunk[1].tobytes())
                    chunks[i] = (at, len(chunk[0]), None)
        self._held = 0

    def _read(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if len(chunk) == 2:
            return chunk
        at, n, _ = chunk
        self._file.seek(at)
        place = np.frombuffer(self._file.read(self._kind.itemsize * n), self._kind)
        return place, np.frombuffer(self._file.read(n), np.uint8)

    def symbols(self) -> set[int]:
        return {s for s, chunks in self._chunks.items() if chunks}

    def _joined(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        read = [self._read(c) for c in chunks]
        prefix = read[0][1] if len(read) == 1 else np.concatenate([r[1] for r in read])
        return np.concatenate([r[0] for r in read], dtype=np.int64), prefix

    def blocks(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in insertion order, also those pushed while reading."""
        at = 0
        while chunks := self._chunks.get(symbol, [])[at : at + _CHUNKS]:
            sizes = np.cumsum([c[1] if len(c) == 3 else len(c[0]) for c in chunks])
            chunks = chunks[: int(np.searchsorted(sizes, _ENTRIES)) + 1]
            yield self._joined(chunks)
            at += len(chunks)

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last one, reversed; prefixes refer to the entry read before (first: 0)."""
        later = np.zeros(1, np.uint8)
        chunks = self._chunks.get(symbol, [])
        for high in range(len(chunks), 0, -_CHUNKS):
            place, prefix = self._joined(chunks[max(0, high - _CHUNKS) : high])
            yield place[::-1], np.concatenate([later, prefix[:0:-1]])
            later = prefix[:1]

    def close(self) -> None:
        self._chunks.clear()
        if self._file is not None:
            self._file.close()


class _Sweep:
    """Inserts the predecessors of extracted entries into ``queues``."""

    def __init__(self, text, falls, want_falls: bool, queues: Queues, sigma: int, cap: int):
        self.text, self.falls, self.want, self.queues = text, falls, want_falls, queues
        self.cap, self.prefixes = cap, cap > 0
        #: Least prefix value since the last insertion into a symbol's queue; -1: none yet.
        self.since = np.full(sigma if self.prefixes else 0, -1, np.int16)

    def extract(self, place: np.ndarray, prefix: np.ndarray) -> None:
        before = np.maximum(place - 1, 0)
        hit = np.flatnonzero((place > 0) & (self.falls[before] == self.want))
        n = len(place)
        if not len(hit):
            if self.prefixes and n:
                np.minimum(self.since, prefix.min(), out=self.since)
            return
        before = before[hit]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before, hit = symbol[order], before[order], hit[order]
        cuts = np.concatenate([[0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)]])
        keys = symbol[cuts[:-1]]
        if not self.prefixes:
            none = np.zeros(len(before), np.uint8)
            for k, low, high in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.queues.push(k, before[low:high], none[low:high])
            return
        # For each symbol: least values up to its first entry, between entries, after the last.
        groups = len(keys)
        marks = np.zeros(len(hit) + 2 * groups, np.int64)
        slot = np.arange(len(hit)) + 2 * np.repeat(np.arange(groups), np.diff(cuts)) + 1
        marks[slot] = hit + 1
        tails = cuts[1:] + 2 * np.arange(groups)
        marks[tails + 1] = n
        least = np.minimum.reduceat(np.append(prefix, _FAR), marks)
        value = least[slot - 1].astype(np.int16)
        heads = cuts[:-1]
        value[heads] = np.minimum(value[heads], self.since[keys])
        value = np.minimum(value + 1, self.cap).astype(np.uint8)
        np.minimum(self.since, prefix.min(), out=self.since)
        self.since[keys] = least[tails]
        for k, low, high in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.queues.push(k, before[low:high], value[low:high])


def _shapes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes fall (are greater than the next one), and the seeds in text order."""
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]).astype(_stored(n)), n - 1)  # ends of equal symbols
    falling = np.append((text[:-1] > text[1:])[change[:-1]], False)
    falls = np.repeat(falling, np.diff(change, prepend=-1))
    return falls, np.flatnonzero(~falls[1:] & falls[:-1]) + 1


def _symbol_run(text: np.ndarray, place: int, cap: int) -> int:
    """How often the symbol of ``place`` repeats from there on, at most ``cap``."""
    other = np.flatnonzero(text[place : place + cap] != text[place])
    return int(other[0]) if len(other) else len(text[place : place + cap])


def _sweeps(text, falls, seeds: Queues, sigma, cap, memory, emit: Callable | None) -> None:
    """Both sweeps; ``emit(place, prefix, falling)`` gets all suffixes from the greatest down."""
    prefixes = cap > 0
    falling = Queues(memory, _stored(len(text)))
    up = _Sweep(text, falls, True, falling, sigma, cap)
    pending = np.flatnonzero(np.bincount(text))

    def first_of(place, prefix, last):
        if prefixes and len(place):
            prefix = prefix.copy()
            prefix[0] = 0 if last is None else min(_symbol_run(text, x, cap) for x in (last, place[0]))
        return prefix

    for symbol in pending.tolist():
        last = None
        for place, prefix in falling.blocks(symbol):  # grows while it is read
            up.extract(place, prefix)
            last = place[-1]
        for k, (place, prefix) in enumerate(seeds.blocks(symbol)):
            up.extract(place, first_of(place, prefix, last) if k == 0 else prefix)
    rising = Queues(memory, _stored(len(text)))
    down = _Sweep(text, falls, False, rising, sigma, cap)
    for symbol in pending[::-1].tolist():
        last = None
        for place, prefix in rising.blocks(symbol):
            down.extract(place, prefix)
            if emit:
                emit(place, prefix, False)
            last = place[-1]
        if symbol == pending[0]:  # the sentinel, which nothing induces
            end = np.array([len(text) - 1])
            down.extract(end, np.zeros(1, np.uint8))
            if emit:
                emit(end, np.zeros(1, np.uint8), False)
        for k, (place, prefix) in enumerate(falling.backwards(symbol)):
            if k == 0:
                prefix = first_of(place, prefix, last)
            down.extract(place, prefix)
            if emit:
                emit(place, prefix, True)
    falling.close()
    rising.close()


def _doubled(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffix order of a string that fits in memory, by doubling what is ranked.

    ``order``: its places by their names.
    """
    n = len(names)
    ordered = names[order]
    heads = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    del ordered
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(heads, sizes) + 1
    rank[n] = 0
    active = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(active):
        key = rank[active] * np.int64(n + 1) + rank[np.minimum(active + step, n)]
        by = np.argsort(key)
        active, key = active[by], key[by]
        group = rank[active]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        outer = np.concatenate([[True], group[1:] != group[:-1]])
        heads, outer = np.flatnonzero(fresh), np.flatnonzero(outer)
        sizes = np.diff(np.append(heads, len(active)))
        first = np.repeat(outer, np.diff(np.append(outer, len(active))))[heads]
        rank[active] = np.repeat(group[heads] + heads - first, sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out


def _ordered_seeds(text, falls, seeds, sigma, memory, forced_depth: int) -> np.ndarray:
    """The seeds in the order of their suffixes: names by induction, then recursion."""
    first = Queues(memory, _stored(len(text)))
    symbols = text[seeds]
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    for part in np.split(seeds[order], cuts):
        if len(part):
            first.push(int(text[part[0]]), part, np.zeros(len(part), np.uint8))
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    found: list[np.ndarray] = []

    def keep(place, prefix, falling):
        if not falling:
            found.append(place[is_seed[place]])

    _sweeps(text, falls, first, sigma, 0, memory, keep)
    first.close()
    by_piece = np.concatenate(found)[::-1]
    del found, is_seed
    number = np.empty(len(text), _stored(len(text)))
    number[seeds] = np.arange(len(seeds))
    index = number[by_piece].astype(np.int64)
    del number
    ends = np.append(seeds[1:] + 1, len(text))  # a piece ends with the next seed's symbol
    length = (ends - seeds)[index]
    same = np.concatenate([[False], length[1:] == length[:-1]])
    packed, width = _packed(text, 0)
    masks = np.array([(1 << 64 // width * k) - 1 for k in range(width + 1)], np.uint64)
    at = np.flatnonzero(same)
    done = 0
    while len(at):  # the next symbols of those that are equal so far
        differ = packed[by_piece[at] + done] ^ packed[by_piece[at - 1] + done]
        equal = differ & masks[np.minimum(length[at] - done, width)] == 0
        same[at[~equal]] = False
        done += width
        at = at[equal]
        at = at[length[at] > done]
    if not same.any():
        return by_piece
    names = np.empty(len(seeds), np.int64)
    names[index] = np.cumsum(~same) - 1
    del by_piece, length, ends, same, packed, at
    if len(names) * 48 <= memory and forced_depth <= 0:
        return seeds[_doubled(names, index)]
    return seeds[suffix_order(names, memory, forced_depth - 1)]


def suffix_order(text: np.ndarray, memory: int = MEMORY, depth: int = 0) -> np.ndarray:
    """Suffix array of ``text``, whose last symbol is its least and occurs once.

    ``depth`` recursion levels are made even where memory would allow a level
    to be sorted at once.
    """
    if len(text) == 1:
        return np.zeros(1, np.int64)
    out: list[np.ndarray] = []
    induce(text, 0, lambda place, prefix, falling: out.append(place.copy()), memory, depth)
    return np.concatenate(out)[::-1]


def _prefixes(text: np.ndarray, seeds: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each ordered seed with the one before, at most ``cap``."""
    value = np.zeros(len(seeds), np.uint8)
    packed, width = _packed(text, cap)
    at = np.arange(1, len(seeds))
    left, right = seeds[:-1], seeds[1:]
    done = 0
    while len(at) and done < cap:  # the next symbols of all that agree so far
        differ = packed[left + done] ^ packed[right + done]
        stop = differ != 0
        lowest = differ[stop]
        lowest &= ~lowest + np.uint64(1)
        agree = (np.frexp(lowest.astype(np.float64))[1] - 1) // (64 // width)
        value[at[stop]] = np.minimum(done + agree, cap)
        go = ~stop
        at, left, right = at[go], left[go], right[go]
        done += width
    value[at] = cap
    return value


def induce(text: np.ndarray, cap: int, emit: Callable, memory: int = MEMORY, depth: int = 0) -> None:
    """Call ``emit(place, prefix, falling)`` on all suffixes from the greatest down.

    ``prefix``: symbols shared with the suffix emitted before, at most ``cap``
    (below 255; 0: not wanted, then symbols may be of any number).
    """
    falls, seeds = _shapes(text)
    sigma = int(text.max()) + 1
    ordered = _ordered_seeds(text, falls, seeds, sigma, memory, depth)
    prefix = _prefixes(text, ordered, cap) if cap else np.zeros(len(ordered), np.uint8)
    queues = Queues(memory, _stored(len(text)))
    cuts = np.flatnonzero(np.diff(text[ordered])) + 1
    for part, values in zip(np.split(ordered, cuts), np.split(prefix, cuts), strict=True):
        if len(part):
            queues.push(int(text[part[0]]), part, values)
    _sweeps(text, falls, queues, sigma, cap, memory, emit)
    queues.close()
