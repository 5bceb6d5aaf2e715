"""Language identification with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word (with the blank before it) is the sum over all of its
segmentations into pieces, got by the forward algorithm; the piece probabilities
come from expected counts (EM) over labelled words. A text's score is the sum
over all of its words. The recursion runs over many distinct words at once, with
scaled probabilities; words beyond ``SHORT`` bytes, as of scripts without blanks,
are summed one by one in logarithms. Nothing is cut: a word may have any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import fresh, lean, prepare, text_buffer
from weirflow.llm.tokens import _BASE, _INVERSE, SPACED_LOWER, U, mix, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Labelled documents of a language that are expected in the training sample.
TRAIN_DOCS = 150
#: Bytes of a word, with its blank, up to which scaled sums cannot leave the range of doubles.
SHORT = 48
#: Short words that are summed together, and bytes of a long one whose pieces are looked up together.
_WORDS, _STRETCH = 5_000, 1 << 16
ROUNDS = 3
_FLOOR = 0.01
#: Scale of a byte, against underflow.
_SCALE = 2000.0
#: Distinct words whose scores a worker keeps.
_CACHE = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UP = np.cumprod(np.concatenate([[U(1)], np.full(1 << 18, _BASE)]), dtype=np.uint64)
_DOWN = np.cumprod(np.concatenate([[U(1)], np.full(1 << 18, _INVERSE)]), dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + U(1)) * _UP[: len(data)], out=total[1:], dtype=np.uint64)
    return total


@dataclass
class Pieces:
    """Vocabulary pieces by length: their sorted hashes and numbers."""

    hashes: dict[int, np.ndarray]
    numbers: dict[int, np.ndarray]
    count: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Pieces of a rank file (base64 text and rank in a line), and all single bytes.

        A word has white space nowhere but in front, so pieces that hold some
        further on occur in none and are passed over.
        """
        with open(path, "rb") as lines:
            return cls.of(p for p in (base64.b64decode(x.split()[0]) for x in lines) if len(p[1:].split()) == 1 and p[1:] == p[1:].strip())

    @classmethod
    def of(cls, given: Iterable[bytes]) -> Pieces:
        """The given pieces and all single bytes."""
        pieces = {bytes([b]) for b in range(256)} | set(given)
        ordered = sorted(pieces, key=lambda p: (len(p), p))
        hashes: dict[int, np.ndarray] = {}
        numbers: dict[int, np.ndarray] = {}
        at = 0
        for length in sorted({len(p) for p in ordered}):
            same = [p for p in ordered if len(p) == length]
            data = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), length)
            h = np.zeros(len(same), np.uint64)
            for j in range(length):
                h += mix(data[:, j].astype(np.uint64) + U(1)) * _UP[j]
            order = np.argsort(h)
            hashes[length] = h[order]
            numbers[length] = order + at
            at += len(same)
        return cls(hashes, numbers, at)

    def ending(self, total: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places ``last`` end a piece of that length, and its number; ``total``: prefix sums."""
        known = self.hashes[length]
        first = last - length + 1
        h = (total[last + 1] - total[first]) * _DOWN[first]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        good = known[at] == h
        return last[good], self.numbers[length][at[good]].astype(np.int32)


class Lattice:
    """All pieces that end at each byte of a list of short words."""

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray):
        self.offsets, self.sizes = offsets, np.diff(offsets)
        self.order = np.argsort(-self.sizes, kind="stable")
        self.bytes = n = len(data)
        total = _sums(data)
        inner = np.arange(n) - np.repeat(offsets[:-1], self.sizes)
        self.piece: dict[int, np.ndarray] = {}  # by length, at the last byte
        for length in pieces.hashes:
            last, number = pieces.ending(total, np.flatnonzero(inner >= length - 1), length)
            if len(last):
                self.piece[length] = np.full(n, -1, np.int32)
                self.piece[length][last] = number

    def _steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each place in a word: the first bytes of the words that reach it."""
        ordered = self.sizes[self.order]
        starts = self.offsets[:-1][self.order]
        for t in range(int(ordered[0]) if len(ordered) else 0):
            yield t, starts[: int(np.searchsorted(-ordered, -t, side="left"))]

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sum over segmentations up to each byte; ``probability``: pieces x languages, scaled."""
        alpha = np.zeros((self.bytes, probability.shape[1]))
        for t, starts in self._steps():
            here = starts + t
            for length, piece in self.piece.items():
                if length > t + 1:
                    continue
                p = piece[here]
                hit = np.flatnonzero(p >= 0)
                if not len(hit):
                    continue
                value = probability[p[hit]]
                if length <= t:
                    value = value * alpha[here[hit] - length]
                alpha[here[hit]] += value
        return alpha

    def backward(self, probability: np.ndarray) -> np.ndarray:
        """Sum over segmentations of what follows each byte."""
        beta = np.zeros((self.bytes, probability.shape[1]))
        beta[self.offsets[1:] - 1] = 1.0
        for t, starts in reversed(list(self._steps())):
            here = starts + t
            for length, piece in self.piece.items():
                if length > t:
                    continue
                p = piece[here]
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    beta[here[hit] - length] += probability[p[hit]] * beta[here[hit]]
        return beta

    def scores(self, probability: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        ends = self.forward(probability)[self.offsets[1:] - 1]
        return np.log(np.maximum(ends, 1e-300)) - self.sizes[:, None] * np.log(_SCALE)

    def expected(self, probability: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Add to ``out`` how often each piece is expected in the words; ``probability``: pieces x 1."""
        alpha, beta = self.forward(probability)[:, 0], self.backward(probability)[:, 0]
        total = np.maximum(alpha[self.offsets[1:] - 1], 1e-300)
        each = np.repeat(weight / total, self.sizes)
        inner = np.arange(len(alpha)) - np.repeat(self.offsets[:-1], self.sizes)
        for length, piece in self.piece.items():
            last = np.flatnonzero(piece >= 0)
            p = piece[last]
            before = np.where(inner[last] >= length, alpha[last - length], 1.0)
            out += np.bincount(p, before * probability[p, 0] * beta[last] * each[last], minlength=len(out))


class LongWord:
    """One long word, in logarithms; its pieces are looked up stretch by stretch."""

    def __init__(self, pieces: Pieces, data: np.ndarray):
        self.pieces, self.data = pieces, data
        self.longest = max(pieces.hashes)

    def _stretches(self, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(low, bounds, length, number)``: the pieces that end at the places from ``low`` on."""
        lows = range(0, len(self.data), _STRETCH)
        for low in reversed(lows) if backwards else lows:
            high = min(len(self.data), low + _STRETCH)
            base = max(0, low - self.longest + 1)
            total = _sums(self.data[base:high])
            found = []
            for length in self.pieces.hashes:
                last = np.arange(max(low, length - 1), high) - base
                if len(last):
                    at, number = self.pieces.ending(total, last, length)
                    found.append((at + base - low, np.full(len(at), length), number))
            place, length, number = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(place, kind="stable")
            yield low, np.searchsorted(place[order], np.arange(high - low + 1)), length[order], number[order]

    def forward(self, logs: np.ndarray, keep: bool = False) -> np.ndarray:
        """Log sums over segmentations: of the whole word, or up to each byte; ``logs``: pieces x languages."""
        ring = len(self.data) + 1 if keep else _STRETCH + self.longest
        alpha = np.full((ring, logs.shape[1]), -np.inf)
        alpha[0] = 0.0  # the row of a place is its number plus one
        start = 0
        for low, bounds, length, number in self._stretches():
            if not keep and low:  # only the last rows are needed further on
                tail = alpha[low - start - self.longest + 1 : low - start + 1].copy()
                alpha[: len(tail)], start = tail, low - self.longest + 1
            values = logs[number]
            for t in range(len(bounds) - 1):
                s, e = bounds[t], bounds[t + 1]
                at = low + t + 1 - start
                alpha[at] = np.logaddexp.reduce(values[s:e] + alpha[at - length[s:e]], axis=0)
        return alpha if keep else alpha[len(self.data) - start]

    def expected(self, logs: np.ndarray, weight: float, out: np.ndarray) -> None:
        """As :meth:`Lattice.expected`."""
        alpha = self.forward(logs, keep=True)[:, 0]
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = 0.0
        for low, bounds, length, number in self._stretches(backwards=True):
            for t in range(len(bounds) - 2, -1, -1):
                s, e = bounds[t], bounds[t + 1]
                at = low + t + 1
                value = logs[number[s:e], 0] + beta[at]
                np.add.at(out, number[s:e], weight * np.exp(alpha[at - length[s:e]] + value - alpha[-1]))
                beta[at - length[s:e]] = np.logaddexp(beta[at - length[s:e]], value)


def _scaled(pieces: Pieces, share: np.ndarray) -> np.ndarray:
    length = np.empty(pieces.count)
    for k, numbers in pieces.numbers.items():
        length[numbers] = k
    with np.errstate(over="ignore"):  # pieces beyond SHORT stand in long words only
        return share * (_SCALE ** np.minimum(length, SHORT))[:, None]


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes with a blank before."""
    data = _LOWER[np.frombuffer(b"".join(b" " + w for w in raw), np.uint8)]
    return data, np.concatenate([[0], np.cumsum([len(w) + 1 for w in raw])]).astype(np.int64)


def _long(word: bytes) -> bool:
    return len(word) >= SHORT


def fit(pieces: Pieces, samples: dict[str, tuple[list[bytes], np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces x languages) from words and their counts."""
    columns = []
    for words_, counts in samples.values():
        share = np.full((pieces.count, 1), 1.0 / pieces.count)
        short = [i for i, w in enumerate(words_) if not _long(w)]
        for _ in range(rounds):
            expected = np.zeros(pieces.count)
            scaled, logs = _scaled(pieces, share), np.log(share)
            for low in range(0, len(short), _WORDS):  # made anew each round, as the driver holds one at a time
                some = short[low : low + _WORDS]
                Lattice(pieces, *_joined([words_[i] for i in some])).expected(scaled, counts[some], expected)
            for word, weight in zip(words_, counts, strict=True):
                if _long(word):
                    LongWord(pieces, _joined([word])[0]).expected(logs, weight, expected)
            share = (expected + _FLOOR)[:, None] / (expected.sum() + _FLOOR * pieces.count)
        columns.append(share)
    return np.concatenate(columns, axis=1) if columns else np.zeros((pieces.count, 0))


def word_scores(pieces: Pieces, share: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Log probability of each word in each language: the sum over all of its segmentations."""
    scores = np.zeros((len(raw), share.shape[1]))
    scaled, logs = _scaled(pieces, share), None
    short = [i for i, w in enumerate(raw) if not _long(w)]
    for low in range(0, len(short), _WORDS):
        some = short[low : low + _WORDS]
        scores[some] = Lattice(pieces, *_joined([raw[i] for i in some])).scores(scaled)
    for i, word in enumerate(raw):
        if _long(word):
            logs = np.log(share) if logs is None else logs
            scores[i] = LongWord(pieces, _joined([word])[0]).forward(logs)
    return scores


@dataclass
class Model:
    """Learned languages over the pieces of a vocabulary."""

    languages: list[str]
    pieces: Pieces
    probability: np.ndarray


@lean
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in batch.column("lang").unique():
            mask = pa.compute.equal(batch.column("lang"), lang)
            data, offsets = text_buffer(batch.filter(mask).column("text"))
            for _, _, hashes, starts, ends, _ in words(data, offsets, SPACED_LOWER):
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                raw = [_LOWER[data[s:e]].tobytes() for s, e in zip(starts[first], ends[first], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(raw), pa.string()), pa.array(raw, pa.binary()), pa.array(n)],
                    ["lang", "word", "n"],
                )


def train(labelled: DataFrame, vocabulary: str = VOCABULARY, per_language: int = TRAIN_DOCS) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``, all rows of which may be used.

    The sample is bounded: a language's documents are taken by the hash of their
    id with the share at which ``per_language`` of them are expected (all, if
    there are fewer). Rows without text, language or id teach nothing.
    """
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"
    )
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    languages = sorted(share)
    pieces = Pieces.load(vocabulary)
    if not languages:
        return Model([], pieces, np.zeros((pieces.count, 0)))
    wanted = F.lit(False)
    for lang in languages:
        wanted = wanted | (
            (F.col("lang") == lang)
            & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share[lang] * (1 << 30)) + 1))
        )
    counted = (
        rows.where(wanted)
        .mapInArrow(_count_words, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    samples = {}
    for lang in languages:
        own = counted.filter(pa.compute.equal(counted.column("lang"), lang)).sort_by("word")
        samples[lang] = own.column("word").to_pylist(), own.column("n").to_numpy().astype(float)
    return Model(languages, pieces, fit(pieces, samples))


def _predict(broadcast, guess: str):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        known: dict[int, int] = {}
        table = np.zeros((_CACHE + (1 << 19), len(model.languages)))
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            best, share = [], []
            for low, high, hashes, starts, ends, first in words(data, offsets, SPACED_LOWER):
                values, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) > _CACHE:
                    known.clear()
                keys = values.tolist()
                unseen = [i for i, h in enumerate(keys) if h not in known]
                raw = [data[starts[at[i]] : ends[at[i]]].tobytes() for i in unseen]
                for i, score in zip(unseen, word_scores(model.pieces, model.probability, raw), strict=True):
                    place = len(known)
                    if place >= len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[place] = score
                    known[keys[i]] = place
                places = np.array([known[h] for h in keys], np.int64)
                total = np.zeros((len(hashes) + 1, len(model.languages)))
                np.cumsum(table[places][inverse], axis=0, out=total[1:])
                sums = total[first[1:]] - total[first[:-1]]
                winner = sums.argmax(axis=1)
                shifted = np.exp(sums - sums.max(axis=1, keepdims=True))
                best += [model.languages[w] for w in winner]
                share.append(1.0 / shifted.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "text"),
                    pa.array(best, pa.string()),
                    pa.array(np.concatenate(share) if share else np.zeros(0)),
                ],
                [*(c for c in batch.schema.names if c != "text"), guess, f"{guess}_share"],
            )

    return scan


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the prediction.

    Only the text is looked at, all of it. ``und`` with score 0 if it is null or
    has no letters, or if no language was learned. On a tie the first language in
    alphabetical order wins. Repeated rows are judged alike, a table without rows
    gives none. Other columns are kept, but for ``text`` and two of the new names.
    """
    spark = prepare(docs.sparkSession)
    if not model.languages:
        return docs.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    own = fresh(docs.columns)
    renamed = docs.select(F.col("text").cast("string").alias("text"), *(F.col(c) for c in kept))
    renamed = renamed.withColumn(f"{own}letters", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema if f.name != "text")
    guess = f"{own}guess"
    scored = renamed.mapInArrow(
        _predict(spark.sparkContext.broadcast(model), guess), f"{fields}, `{guess}` string, `{guess}_share` double"
    )
    letters = F.col(f"{own}letters")
    return scored.select(
        *kept,
        F.when(letters, F.col(guess)).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(letters, F.col(f"{guess}_share")).otherwise(F.lit(0.0)).alias("score"),
    )


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its id leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
