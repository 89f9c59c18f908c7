"""A factorisation machine that scores the quality of texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, map_texts, sample_of

#: Hashed words, then the cells of structure statistics and metadata.
WORD_CELLS = 4096
CELLS = 24
STATISTICS = ("n_words", "word_length", "upper", "odd_symbols", "digits", "points", "distinct", "top_word", "neighbours", "repeated_lines", "line_words", "short_words", "long_words")
METADATA = ("n_chars",)
SIZE = WORD_CELLS + CELLS * (len(STATISTICS) + len(METADATA)) + len(METADATA)
RANK = 8
#: At most so many labelled rows train the model.
TRAIN_ROWS = 6000
THRESHOLD = 0.7

#: For each ASCII character: 1 odd symbol, 2 digit, 3 point or comma, 0 anything else.
_KIND = np.zeros(129, dtype=np.int8)
for _c in "#*$%&|<>!^~_=+{}[]\\/@":
    _KIND[ord(_c)] = 1
for _c in "0123456789":
    _KIND[ord(_c)] = 2
for _c in ".,;:?":
    _KIND[ord(_c)] = 3


class _Cells(dict):
    def __missing__(self, word: str) -> int:
        cell = zlib.crc32(word.encode("utf-8", "replace")) % WORD_CELLS
        if len(self) >= 100_000:
            self.clear()
        self[word] = cell
        return cell


#: Name of the cache in which a worker keeps the cells of words.
CACHE = "cells"


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """What STATISTICS names, each from 0 to 1."""
    low = text.lower()
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = np.bincount(_KIND[np.minimum(chars, 128)], minlength=4)
    n, n_words = max(1, len(text)), max(1, len(words))
    upper = 0.0
    if len(low) == len(text):
        upper = float(np.count_nonzero(chars != np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    return [
        min(1.0, math.log1p(len(words)) / 10),
        min(1.0, sum(lengths) / n_words / 16),
        min(1.0, upper * 2),
        min(1.0, kinds[1] / n * 5),
        min(1.0, kinds[2] / n * 5),
        min(1.0, kinds[3] / n * 10),
        len(counts) / n_words,
        (max(counts.values()) if counts else 0) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, math.log1p(n_words / max(1, len(lines))) / 8),
        sum(x <= 2 for x in lengths) / n_words,
        sum(x >= 15 for x in lengths) / n_words,
    ]


def features(text: str, metadata: tuple) -> tuple[list[int], list[float]]:
    """Cells and values: hashed lower-case words (log counts of unit length), and each number shared
    between the two nearest cells of its own; an absent piece of metadata has a cell too."""
    words = text.lower().split()
    counts = Counter(words)
    cells = cache_of(CACHE).setdefault("words", _Cells())
    hashed: dict[int, float] = {}
    for word, count in counts.items():
        cell = cells[word]
        hashed[cell] = hashed.get(cell, 0) + count
    values = [math.log1p(v) for v in hashed.values()]
    norm = math.sqrt(sum(v * v for v in values)) or 1.0
    at, value = list(hashed), [v / norm for v in values]
    base = WORD_CELLS
    numbers = [*statistics(text, words, counts), *(None if m is None else min(1.0, math.log1p(max(0.0, float(m))) / 13) for m in metadata)]
    for k, x in enumerate(numbers):
        if x is None:
            at.append(SIZE - 1 - (k - len(STATISTICS)))
            value.append(1.0)
        else:
            cell = min(int(x * (CELLS - 1)), CELLS - 2)
            part = x * (CELLS - 1) - cell
            at += [base + cell, base + cell + 1]
            value += [1 - part, part]
        base += CELLS
    return at, value


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bias + sum w x + (the squared sums less the sums of squares of v x) / 2, in time linear in the features."""
        linear = np.add.reduceat(self.weights[at] * value, starts)
        vx = self.factors[at] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return self.bias + linear + pairs, sums


def _packed(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([np.asarray(a, dtype=np.int64) for a, _ in rows])
    value = np.concatenate([np.asarray(v, dtype=np.float64) for _, v in rows])
    starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
    return at, value, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[list[int], list[float]]], labels: list[int], *, rank: int = RANK, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss, adaptive gradient steps over batches of 32 rows, a fixed order of rows."""
    deal = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE), deal.normal(0, 0.02, (SIZE, rank)))
    if not rows:
        machine.factors[:] = 0
        return machine
    y = np.asarray(labels, dtype=np.float64)
    machine.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2), np.full((SIZE, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = deal.permutation(len(rows))
        for k in range(0, len(rows), 32):
            chosen = order[k : k + 32]
            at, value, starts = _packed([rows[i] for i in chosen])
            raw, sums = machine.raw(at, value, starts)
            error = (_sigmoid(raw) - y[chosen]) / len(chosen)
            counts = np.diff(np.r_[starts, len(at)])
            e = np.repeat(error, counts)
            cells, back = np.unique(at, return_inverse=True)
            gw = np.zeros(len(cells))
            np.add.at(gw, back, e * value)
            gv = np.zeros((len(cells), rank))
            np.add.at(gv, back, (e * value)[:, None] * (np.repeat(sums, counts, axis=0) - machine.factors[at] * value[:, None]))
            gw += decay * machine.weights[cells]
            gv += decay * machine.factors[cells]
            gb = float(error.sum())
            seen_w[cells] += gw**2
            seen_v[cells] += gv**2
            seen_b += gb**2
            machine.weights[cells] -= rate * gw / np.sqrt(seen_w[cells])
            machine.factors[cells] -= rate * 0.3 * gv / np.sqrt(seen_v[cells])
            machine.bias -= rate * gb / math.sqrt(seen_b)
    return machine


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 4 is 2 never teach; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAIN_ROWS, seed: int = 5) -> Machine:
    """Fit on a bounded sample of labelled rows that aren't held out: about ``rows``, dealt by hash.

    Null labels and ids teach nothing; of contradicting labels of an id the lower counts; repeated
    rows teach once, and where ids have many different rows, about 2 * ``rows`` of those are dealt
    by hash too. Without labels the model is neutral (0.5 for every text).
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("aw_label"))
    chosen = sample_of(known, ["doc_id"], rows)
    taught = docs.select("doc_id", "text", *METADATA).join(F.broadcast(chosen), "doc_id")  # about ``rows`` rows of two numbers
    taught = sample_of(taught, ["doc_id", "text"], 2 * rows).dropDuplicates()

    def make():
        def each(texts: list[str], *meta: list) -> list[tuple]:
            made = (features(t, m) for t, m in zip(texts, zip(*meta, strict=True), strict=True))
            return [(np.array(at, dtype=np.int32).tobytes(), np.array(value).tobytes()) for at, value in made]

        return each

    # As bytes, which are a tenth of what lists of numbers take on the driver.
    told = map_texts(taught, ["doc_id", "aw_label"], [("aw_at", "binary"), ("aw_value", "binary")], make, extra=METADATA, cache=CACHE)
    got = sorted(told.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["aw_at"]))
    return fit([(np.frombuffer(r["aw_at"], dtype=np.int32), np.frombuffer(r["aw_value"])) for r in got], [int(r["aw_label"] > 0) for r in got], seed=seed)


def scored(docs: DataFrame, machine: Machine, carry: list[str]) -> DataFrame:
    """The carried columns and ``aw_score``, from 0 to 1, of each whole text (null text: empty)."""

    def make():
        def each(texts: list[str], *meta: list) -> list[tuple]:
            raw, _ = machine.raw(*_packed([features(t, m) for t, m in zip(texts, zip(*meta, strict=True), strict=True)]))
            return [(float(x),) for x in _sigmoid(raw)]

        return each

    return map_texts(docs, carry, [("aw_score", "double")], make, extra=METADATA, cache=CACHE)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document.

    Inputs of a score are the text and n_chars alone. Null texts count as empty, a null n_chars has
    a cell of its own, repeated rows get equal scores, an empty table gives no rows.
    """
    machine = train(docs, labels, rows=rows)
    out = scored(docs, machine, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("aw_score").alias("score"), (F.col("aw_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    out = scored(docs, train(docs, labels, rows=rows), docs.columns)
    return out.filter(F.col("aw_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
