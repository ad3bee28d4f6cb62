"""Operator 5, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are all the n-grams (n = 3, 4, 5 bytes; A-Z lower-cased, runs of other ASCII than letters and digits
one space) that are present in it. Counting how many toxic and other training texts hold each gives its ratio r. A text's vector
is presence times r over every n-gram that a training text has, brought to length 1 so that long texts say no more than short
ones; logistic regression with an L2 penalty is fitted to these by L-BFGS. Its scores of texts that it hasn't seen are less extreme
than those of its own texts, so slope and intercept are set again on scores across ``folds`` of the training rows. N-grams are told by their bytes: the table that finds
them compares them.

Bounds, all parameters, of labelled rows alone: counts and weights are learnt from about ``sample`` labelled rows of each class,
those with the smallest hashes of doc_id. Every whole text is scored.

Defined results: null or empty text has no n-grams and gets the intercept's score; labels that are null or not 0/1,
and labels without a document, are not learnt from; two labels of a document count once, as the larger; texts that share a
labelled doc_id are a training text each; with labels of one class only, every score is that class; without any, 0; rows with
null doc_id have held_out null and are scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import cut
from .language_id import held_out
from .rolling import buffers, chunks, mix, trim

SAMPLE, SMOOTH, PENALTY, THRESHOLD, ROUNDS, FOLDS = 2000, 1.0, 0.01, 0.3, 100, 3
ORDERS, TINY, STEP = (3, 4, 5), 1e-12, 1 << 20


def _folded() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[48:58] = np.arange(48, 58)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


FOLDED = _folded()


def grams(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, offsets of the rows in them) for each order: an n-gram's bytes as a number, with n above them; runs of spaces count as one."""
    x = FOLDED[buf]
    length = offsets[1:] - offsets[:-1]
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)
    if not len(x):
        return
    keep = x != 32
    keep[1:] |= (x[:-1] != 32) | (row[1:] != row[:-1])
    keep[0] = True
    x, row = x[keep].astype(np.int64), row[keep]
    code = x
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            return
        code = code[:-1] << 8 | x[n - 1 :]
        if n in ORDERS:
            inside = row[: len(code)] == row[n - 1 :]
            yield code[inside] | n << 40, np.searchsorted(row[: len(code)][inside], np.arange(len(offsets)))


@dataclass
class Model:
    features: np.ndarray  # n-grams, sorted
    ratios: np.ndarray
    weights: np.ndarray  # times the ratios already
    bias: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def find(self, code: np.ndarray) -> np.ndarray:
        """Each n-gram's number, or -1: slots of a table are tried from the n-gram's own on, until it or a free one is met."""
        if not hasattr(self, "_codes"):
            bits = max(4, int(8 * len(self.features)).bit_length())
            self._shift, self._codes, self._numbers = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            left, at = np.arange(len(self.features)), self._slot(self.features)
            while len(left):
                free = self._codes[at] < 0
                self._codes[at[free]] = self.features[left[free]]  # of several for one slot the last stays
                got = self._codes[at] == self.features[left]
                self._numbers[at[got]] = left[got]
                left, at = left[~got], (at[~got] + 1) & (len(self._codes) - 1)
        at = self._slot(code)
        held = self._codes[at]
        out = np.where(held == code, self._numbers[at], -1)
        todo = np.flatnonzero((held != code) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self._codes) - 1)
            held = self._codes[at]
            hit = held == code[todo]
            out[todo[hit]] = self._numbers[at[hit]]
            go = ~hit & (held >= 0)
            todo, at = todo[go], at[go]
        return out

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (mix(code.view(np.uint64)) >> self._shift).astype(np.int64)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, length = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        if len(self.features):
            if not hasattr(self, "_last"):
                self._last = np.zeros(len(self.features), np.int32)
            for code, at in grams(buf, offsets):
                number = self.find(code)
                known = np.flatnonzero(number >= 0)
                number, at = number[known], np.searchsorted(known, at)
                turn = np.arange(len(number), dtype=np.int32)
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if a < b:  # each n-gram counts once, where it was seen last
                        own = number[a:b]
                        self._last[own] = turn[a:b]
                        own = own[self._last[own] == turn[a:b]]
                        total[r] += self.weights[own].sum()
                        length[r] += (self.ratios[own] ** 2).sum()
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(length, TINY)) + self.bias, -50, 50)))


def chosen_labels(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of about ``sample`` labelled documents of each class, by a uniform hash of doc_id; and the classes' sizes."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("toxic") == k, min(1.0, sample / n)).otherwise(share)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40)), sizes


def _present(batches):
    """Each training text's distinct n-grams."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        codes = []
        for i in range(batch.num_rows):
            parts = [np.unique(code) for code, _ in grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))]
            codes.append(np.concatenate(parts).tobytes() if parts else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(codes, pa.binary())], names=["doc_id", "toxic", "codes"])


def ratios(number: np.ndarray, offsets: np.ndarray, y: np.ndarray, features: int, smooth: float) -> np.ndarray:
    """Each feature's log-count ratio: of its share in toxic texts to that in others; 0 of those that no text has."""
    p, n = (_back((y == k).astype(float), number, offsets, features) for k in (1, 0))
    return np.where(p + n > 0, np.log((p + smooth) / (p + smooth).sum()) - np.log((n + smooth) / (n + smooth).sum()), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, smooth: float = SMOOTH, penalty: float = PENALTY, rounds: int = ROUNDS, folds: int = FOLDS) -> Model:
    """A model of labels (doc_id, toxic). The chosen labels are broadcast (some 2 x ``sample`` rows), so that texts aren't
    shuffled; the training texts' n-grams reach the driver, where the regression runs."""
    known, sizes = chosen_labels(labels, sample)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(known)), "doc_id")
    got = train.select("doc_id", "text", "toxic").mapInArrow(_present, "doc_id long, toxic int, codes binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("codes", "ascending")]).combine_chunks()
    y = got.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 50.0 if len(y) and y[0] else -50.0)
    data, at = buffers(got.column("codes"))
    codes, offsets = data[at[0] : at[-1]].view(np.int64), (at - at[0]) // 8
    features = np.unique(codes)
    number = np.concatenate([np.searchsorted(features, codes[i : i + STEP]).astype(np.int32) for i in range(0, len(codes), STEP)] or [np.zeros(0, np.int32)])
    del got, data, codes
    trim()
    # classes were sampled at their own shares: weights bring back the rates of all labelled rows
    share = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    share *= len(y) / share.sum()

    def trained(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Ratios, weights and intercept."""
        mine, at = _of(rows, number, offsets)
        r = ratios(mine, at, y[rows], len(features), smooth)
        return r, *_logistic(mine, at, r, y[rows], share[rows], penalty, rounds)

    r, w, b = trained(np.arange(len(y)))
    slope, more = 1.0, 0.0
    fold = np.arange(len(y)) % max(1, folds)
    if folds > 1 and all(0 < y[fold != f].sum() < (fold != f).sum() for f in range(folds)):
        seen = np.zeros(len(y))
        for f in range(folds):
            r_f, w_f, b_f = trained(np.flatnonzero(fold != f))
            rest = np.flatnonzero(fold == f)
            mine, at = _of(rest, number, offsets)
            seen[rest] = _sums(w_f * r_f, mine, at) / np.sqrt(np.maximum(_sums(r_f * r_f, mine, at), TINY)) + b_f

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            z = x[0] * seen + x[1]
            g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
            return float(np.mean(share * (np.logaddexp(0, z) - y * z))), np.array([np.mean(g * seen), g.mean()])

        slope, more = minimum(loss, np.array([1.0, 0.0]), 100)
        if slope <= 0:
            slope, more = 1.0, 0.0
    return Model(features, r, slope * w * r, float(slope * b + more))


def _of(rows: np.ndarray, number: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows' features, and the rows' offsets in them."""
    size = np.diff(offsets)
    some = np.zeros(len(size), bool)
    some[rows] = True
    return number[np.repeat(some, size)], np.concatenate([[0], np.cumsum(size[rows])])


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about STEP features together."""
    cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, offsets[-1], STEP)), len(offsets) - 1))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _sums(x: np.ndarray, number: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of x over each row's features."""
    out = np.zeros(len(offsets) - 1)
    for i, j in _steps(offsets):
        some = i + np.flatnonzero(np.diff(offsets[i : j + 1]))
        if len(some):
            out[some] = np.add.reduceat(x[number[offsets[i] : offsets[j]]], offsets[some] - offsets[i], dtype=np.float64)
    return out


def _back(g: np.ndarray, number: np.ndarray, offsets: np.ndarray, features: int) -> np.ndarray:
    """For each feature the sum of g over the rows that have it."""
    out = np.zeros(features)
    for i, j in _steps(offsets):
        out += np.bincount(number[offsets[i] : offsets[j]], weights=np.repeat(g[i:j], np.diff(offsets[i : j + 1])), minlength=features)
    return out


def _logistic(number: np.ndarray, offsets: np.ndarray, scale: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression over rows' features, each of its scale, rows of length 1: weights and intercept."""
    n = len(y)
    norm = 1 / np.sqrt(np.maximum(_sums(scale * scale, number, offsets), TINY))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss and its slope; the intercept is the last weight."""
        z = _sums(w[:-1] * scale, number, offsets) * norm + w[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        slope = _back(g * norm, number, offsets, len(scale)) * scale / n + penalty / n * w[:-1]
        return float(np.mean(share * (np.logaddexp(0, z) - y * z))) + penalty / n / 2 * float(w[:-1] @ w[:-1]), np.append(slope, g.mean())

    w = minimum(loss, np.append(np.zeros(len(scale)), np.log((share * y).sum() / (share * (1 - y)).sum())), rounds)
    return w[:-1], float(w[-1])


def minimum(loss, w: np.ndarray, rounds: int, memory: int = 6, least: float = 1e-6) -> np.ndarray:
    """Where a smooth convex function (of value and slope) is least, by limited-memory BFGS in at most ``rounds`` evaluations."""
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    rounds -= 1
    while rounds > 0:
        way, parts = slope.copy(), []
        for s, t, r in reversed(steps):
            parts.append(float(s @ way) / r)
            way -= parts[-1] * t
        way *= steps[-1][2] / float(steps[-1][1] @ steps[-1][1]) if steps else 1 / max(float(np.linalg.norm(slope)), TINY)
        for (s, t, r), part in zip(steps, reversed(parts), strict=True):
            way += (part - float(t @ way) / r) * s
        far = 1.0
        while True:
            near = w - far * way
            now, turn = loss(near)
            rounds -= 1
            if now <= value - 1e-4 * far * float(slope @ way) or rounds <= 0:
                break
            far /= 4
        if now >= value:
            return w
        s, t = near - w, turn - slope
        if float(s @ t) > TINY:
            steps = [*steps[1 - memory :], (s, t, float(s @ t))]
        done = value - now < least * abs(value)
        w, value, slope = near, now, turn
        if done:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found = [np.zeros(0)]
            for i, j in chunks(offsets):
                found.append(model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.filter(~held_out(4, 2)))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
