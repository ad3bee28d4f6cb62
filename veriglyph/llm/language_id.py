"""Operator 10, language identification: string kernels, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the mean over n = 1, 2, 3 of the cosine between the sets of n-grams (bytes; A-Z
lower-cased, other ASCII than letters one space) that are present in them. A text's kernel values with the
landmarks come from one matrix product for each batch of texts; one more product gives a score for each language,
by one-versus-rest ridge regression in the landmarks' span.

All labels are learnt, and all n-grams of the landmarks are the kernel's (others meet none of them). Bounds, all parameters, of
labelled rows alone: ``per_language`` training rows of each label, those with the smallest hashes (of about eight times as many drawn by hash), less where labels are so many
that ``sample`` rows would be passed (an error if there are more labels than that); ``landmarks`` of them, as many of each label,
drawn by a hash of their n-grams, are landmarks. Every whole text is scored.

Defined results: null or letterless text is ``und`` with score 0; without any labelled row every text is ``und``; rows with
null doc_id have held_out null and are scored; repeated rows are scored each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rolling import buffers, chunks, trim

PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 240, 16384, 256, 1e-4
ORDERS = (1, 2, 3)
#: Texts multiplied at a time, fewer if their presence would pass so many numbers.
BATCH, CELLS = 128, 1 << 23
#: N-grams of spaces alone, which tell nothing.
BLANK = {n: int.from_bytes(b" " * n, "big") for n in ORDERS}
#: A text resembles a label with this part of its training texts' share of known n-grams, less by DOUBT / sqrt(distinct n-grams).
LEAST_KNOWN, DOUBT, QUANTILE = 0.75, 4, 0.05


def _folded() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


FOLDED = _folded()


def grams(buf: np.ndarray, offsets: np.ndarray):
    """(n, codes, rows): each n-gram of each row, as an integer that also tells n."""
    x = FOLDED[buf].astype(np.uint32)
    length = offsets[1:] - offsets[:-1]
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)
    for n in ORDERS:
        if len(x) < n:
            return
        code = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | x[k : len(x) - n + 1 + k]
        inside = row[: len(code)] == row[n - 1 :]
        yield n, code[inside] if n > 1 else code, row[: len(code)][inside]


@dataclass
class Model:
    labels: list[str]
    vocabulary: list[np.ndarray]  # sorted codes for each order
    landmarks: np.ndarray  # (landmarks, vocabulary), scaled
    weights: np.ndarray  # (landmarks, labels)
    usual: np.ndarray  # (labels): the share of known n-grams that most training texts of a label exceed

    def tables(self) -> list[np.ndarray]:
        """For each order, each code's column or the count of columns."""
        if not hasattr(self, "_tables"):
            self._tables, at = [], 0
            for n, codes in zip(ORDERS, self.vocabulary, strict=True):
                table = np.full(1 << 8 * n, self.size, np.uint16 if self.size < 1 << 16 else np.int32)
                table[codes] = np.arange(at, at + len(codes))
                at += len(codes)
                self._tables.append(table)
        return self._tables

    @property
    def size(self) -> int:
        return sum(map(len, self.vocabulary))

    @property
    def batch(self) -> int:
        return max(1, min(BATCH, CELLS // (self.size + 1)))

    def presence(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The scaled sets: products of two rows are kernel values."""
        rows, width = len(offsets) - 1, self.size + 1
        out = np.zeros(rows * width, np.float32)
        for (_, code, row), table in zip(grams(buf, offsets), self.tables(), strict=False):
            out[row.astype(np.int64) * width + table[code]] = 1
        return scaled(out.reshape(rows, width)[:, :-1], self.vocabulary)

    def known(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the share of its n-grams that the vocabulary has, mean of the orders, and the number of distinct ones."""
        rows = len(offsets) - 1
        shares, distinct, orders = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for (n, code, row), table in zip(grams(buf, offsets), self.tables(), strict=False):
            some = code != BLANK[n]
            code, row = code[some], row[some].astype(np.int64)
            column, count = table[code], np.bincount(row, minlength=rows)
            inside = column < self.size
            shares += np.bincount(row[inside], minlength=rows) / np.maximum(count, 1)
            orders += count > 0
            held = np.zeros(rows * (self.size + 1), bool)
            held[row[inside] * (self.size + 1) + column[inside].astype(np.int64)] = True
            other = np.unique(row[~inside] << 32 | code[~inside].astype(np.int64)) >> 32
            distinct += held.reshape(rows, -1).sum(axis=1) + np.bincount(other, minlength=rows)
        return shares / np.maximum(orders, 1), distinct

    def resembles(self, buf: np.ndarray, offsets: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each row has about as many known n-grams as texts of its best label; few n-grams are a weak sign and need fewer."""
        share, distinct = self.known(buf, offsets)
        return share >= LEAST_KNOWN * self.usual[best] * (1 - DOUBT / np.sqrt(np.maximum(distinct, 1)))

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.presence(buf, offsets) @ self.landmarks.T @ self.weights


def scaled(x: np.ndarray, vocabulary: list[np.ndarray]) -> np.ndarray:
    at = 0
    x = np.ascontiguousarray(x)
    for codes in vocabulary:
        part = x[:, at : at + len(codes)]
        part *= (1 / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(ORDERS))).astype(np.float32)
        at += len(codes)
    return x


def _present(batches):
    """Each text's distinct n-grams, as 32-bit codes with their order in the top byte, and how often each occurs."""
    schema = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        found, often = [], []
        for i in range(batch.num_rows):
            parts = [(n, *np.unique(code, return_counts=True)) for n, code, _ in grams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))]
            found.append(np.concatenate([codes | np.uint32(n << 24) for n, codes, _ in parts]).tobytes() if parts else b"")
            often.append(np.concatenate([count for _, _, count in parts]).astype(np.int64).tobytes() if parts else b"")
        yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), pa.array(found, pa.binary()), pa.array(often, pa.binary())], schema=schema)


def _share(codes: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray) -> float:
    """The share of a text's n-grams that the vocabulary has, mean of the orders, as ``Model.known`` gives it."""
    shares = []
    for n in ORDERS:
        some = (codes >> 24 == n) & (codes != (n << 24 | BLANK[n]))
        if some.any():
            shares.append(counts[some & np.isin(codes, vocabulary)].sum() / counts[some].sum())
    return float(np.mean(shares)) if shares else 0.0


def sampled(known: DataFrame, per_language: int, sample: int) -> DataFrame:
    """(lang, text) of the training rows: of each label those of smallest hash, equal rows once. Only keys are sorted; texts stay where they are."""
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(sample + 1).collect()}
    if len(sizes) > sample:
        raise ValueError(f"there are more labels than sample = {sample}")
    each = max(1, min(per_language, sample // max(1, len(sizes))))
    # of a label's rows about eight times as many as are wanted, those of smallest hash, go on: so no label is sorted whole
    cuts = [(lang, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 8 * each / n)))) for lang, n in sizes.items()]
    cuts = F.broadcast(known.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    near = known.join(cuts, "lang").filter(F.xxhash64("doc_id") <= F.col("cut"))
    keys = near.select("lang", "doc_id", F.xxhash64("text").alias("version")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "version")
    chosen = keys.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).drop("k")  # ``sample`` rows at most
    rows = known.withColumn("version", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "version"])
    return rows.dropDuplicates(["lang", "doc_id", "version"]).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the rows' ``lang``. Only bounded samples reach the driver."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    found = sampled(known, per_language, sample).mapInArrow(_present, "lang string, codes binary, counts binary").collect()
    if not found:
        return None
    rows = [(r.lang, np.frombuffer(r.codes, np.uint32), np.frombuffer(r.counts, np.int64)) for r in found]
    rows.sort(key=lambda r: (r[0], hashlib.blake2b(r[1].tobytes()).digest(), r[2].tobytes()))
    labels = sorted({r[0] for r in rows})
    each, marks = max(1, landmarks // len(labels)), []
    for label in labels:
        marks += [k for k, r in enumerate(rows) if r[0] == label][:each]
    codes = np.unique(np.concatenate([rows[k][1] for k in marks]))
    split = [codes[codes >> 24 == n] & np.uint32(0xFFFFFF) for n in ORDERS]
    marked = scaled(_rows_of([rows[k][1] for k in marks], codes), split)
    step = max(1, CELLS // max(1, len(codes)))
    k_nm = np.concatenate([scaled(_rows_of([r[1] for r in rows[i : i + step]], codes), split) @ marked.T for i in range(0, len(rows), step)]).astype(np.float64)
    k_mm = (marked @ marked.T).astype(np.float64)
    y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(labels), 1.0, -1.0)
    weights = np.linalg.lstsq(k_nm.T @ k_nm + ridge * len(rows) * k_mm + 1e-8 * np.eye(len(marks)), k_nm.T @ y, rcond=None)[0]
    shares = [[_share(present, counts, codes) for label, present, counts in rows if label == x and len(present)] for x in labels]
    return Model(labels, split, marked, weights.astype(np.float32), np.array([np.quantile(s, QUANTILE) if s else 0.0 for s in shares]))


def _rows_of(present: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(texts, codes): which n-grams each text has."""
    x = np.zeros((len(present), len(codes)), np.float32)
    for k, p in enumerate(present):
        at = np.searchsorted(codes, p)
        at[at == len(codes)] = 0
        x[k, at[codes[at] == p]] = 1
    return x


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, resemblance: bool = False) -> DataFrame:
    """The columns ``keep`` (default doc_id), then lang_pred and score, for each row; with ``resemblance`` also ``resembles``, false for texts unlike all that was learnt."""
    keep = ["doc_id"] if keep is None else keep
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *[F.lit(False).alias("resembles")] * resemblance)
    rows = docs.select(*[F.col(f"`{k}`").alias(f"c{n}") for n, k in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("text_")]), letters.alias("letters_"))
    source = f"c{keep.index('text')}" if "text" in keep else "text_"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{n}" for n in range(len(keep))]
    out = ["lang_pred", "score", *["resembles"] * resemblance]

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(source))
            found, like = [], []
            for i, j in chunks(offsets):
                for a in range(i, j, model.batch):
                    b = min(j, a + model.batch)
                    part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    found.append(model.score(*part))
                    if resemblance:
                        like.append(model.resembles(*part, found[-1].argmax(axis=1)))
            f = np.concatenate(found) if found else np.zeros((0, len(model.labels)))
            letter = batch.column("letters_").to_numpy(zero_copy_only=False).astype(bool)
            label = np.where(letter, np.array([*model.labels], dtype=object)[f.argmax(axis=1)], "und")
            score = np.where(letter, np.clip((f.max(axis=1).astype(np.float64) + 1) / 2, 0, 1), 0.0)
            more = [pa.array(letter & np.concatenate([np.zeros(0, bool), *like]))] if resemblance else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(label, pa.string()), pa.array(score), *more], names=[*names, *out])
            trim()
        vars(model).pop("_tables", None)  # workers outlive their tasks
        trim()

    kinds = ", ".join(f"c{n} {rows.schema[f'c{n}'].dataType.simpleString()}" for n in range(len(keep)))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double" + ", resembles boolean" * resemblance).toDF(*keep, *out)


def held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(5, 0)))
    return predict(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
