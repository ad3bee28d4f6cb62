"""Operators 5 and 10 against plain Python over sets of n-grams, and operator 9 on long runs."""

import hashlib
import re
import time

import numpy as np
import pytest

from tests.llm.fixture import distinct, documents
from tests.llm.test_models import auc, toxic_table
from veriglyph.llm import durable, language_id, sentencepiece_codec, toxicity


def toxic_grams(text: str) -> set:
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    folded = re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", b" ", low)
    return {folded[i : i + n] for n in (3, 4, 5) for i in range(len(folded) - n + 1)}


def number(gram: bytes) -> int:
    return int.from_bytes(gram, "big") | len(gram) << 40


def test_toxicity_equals_sums_over_sets(spark):
    docs, labels, _ = toxic_table(spark, 120)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    ratio = dict(zip(model.features.tolist(), model.ratios.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()} | {1000 + k: v for k, v in distinct().items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        mine = [number(g) for g in toxic_grams(texts[r.doc_id]) if number(g) in weight]
        total = model.bias + sum(weight[g] for g in mine) / max(sum(ratio[g] ** 2 for g in mine), 1e-12) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-6


def test_ratios_and_weights_are_those_of_dense_matrices(spark):
    docs, labels, truth = toxic_table(spark, 120)
    texts = {r.doc_id: toxic_grams(r.text) for r in docs.collect()}
    names = sorted({g for s in texts.values() for g in s}, key=number)
    x = np.array([[g in texts[d] for g in names] for d in sorted(texts)], float)
    y = np.array([truth[d] for d in sorted(texts)], float)
    p, n = x[y == 1].sum(axis=0) + 1, x[y == 0].sum(axis=0) + 1
    r = np.log(p / p.sum()) - np.log(n / n.sum())
    model = toxicity.fit(docs, labels, rounds=600, folds=0)
    assert model.features.tolist() == [number(g) for g in names]
    w, b = np.where(r == 0, 0, model.weights / np.where(r == 0, 1, r)), model.bias
    assert np.allclose(model.ratios, r)
    z = x * r / np.linalg.norm(x * r, axis=1, keepdims=True)
    g = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = z.T @ g / len(y) + toxicity.PENALTY / len(y) * w  # zero at the optimum
    start = z.T @ (y.mean() - y) / len(y)
    assert np.linalg.norm(slope) < 0.02 * np.linalg.norm(start)


def test_toxicity_of_the_table_is_learnt(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, truth[r.doc_id]) for r in toxicity.op5_toxicity(spark, folder).collect() if r.held_out and truth.get(r.doc_id) in (0, 1)]
    assert len({y for _, y in rows}) == 2 and auc(rows) > 0.85


def language_grams(text: str) -> dict[int, set]:
    folded = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalpha() else 32 for c in text.encode())
    return {n: {folded[i : i + n] for i in range(len(folded) - n + 1)} for n in (1, 2, 3)}


def test_language_scores_equal_kernels_over_sets(spark):
    docs = documents(spark)
    model = language_id.fit(docs, landmarks=12)
    at, names = 0, {}
    for n, codes in zip((1, 2, 3), model.vocabulary, strict=True):
        names[n] = {int(c).to_bytes(n, "big"): at + k for k, c in enumerate(codes)}
        at += len(codes)
    marks = [{n: {g for g, k in names[n].items() if m[k] > 0} for n in (1, 2, 3)} for m in model.landmarks]
    got = {(r.doc_id, r.text): r for r in language_id.predict(docs, model, ["doc_id", "text"]).collect()}
    assert set().union(*names.values()) == set().union(*(g for m in marks for g in m.values()))
    for (_, text), r in got.items():
        mine = language_grams(text or "")
        mine = {n: mine[n] & names[n].keys() for n in (1, 2, 3)}
        kernel = [sum(len(mine[n] & m[n]) / max(1, len(mine[n]) * len(m[n])) ** 0.5 for n in (1, 2, 3)) / 3 for m in marks]
        f = np.array(kernel) @ model.weights
        if r.lang_pred != "und":
            assert abs(r.score - min(max((f.max() + 1) / 2, 0), 1)) < 1e-3
            assert f[model.labels.index(r.lang_pred)] > f.max() - 1e-3


def test_every_label_is_learnt(spark):
    rows = [(k, f"{chr(0x4E00 + k % 90) * 20} {k}", f"l{k % 90:02d}") for k in range(360)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert len(model.labels) == 90
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame, model).collect()}
    assert all(got[k] == lang for k, _, lang in rows)
    with pytest.raises(ValueError):
        language_id.fit(frame, sample=50)


def test_model_does_not_depend_on_partitions(spark):
    docs = documents(spark)
    a, b = language_id.fit(docs.repartition(3)), language_id.fit(docs.repartition(7, "text"))
    assert np.array_equal(a.landmarks, b.landmarks) and np.array_equal(a.weights, b.weights)


def test_long_runs_of_spaces_and_unspaced_texts():
    import sentencepiece

    voc = sentencepiece_codec.Vocabulary(sentencepiece_codec.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    texts = [" " * n + "x" for n in (1, 2, 3, 7, 15, 16, 17, 33, 100, 501)]
    texts += ["abcdefghijklmnopqrstuvwxyz" * 20, "ab" * 300, "中文字符和汉语" * 60, "x" * 500, "".join(chr(97 + int(hashlib.md5(str(k).encode()).hexdigest(), 16) % 26) for k in range(3000))]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, at = sentencepiece_codec.encode_batch(voc, np.frombuffer(data, np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t)
    began = time.time()
    voc.run(100_000)
    assert time.time() - began < 10


def test_checkpoints_need_a_shared_folder_off_one_machine(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class C:
                    @staticmethod
                    def getCheckpointDir():
                        class D:
                            @staticmethod
                            def isEmpty():
                                return True

                        return D

                return C

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        durable.ready(Session)
