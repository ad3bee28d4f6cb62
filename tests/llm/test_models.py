import random
import zlib

from tests.llm.fixture import SCHEMA, documents
from veriglyph.llm import language_id, toxicity


def auc(rows) -> float:
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_language_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language_id.op10_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_languages_of_awkward_rows(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    got = language_id.predict(docs, model, ["doc_id", "score", "text"]).toDF("doc_id", "mine", "text", "lang_pred", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert r.lang_pred in {"und", *model.labels}
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.fit(empty) is None
    assert language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_language_isnt_read_from_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    model = language_id.fit(docs)
    a = language_id.predict(docs, model).collect()
    b = language_id.predict(docs.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source"), model).collect()
    assert sorted(a) == sorted(b)


def toxic_table(spark, n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "be", "cor", "du", "el", "fo"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for d in range(n):
        w = [word() for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["zorgle", "Vexxum", "krapt"])
        docs.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_toxicity(spark):
    docs, labels, truth = toxic_table(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[d], y) for d, y in truth.items() if d % 4 == 2]
    assert auc(held) > 0.97
    assert sum((s >= toxicity.THRESHOLD) == bool(y) for s, y in held) / len(held) > 0.95


def test_toxicity_of_awkward_rows(spark):
    docs, labels, _ = toxic_table(spark, 80)
    model = toxicity.fit(docs, labels)
    mine = documents(spark)
    got = toxicity.score(mine, model).collect()
    assert len(got) == mine.count() and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, 2), (1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    assert {r.score < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, odd)).collect()} == {True}
    only = toxicity.fit(docs, labels.withColumn("toxic", labels.toxic * 0 + 1))
    assert min(r.score for r in toxicity.score(docs, only).collect()) > 0.99
    twice = labels.union(spark.createDataFrame([(0, 1), (0, 0)], "doc_id long, toxic int"))
    assert toxicity.chosen_labels(twice)[0].filter("doc_id = 0").collect()[0].toxic == 1
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_query_over_the_table(spark, sf):
    got = toxicity.op5_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
