import corpus_pipeline
from tests.llm.fixture import SCHEMA, documents, rows
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import benchmark, brute
from veriglyph.llm import queries
from veriglyph.llm.suffix_dedup import whole_characters


def spans(docs):
    """Removed runs of 100-byte strings that also start earlier."""
    first, out = {}, {}
    for d in sorted(docs):
        data, gone = docs[d].encode(), []
        for i in range(len(data) - 99):
            if first.setdefault(data[i : i + 100], (d, i)) != (d, i):
                if gone and i <= gone[-1][1]:
                    gone[-1][1] = i + 100
                else:
                    gone.append([i, i + 100])
        out[d] = [tuple(g) for g in gone]
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    frame, items = benchmark(spark)
    frame.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "exact_dedup", "decontaminate", "tokenize"]
    kept = stage["language_id"](spark, docs, str(tmp_path)).cache()
    assert kept.columns == names
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows())
    texts = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    near = stage["near_dedup"](spark, kept, str(tmp_path)).cache()
    assert near.columns == names
    want = {d for d, (_, _, ok) in brute_components(texts).items() if ok}
    assert {r.doc_id for r in near.collect()} == want
    texts = {d: texts[d] for d in want}
    exact = stage["exact_dedup"](spark, near, str(tmp_path)).cache()
    assert exact.columns == names
    gone = spans(texts)
    texts = {d: whole_characters(t.encode(), gone[d]).decode() for d, t in texts.items()}
    assert {r.doc_id: r.text for r in exact.collect()} == texts
    assert any(gone.values()) and all(r.n_chars == len(r.text) for r in exact.collect())
    clean = stage["decontaminate"](spark, exact, str(tmp_path)).cache()
    assert clean.columns == names
    want = {d for d, v in brute(texts, items).items() if not v[4]}
    assert {r.doc_id for r in clean.collect()} == want and len(want) < len(texts)
    coded = stage["tokenize"](spark, clean, str(tmp_path)).collect()
    assert {r.doc_id for r in coded} == want and all(r.n_tokens == len(r.ids) for r in coded)


def test_texts_in_unlearnt_scripts_go(spark, sf):
    names = ["doc_id", "text", "lang"]
    clean = spark.read.parquet(f"{sf}/documents.parquet").select(*names)
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю", "我们在北京的大学里学习中文和历史", "Η γλώσσα αυτή δεν διδάχθηκε ποτέ", "привет", "שלום לכולם, מה שלומכם היום", "булок " * 3000]
    added = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(foreign)], clean.schema)
    got = {r.doc_id for r in corpus_pipeline.identify(spark, clean.union(added), sf).collect()}
    assert got == {r.doc_id for r in clean.collect() if any(c.isalpha() for c in r.text or "")}


def test_rows_of_one_doc_id_are_documents_each(spark):
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    long, short, other = say("long", 200), say("short", 6), say("other", 50)
    shared = say("shared", 40)
    docs = [(1, long), (1, long), (1, short), (2, short), (2, other), (2, other), (3, f"{other} {shared}"), (4, long), (5, shared + " " + say("tail", 9)), (5, "x")]
    frame = spark.createDataFrame([(d, t, "en") for d, t in docs], "doc_id long, text string, lang string").repartition(3)
    near = corpus_pipeline.near_dedup(spark, frame, "")
    want = [(1, long), (1, short), (2, other), (3, f"{other} {shared}"), (5, shared + " " + say("tail", 9)), (5, "x")]
    assert near.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted(want)
    exact = corpus_pipeline.exact_dedup(spark, near, "")
    assert exact.columns == frame.columns
    order = dict(enumerate(t for _, t in sorted(want)))
    left = {k: whole_characters(t.encode(), spans(order)[k]).decode() for k, t in order.items()}
    got = sorted((r.doc_id, r.text) for r in exact.collect())
    assert left != order and got == sorted((d, left[k]) for k, (d, _) in enumerate(sorted(want)))


def test_stages_take_empty_tables(spark, tmp_path):
    benchmark(spark)[0].write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
