"""Equality is that of bytes: words built to collide in sums of powers, and doc_ids with several texts."""

import pytest

from tests.llm.test_dedup import brute_bytes, brute_components, brute_words, sha
from veriglyph.llm import minhash_dedup, sentencepiece_codec, substring_dedup, suffix_dedup


def morse(n: int, swap: bool = False) -> str:
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


def twins(n: int) -> dict[int, str]:
    words = [f"w{k}" for k in range(13)]
    out = {}
    for d in (1, 2):
        w = list(words)
        w[6] = morse(n, d == 2)
        out[d] = " ".join(w)
    return out | {3: morse(n), 4: morse(n, True)}


@pytest.mark.parametrize("n", [128, 1024, 4096])
def test_thue_morse_words_differ(spark, n):
    docs = twins(n)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_words(frame).collect()}
    assert got == brute_words(docs, 13) and got[2][1] == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_bytes(frame).collect()}
    assert got == brute_bytes(docs, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(frame).collect()}
    assert got == brute_components(docs) and all(v[2] for v in got.values())
    coded = {r.doc_id: list(r.ids) for r in sentencepiece_codec.tokenize(frame).collect()}
    back = sentencepiece_codec.detokenize(sentencepiece_codec.tokenize(frame).select("doc_id", "ids")).collect()
    assert {r.doc_id: r.text for r in back} == docs and coded[3] != coded[4]


def several() -> list[tuple[int, str]]:
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, other = say("alpha", 60), say("other", 260)
    return [(1, a), (5, say("before", 9) + " " + a), (5, other), (5, a + " " + say("after", 9)), (5, other), (7, other + " " + say("tail", 30)), (8, say("tail", 30)), (8, say("x", 3) + " " + say("tail", 30))]


@pytest.mark.parametrize("hot", [1, 2048])
def test_texts_of_one_doc_id_are_documents_each(spark, hot):
    rows = several()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for d, t in sorted(rows):
        w = t.split(" ")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, t in rows:
        w = t.split(" ")
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        want.append((d, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone).encode())))
    got = substring_dedup.removed_words(frame, hot=hot).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], d)
    want = []
    for d, t in rows:
        own, gone = {}, set()
        for i in range(len(t) - 99):
            s = t[i : i + 100]
            if first[s] < d or own.setdefault(s, i) < i:
                gone.update(range(i, i + 100))
        runs = sum(p - 1 not in gone for p in gone)
        want.append((d, len(t), len(gone), runs, sha("".join(c for p, c in enumerate(t) if p not in gone).encode())))
    got = suffix_dedup.removed_bytes(frame, hot=hot).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_windows_too_long_for_their_seeds_are_refused(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        substring_dedup.removed_words(frame, window=400, seed=5)
    with pytest.raises(ValueError):
        suffix_dedup.removed_bytes(frame, window=300)
