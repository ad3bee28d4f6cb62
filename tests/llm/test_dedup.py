import hashlib
import re

import numpy as np
import pytest

from tests.llm.fixture import SCHEMA, distinct, documents
from veriglyph.llm import minhash_dedup, substring_dedup, suffix_dedup
from veriglyph.llm.durable import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def brute_words(docs: dict[int, str], window: int) -> dict:
    words, first = {d: SPACE.findall(t) for d, t in docs.items()}, {}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = {p for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for p in range(i, i + window)}
        out[d] = (len(ws), len(gone), sha(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()))
    return out


def brute_bytes(docs: dict[int, str], window: int) -> dict:
    data, first = {d: t.encode() for d, t in docs.items()}, {}
    out = {}
    for d in sorted(docs):
        gone = np.zeros(len(data[d]), bool)
        for i in range(len(data[d]) - window + 1):
            if first.setdefault(data[d][i : i + window], (d, i)) != (d, i):
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[d] = (len(data[d]), int(gone.sum()), runs, sha(np.frombuffer(data[d], np.uint8)[~gone].tobytes()))
    return out


def brute_components(docs: dict[int, str]) -> dict:
    sets = {}
    for d, t in docs.items():
        ws = SPACE.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


@pytest.mark.parametrize("seed,hot", [(3, 2048), (4, 1)])
def test_substring_dedup_equals_brute_force(spark, seed, hot):
    got = substring_dedup.removed_words(documents(spark, seed), hot=hot).collect()
    want = brute_words(distinct(seed), 13)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert len(got) == len(want) + 1  # the row that comes twice
    assert any(v[1] for v in want.values())


@pytest.mark.parametrize("seed,hot", [(3, 2048), (4, 1)])
def test_suffix_dedup_equals_brute_force(spark, seed, hot):
    got = suffix_dedup.removed_bytes(documents(spark, seed), hot=hot).collect()
    want = brute_bytes(distinct(seed), 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert any(v[1] for v in want.values())


def test_other_windows(spark):
    docs = distinct(5)
    got = suffix_dedup.removed_bytes(documents(spark, 5), window=24, seed=8, gram=6).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {d: v[3] for d, v in brute_bytes(docs, 24).items()}
    got = substring_dedup.removed_words(documents(spark, 5), window=6, seed=2).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {d: v[2] for d, v in brute_words(docs, 6).items()}
    with pytest.raises(ValueError):
        suffix_dedup.removed_bytes(documents(spark), window=100, gram=7)


def test_kept_texts_are_whole_characters(spark):
    for r in suffix_dedup.removed_bytes(documents(spark), texts=True).collect():
        assert sha(bytes(r.kept)) == r.kept_sha256
        assert len(r.text.encode()) >= len(r.kept)
        assert sum(b - a for a, b in r.spans) == r.n_removed
    for r in substring_dedup.removed_words(documents(spark), texts=True).collect():
        assert sha(r.kept.encode()) == r.kept_sha256


def test_collection_orders_suffixes():
    rng = np.random.default_rng(0)
    strings = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    symbols = np.concatenate(strings)
    ends = np.cumsum([len(s) for s in strings])
    where, lcp = suffix_dedup.collection(symbols, ends - 1, np.array([len(s) for s in strings]), 1)
    suffix = {p: tuple(symbols[p:e]) for s, e in zip(strings, ends, strict=True) for p in range(e - len(s), e)}
    listed = [suffix[p] for p in where]
    assert sorted(where) == list(range(len(symbols)))
    assert listed == sorted(listed)
    for k in range(1, len(listed)):
        a, b = listed[k - 1], listed[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 255)


@pytest.mark.parametrize("seed", [3, 4])
def test_minhash_equals_all_pairs(spark, seed):
    got = minhash_dedup.near_components(documents(spark, seed)).collect()
    want = brute_components(distinct(seed))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Chains around a hub that isn't linked with all, in blocks."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(140)]
    docs = {}
    for d in range(90):
        w = list(base)
        for k in rng.sample(range(140), rng.randint(0, 9)):
            w[k] = f"v{d}-{k}"
        docs[d] = " ".join(w)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for small, block in ((64, 1024), (2, 16)):
        monkeypatch.setattr(minhash_dedup, "SMALL", small)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = minhash_dedup.near_components(frame).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(docs)


def test_b_bit_estimate_is_corrected():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        estimates = []
        for _ in range(20):
            n = 400
            both = rng.integers(0, 2**63, int(n * 2 * share / (1 + share)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            m = minhash_dedup.minima(np.concatenate([a, b]), np.array([0, len(a)]))
            packed = ((m[:, ::2] & 15) | (m[:, 1::2] & 15) << 4).astype(np.uint8).view(np.uint64)
            estimates.append(minhash_dedup.similarity(minhash_dedup.matches(packed[0], packed[1])))
        assert abs(np.mean(estimates) - share) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (20, 21), (22, 21), (30, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 9), 1), **dict.fromkeys((20, 21, 22), 20)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.removed_words(empty).count() == 0
    assert suffix_dedup.removed_bytes(empty).count() == 0
    assert minhash_dedup.near_components(empty).count() == 0
