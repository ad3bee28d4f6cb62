import random
import zlib

import numpy as np

from tests.llm.fixture import SCHEMA, documents
from veriglyph.llm import permutation_index as index
from veriglyph.llm import sharding


def vectors(spark, n=1500, dim=16):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.5
    rows = [(k, [float(v) for v in x[k]], "extra") for k in range(n)]
    rows[7] = (7, None, "e")
    rows[20] = (20, [0.0] * dim, "e")
    rows[21] = (21, [float("nan")] * dim, "e")
    rows[22] = (22, [*rows[22][1][:-1], None], "e")
    rows[23] = (23, [float("inf"), *rows[23][1][1:]], "e")
    rows[24] = (24, [1.0], "e")
    rows[41] = (41, rows[40][1], "e")  # ties
    rows[42] = (42, rows[40][1], "e")
    rows.append((None, rows[1][1], "e"))
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), rows


def brute(rows, k=20):
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(np.dot(x, y)), i) for i, y in ok if i != q))[:k]
    return out


def test_recall_and_scores(spark):
    frame, rows = vectors(spark)
    want, got = brute(rows), {}
    for r in index.nearest(frame.repartition(3)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hit = 0
    by = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v}
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        assert all(abs(s - float(by[q] @ by[i])) < 1e-9 for i, s in found.values())
        assert [s for _, (_, s) in sorted(found.items())] == sorted((s for _, s in found.values()), reverse=True)
        hit += len({i for i, _ in found.values()} & {i for _, i in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_everything_reranked_is_exact(spark):
    frame, rows = vectors(spark, 300)
    got = {(r.query_id, r.rank): r.vec_id for r in index.brute_force(frame).collect()}
    assert got == {(q, k + 1): i for q, found in brute(rows).items() for k, (_, i) in enumerate(found)}


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.5, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in index.nearest(few).collect())
    assert got == [(0, 1, 20), (0, 2, 5), (20, 1, 5), (20, 2, 0)]
    assert index.nearest(few.limit(0)).count() == 0
    assert index.nearest(few.filter("vec_id = 0")).count() == 0


def least_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def test_summary_finds_the_least_capacity():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 60) ** rng.randint(1, 2) for _ in range(rng.randint(1, 80))]
        shards = rng.randint(1, 16)
        summary = sharding.Summary([(f"{k:04x}", s, s, 1) for k, s in enumerate(sizes)])
        want = least_capacity(sizes, shards)
        assert summary.least(shards) == want
        cuts = [0, *summary.even(shards)[0], sum(sizes)]
        assert len(cuts) == shards + 1 and max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)) <= want


def test_shards(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    place = {}
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        assert place.setdefault((r.size, r.text_crc32), r.shard) == r.shard  # groups stay together
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_a_group_of_a_third_leaves_no_shard_empty(spark):
    """Cuts lie within the least capacity, each near to an equal share of what is left."""
    docs = spark.createDataFrame([(k, "hot" * 20 if k % 3 == 0 else f"{k} " * 8) for k in range(3000)], "doc_id long, text string")
    total = {}
    for r in sharding.shard(docs).collect():
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert sorted(total) == list(range(16)) and max(total.values()) >= 61 * 1000
    others = sorted(total.values())[:-1]
    assert others[0] > 0.5 * others[-1]


def test_shards_by_zooming_equal_those_of_all_groups(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, "x" * rng.randint(1, 90) + str(k % 2500)) for k in range(3000)], "doc_id long, text string")
    groups = {}
    import hashlib

    for r in docs.collect():
        k = hashlib.md5(r.text.encode()).hexdigest()
        groups[k] = groups.get(k, 0) + len(r.text) + 1
    want = least_capacity([groups[k] for k in sorted(groups)], 16)
    total = {}
    for r in sharding.shard(docs).collect():
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) <= want and len(total) == 16
    assert min(total.values()) > 0.9 * want
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
