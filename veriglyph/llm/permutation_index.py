"""Operator 4, approximate nearest neighbours: permutation index.

Pivots are drawn from a bounded sample of the vectors' directions. A vector is represented by its ``prefix`` nearest pivots in order.
The index is dealt by the nearest of the first few pivots, whose number grows with the root of the number of vectors, and by
band of length (a band spans a factor of the square root of 2, so that directions decide inside one); each such *list* has its
vectors posted, with their places, in inverted files of all pivots in their prefixes. A query goes to the ``probes`` lists that promise most
(the largest product to be expected of as many vectors as the list has, by its length, the cosine of query and pivot and
the usual cosine of vectors and their list's pivot), walks the files of its own nearest pivots there, sums the footrule distance
|place in the query's order - place in the vector's order|, a pivot missing from a prefix counting as place ``prefix``,
and the ``share`` of each list that is nearest by footrule (and ``k`` + 1 more) is reranked by inner product on the original vectors.

``probes`` and ``share`` aren't guessed: a bounded sample of queries is answered by brute force over all vectors, in one pass; a second one
ranks those true neighbours by footrule in their lists. The fewest lists that hold ``target`` of them are probed, and the least
share that holds ``target`` of them is reranked. So lengths and directions of any spread reach that recall, at the cost that they need.

Equal vectors are one in the index, with the smallest ``k`` + 1 of their vec_ids, which is all that ties can ask for; equal queries are
one too. Lists of more than ``BLOCK`` vectors or ``QUERIES`` queries are cut into blocks of at most about these, so a task holds
one block of each at a time whatever is common.

Contract of ``nearest``: queries are vectors whose vec_id is divisible by ``every``, candidates all others of the vectors that
take part; the k of largest inner product in double precision, ties to the smaller vec_id.

Defined results: vectors null, zero, of other length than most, or with null or non-finite components take no part, and
neither do null vec_ids; a vec_id that comes twice is two vectors, neither a candidate for the other; fewer candidates than
k give as many rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import cut

K, EVERY = 20, 20
#: Pivots, drawn from a sample, and places in an order. For lists an eighth of the root of the number of distinct vectors, within two bounds.
PIVOTS, SAMPLE, PREFIX, LEAST_LISTS, MOST_LISTS = 128, 4096, 32, 8, 2048
#: The part of the true neighbours of so many sampled queries that must be in the probed lists, and, of those, in what is reranked.
TARGET, ASKED = 0.98, 128
BLOCK, QUERIES = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    v = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("embedding", lambda x: x != 0))
    width = v.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return v.filter(F.size("embedding") == (width.w if width else 0))


def _packed(batches):
    """(vec_id, x): components as bytes, negative zeros as zeros."""
    for batch in batches:
        x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False) + 0.0
        width = 8 * len(x) // max(1, batch.num_rows)
        data = np.ascontiguousarray(x).tobytes()
        rows = [data[k : k + width] for k in range(0, len(data), width)] if width else []
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "x"])


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and the logarithms of lengths."""
    with np.errstate(over="ignore", under="ignore"):
        most = np.abs(x).max(axis=1, keepdims=True)
        x = x / most
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / length, (np.log2(most) + np.log2(length)).ravel()


def pick_pivots(x: np.ndarray, pivots: int) -> np.ndarray:
    """Well-spread rows of x: each is the one farthest from those before it, of a random few."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    chosen = [order[0]]
    near = x @ x[order[0]]
    while len(chosen) < min(pivots, len(x)):
        some = rng.choice(len(x), min(len(x), 16), replace=False)
        chosen.append(some[near[some].argmin()])
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


@dataclass
class Index:
    pivots: np.ndarray  # directions
    prefix: int
    first: int  # pivots that lists are dealt by
    usual: float  # cosine of a vector and its list's pivot

    def orders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's nearest pivots in order, its list as one number, its cosines."""
        u, length = unit(x)
        cosine = u @ self.pivots.T
        most = min(self.prefix, len(self.pivots))
        some = np.argpartition(-cosine, most - 1, axis=1)[:, :most] if most < len(self.pivots) else np.tile(np.arange(most), (len(x), 1))
        value = np.take_along_axis(cosine, some, 1)
        order = np.lexsort((some, -value), axis=1)
        band = np.floor(2 * length + 0.5).astype(np.int64)  # lengths about 1 are one band
        return np.take_along_axis(some, order, 1).astype(np.int32), band * MOST_LISTS + cosine[:, : self.first].argmax(axis=1), cosine

    def promising(self, cosine: np.ndarray, lists: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each query its order of ``lists``: the largest product to be expected in each, first."""
        c = cosine[:, lists % MOST_LISTS]
        spread = np.sqrt(2 * np.log1p(sizes) / self.pivots.shape[1] * (1 - self.usual**2))
        best = c * self.usual + np.sqrt(np.maximum(0, 1 - c * c)) * spread
        # sign and logarithm instead of a product, which lengths of any size could overflow
        with np.errstate(divide="ignore"):
            size = (lists // MOST_LISTS)[None, :] / 2 + np.log2(np.abs(best))
        return np.lexsort((np.broadcast_to(lists, c.shape), np.where(best > 0, -size, size), best <= 0), axis=1)


def footrule(order: np.ndarray, asked: np.ndarray, prefix: int) -> np.ndarray:
    """(queries, vectors): the footrule distances less what all have in common, from inverted files of the vectors' prefixes.

    A pair without common pivots has 0; a common one at places i and j adds |i - j| - (prefix - i) - (prefix - j).
    """
    pivots = np.unique(order)
    files = np.full((len(pivots) + 1, len(order)), prefix, np.int16)  # a pivot's file: the place of each vector posted in it
    for j in range(order.shape[1]):
        files[np.searchsorted(pivots, order[:, j]), np.arange(len(order))] = j
    total = np.zeros((len(asked), len(order)), np.int16)
    for i in range(asked.shape[1]):
        at = np.minimum(np.searchsorted(pivots, asked[:, i]), len(pivots) - 1)
        at = np.where(pivots[at] == asked[:, i], at, len(pivots))
        place = files[at]
        total += np.abs(place - i) + place - (2 * prefix - i)
    return total


def search(ids: np.ndarray, x: np.ndarray, order: np.ndarray, q: np.ndarray, asked: np.ndarray, prefix: int, most: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, vector rows, scores): of a block of vectors, in the order of ids, the best of those nearest by footrule."""
    n = len(ids)
    keep = min(n, most + math.ceil(share * n))
    for a in range(0, len(q), 128):
        score = q[a : a + 128] @ x.T
        if keep < n:
            key = footrule(order, asked[a : a + 128], prefix).astype(np.int64) * n + np.arange(n)
            far = np.argpartition(key, keep - 1, axis=1)[:, keep:]
            np.put_along_axis(score, far, -np.inf, 1)
        least = np.partition(score, n - min(most, n), axis=1)[:, n - min(most, n)]
        for r in range(len(score)):
            rows = np.flatnonzero((score[r] >= least[r]) & (score[r] > -np.inf))
            best = rows[np.lexsort((ids[rows], -score[r][rows]))[:most]]
            yield a + r, best, score[r][best]


_ROW = "list long, part int, side int, id long, x binary"
_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _blocks(batches) -> Iterator[pa.Table]:
    """Rows of one (list, part) each, out of sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(n).to_numpy() for n in ("list", "part")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            mine = tuple(key[:, i].tolist())
            if held and mine != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            now = mine
    if held:
        yield pa.Table.from_batches(held)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, prefix: int = PREFIX, share: float | None = None, target: float = TARGET, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found. ``share`` and ``probes`` are set by the data if not given."""
    spark = vectors.sparkSession
    nothing = "query_id long, rank int, vec_id long, score double"
    rows = cut(usable(vectors).mapInArrow(_packed, "vec_id long, x binary"))
    turn = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    equal = rows.withColumn("k", turn).filter(F.col("k") <= k + 1).groupBy("x").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    equal = cut(equal.withColumn("id", F.monotonically_increasing_id()))  # a vec_id may be that of several vectors
    count = equal.count()
    if not count:
        return spark.createDataFrame([], nothing)
    queries = cut(rows.filter(F.col("vec_id") % every == 0).join(equal.select("x", F.col("id").alias("query")), "x").select("vec_id", "query"))
    asked = equal.join(queries.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id", "x")
    sample = matrix(pa.array([bytes(r.x) for r in equal.orderBy(F.xxhash64("x"), "x").limit(SAMPLE).select("x").collect()], pa.binary()))
    first = min(max(LEAST_LISTS, round(math.sqrt(count) / 8)), MOST_LISTS)
    chosen = pick_pivots(unit(sample)[0], max(pivots, first))
    first = min(first, len(chosen))
    usual = float((unit(sample)[0] @ chosen[:first].T).max(axis=1).mean())
    shared = spark.sparkContext.broadcast(Index(chosen, min(prefix, len(chosen)), first, min(max(usual, 0.0), 1.0)))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.orders(x)[1]), batch.column("id"), batch.column("x")], names=["list", "id", "x"])

    placed = cut(equal.select("id", "x").mapInArrow(place, "list long, id long, x binary"))
    sizes = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}  # as many as pivots and bands at most
    lists = np.array(sorted(sizes), np.int64)
    filled = np.array([sizes[m] for m in lists.tolist()])
    fitted = _fitted(placed, asked, shared, lists, sizes, k, target) if probes is None or share is None else (probes, share)
    few, part = min(probes or fitted[0], len(lists)), fitted[1] if share is None else share
    parts = {int(m): -(-n // BLOCK) for m, n in sizes.items()}

    def choose(batches):
        for batch in batches:
            if batch.num_rows:
                index = shared.value
                chosen = lists[index.promising(index.orders(matrix(batch.column("x")))[2], lists, filled)[:, :few]]
                at = np.repeat(np.arange(batch.num_rows), few)
                yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), batch.column("id").take(pa.array(at)), batch.column("x").take(pa.array(at))], names=["list", "id", "x"])

    visits = asked.mapInArrow(choose, "list long, id long, x binary")
    visitors = {r[0]: -(-r[1] // QUERIES) for r in visits.groupBy("list").count().collect()}
    dims = F.broadcast(spark.createDataFrame([(m, n, visitors.get(m, 0)) for m, n in parts.items()], "list long, across int, down int"))  # a row for each list
    # a list's blocks of vectors meet its blocks of queries: rows are dealt to as many parts as the other side has blocks
    mine = F.pmod(F.xxhash64("id"), F.col("across")).cast("int")
    indexed = placed.join(dims, "list").filter("down > 0").select("list", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("d"), mine.alias("m"), "across", "id", "x").select("list", (F.col("d") * F.col("across") + F.col("m")).alias("part"), F.lit(0).alias("side"), "id", "x")
    his = F.pmod(F.xxhash64("id"), F.col("down")).cast("int")
    going = visits.join(dims, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("m"), his.alias("d"), "across", "id", "x").select("list", (F.col("d") * F.col("across") + F.col("m")).alias("part"), F.lit(1).alias("side"), "id", "x")

    def look(batches):
        index = shared.value
        for block in _blocks(batches):
            side, ids = block.column("side").to_numpy(), block.column("id").to_numpy()
            x = matrix(block.column("x").combine_chunks())
            v, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(v) or not len(q):
                continue
            v = v[np.argsort(ids[v])]
            found = list(search(ids[v], x[v], index.orders(x[v])[0], x[q], index.orders(x[q])[0], index.prefix, k + 1, part))
            at = np.repeat([r for r, _, _ in found], [len(best) for _, best, _ in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][at]), pa.array(ids[v][np.concatenate([best for _, best, _ in found])]), pa.array(np.concatenate([s for _, _, s in found]))], schema=_FOUND)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = indexed.unionByName(going).repartition(n, "list", "part").sortWithinPartitions("list", "part").mapInArrow(look, "query long, id long, score double")
    ids = equal.select("id", "ids", F.array_min("ids").alias("least"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
    top = met.join(ids, "id").withColumn("k", best).filter(F.col("k") <= k + 1)
    expanded = top.select("query", "score", F.explode("ids").alias("vec_id"), (F.col("id") == F.col("query")).alias("own"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    # one more than k of each query's vector, so that k are left without its own vec_id
    answers = expanded.withColumn("k", order).filter(F.col("k") <= k + 1).drop("k")
    answers = queries.withColumn("copy", F.monotonically_increasing_id()).withColumnRenamed("vec_id", "query_id").join(answers, "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("copy").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fitted(placed: DataFrame, asked: DataFrame, shared, lists: np.ndarray, sizes: dict[int, int], k: int, target: float) -> tuple[int, float]:
    """The fewest lists, and the least part of each, that hold ``target`` of the true neighbours of ASKED sampled queries; all vectors are looked at."""
    context = placed.sparkSession.sparkContext
    some = asked.orderBy(F.xxhash64("x"), "x").limit(ASKED).collect()
    ids = np.array([r.id for r in some], np.int64)
    if not len(ids):
        return 1, 1.0
    q = context.broadcast(matrix(pa.array([bytes(r.x) for r in some], pa.binary())))

    def exact(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = q.value @ matrix(batch.column("x")).T
            most = min(k + 1, batch.num_rows)
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            row, at = np.repeat(np.arange(len(best)), most), best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), *(batch.column(n).take(pa.array(at)) for n in ("list", "id", "x")), pa.array(score[row, at])], names=["row", "list", "id", "x", "score"])

    order = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    found = placed.mapInArrow(exact, "row int, list long, id long, x binary, score double").withColumn("k", order).filter(F.col("k") <= k + 1).collect()
    found = [r for r in found if r.id != ids[r.row]]
    if not found:
        return 1, 1.0
    index = shared.value
    orders, _, cosine = index.orders(q.value)
    turn = np.argsort(index.promising(cosine, lists, np.array([sizes[m] for m in lists.tolist()])), axis=1)  # when each query comes to each list
    row, mine = np.array([r.row for r in found]), np.array([r.list for r in found])
    depth = turn[row, np.searchsorted(lists, mine)]
    true_orders = index.orders(matrix(pa.array([bytes(r.x) for r in found], pa.binary())))[0]
    own = np.array([footrule(true_orders[t : t + 1], orders[row[t] : row[t] + 1], index.prefix)[0, 0] for t in range(len(found))])
    truth = context.broadcast((row, mine, own, orders))

    def nearer(batches):
        row, mine, own, orders = truth.value
        total = np.zeros(len(row), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column("list").to_numpy()
            far = footrule(shared.value.orders(matrix(batch.column("x")))[0], orders, shared.value.prefix)
            rows = {m: np.flatnonzero(here == m) for m in np.intersect1d(here, mine).tolist()}
            for t, (r, m, f) in enumerate(zip(row.tolist(), mine.tolist(), own.tolist(), strict=True)):
                if m in rows:
                    total[t] += np.count_nonzero(far[r, rows[m]] <= f)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row))), pa.array(total)], names=["t", "n"])

    rank = dict(placed.mapInArrow(nearer, "t long, n long").groupBy("t").agg(F.sum("n")).collect())
    part = np.array([max(0, rank[t] - k - 1) / sizes[m] for t, m in enumerate(mine.tolist())])
    at = lambda x: np.sort(x)[min(len(x) - 1, math.ceil(target * len(x)) - 1)]
    return int(at(depth)) + 1, float(min(1.0, at(part)))


def brute_force(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The exact answer, to measure recall: the same search with every list probed and every vector reranked."""
    return nearest(vectors, k, every, share=1.0, probes=1 << 30)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
