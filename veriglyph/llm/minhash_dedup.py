"""Operator 2, MinHash near-dedup: b-bit signatures over banded candidates, confirmed on full sets.

Contract of ``near_components``: a document's set are the distinct ``shingle``-word shingles of its words
(``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); with fewer words, all of them as one. Documents whose sets meet in at least
``num``/``den`` of their union are linked.

1. ``features`` takes from each text its set's size and fingerprint, 96 minima, their bands and their low four bits.
   Documents of equal sets are one class from here on, under its smallest doc_id.
2. Classes that share a band are candidates. In each band's bucket all members are held against one hub: the one that
   meets most others over all bands, the likely origin. b-bit counts, corrected for chance collisions, drop pairs
   five standard deviations below the threshold; full sets decide the others.
3. Buckets whose members are then still in different components are compared in full, again by b-bit counts first, each
   pair in the first bucket that it shares. Pairs of buckets of up to ``SMALL`` members become rows. Larger buckets are cut
   into square blocks of bounded size, spread over tasks and holding their members' full sets, where pairs are confirmed
   on the spot, the likeliest first, until their components have met; only links leave a block. So no link between
   classes is lost with its bucket's size, and pairs inside one component, where a further link changes nothing, are never made.

A pair at the threshold shares none of the 24 bands of 4 minima with a chance of 2e-8. Sets hold 64-bit codes of shingles, made by
mixing their words' codes, and those by mixing the words' bytes; there are no sums of powers in them that patterned words could cancel.

Defined results: null text or no words give an empty set, linked with nothing; rows with null doc_id take no part;
rows that repeat a doc_id give a row each, with their own sizes, and the
document links where any of them does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import components, cut, forget, tidy
from .repeats import partitions
from .rolling import buffers, chunks, join, lean, mix, sliding, words

SHINGLE, NUM, DEN = 5, 85, 100
MINIMA, ROWS, BITS = 96, 4, 4
#: Standard deviations below the threshold at which an estimate rules a pair out.
SIGMAS = 5
SMALL, BLOCK = 64, 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of adjoining rows: their sets' hashes, each sorted, and the rows' offsets in them."""
    _, _, codes, at = words(data, offsets, lower=True)
    n = at[1:] - at[:-1]
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    whole, size = sliding(codes, shingle), np.repeat(np.minimum(n, shingle), count)
    hashes = np.empty(len(first), np.uint64)
    hashes[size == shingle] = whole[first[size == shingle]]
    for k in range(1, shingle):  # shorter documents' words, all as one
        some = np.flatnonzero(size == k)
        x = np.full(len(some), k, np.uint64)
        for i in range(k):
            x = join(x, codes[first[some] + i])
        hashes[some] = x
    out, bounds = [], np.concatenate([[0], np.cumsum(count)]).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        x = np.sort(hashes[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x)
    return np.concatenate(out) if out else hashes, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set (none empty) the least of each of MINIMA hashings, 32 bits each."""
    factors = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    out = np.empty((len(starts), MINIMA), np.uint32)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat((hashes * f >> np.uint64(32)).astype(np.uint32), starts)
    return out


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def features(shingle: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                hashes, at = shingle_sets(data, offsets[i : j + 1], shingle)
                n = at[1:] - at[:-1]
                some = np.flatnonzero(n)
                prints = np.zeros((2, j - i), np.int64)
                sig, bands = np.zeros((j - i, MINIMA * BITS // 8), np.uint8), np.zeros((len(some), MINIMA // ROWS), np.int64)
                if len(some):
                    starts = at[:-1][some]
                    for k in range(2):
                        prints[k, some] = np.add.reduceat(mix(hashes + np.uint64(k * 0x632BE59BD9B4E019)), starts).view(np.int64)
                    low = minima(hashes, starts)
                    sig[some] = (low[:, ::2] & 15) | (low[:, 1::2] & 15) << 4
                    keys = np.tile(np.arange(1, MINIMA // ROWS + 1, dtype=np.uint64), (len(some), 1))
                    for k in range(ROWS):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, k::ROWS])
                    bands = keys.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * (MINIMA // ROWS))]), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), pa.array([x.tobytes() for x in sig], pa.binary()), lists], schema=_FEATURES)

    return run


def least_matches(num: int, den: int) -> int:
    """Of MINIMA b-bit values, as many agree in a pair at the threshold but for SIGMAS standard deviations."""
    p = num / den + (1 - num / den) / 2**BITS  # a chance collision of the low bits corrects the similarity
    return int(np.floor(MINIMA * p - SIGMAS * np.sqrt(MINIMA * p * (1 - p))))


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many b-bit values agree, by counting bits, over arrays of packed signatures (..., 64-bit words)."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return MINIMA - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def similarity(agree: np.ndarray) -> np.ndarray:
    """The collision-corrected estimate of Jaccard similarity."""
    return (agree / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def _signatures(column: pa.Array) -> np.ndarray:
    data, at = buffers(column)
    return data[at[0] : at[-1]].copy().view(np.uint64).reshape(len(at) - 1, MINIMA * BITS // 64)


def likely(num: int, den: int):
    """Of (a, b, na, nb, sa, sb) the pairs that may be linked."""
    schema, least = pa.schema([("a", pa.int64()), ("b", pa.int64())]), least_matches(num, den)

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in ("a", "b", "na", "nb"))
            keep = (matches(_signatures(batch.column("sa")), _signatures(batch.column("sb"))) >= least) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)

    return run


def _meeting(table: pa.Table, num: int, den: int):
    """Of whole blocks (key, i, j, side, a, component, n, sig, bands): the pairs, as rows of the table, of different components
    that may be linked and share no earlier band, and how many values agree."""
    key, i, j, side, comp, n = (table.column(k).to_numpy() for k in ("key", "i", "j", "side", "component", "n"))
    sig = _signatures(table.column("sig"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
    least = least_matches(num, den)
    order = np.lexsort((side, j, i, key))
    heads = np.append(True, (key[order][1:] != key[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1]))
    for rows in np.split(order, np.flatnonzero(heads)[1:]):
        square = i[rows[0]] != j[rows[0]]
        x, y = (rows[side[rows] == 0], rows[side[rows] == 1]) if square else (rows, rows)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, row in enumerate(x):
            rest = y if square else y[k + 1 :]
            rest = rest[(comp[rest] != comp[row]) & (np.minimum(n[rest], n[row]) * den >= np.maximum(n[rest], n[row]) * num)]
            if not len(rest):
                continue
            agree = matches(sig[rest], sig[row])
            rest, agree = rest[agree >= least], agree[agree >= least]
            now = int(np.argmax(bands[row] == key[row]))
            new = ~(bands[rest, :now] == bands[row, :now]).any(axis=1)
            found.append((np.full(int(new.sum()), row), rest[new], agree[new]))
        yield tuple(np.concatenate(z) for z in zip(*found, strict=True))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pairs_of_small(num: int, den: int):
    """Pairs to confirm, out of a partition's whole buckets."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            a = table.column("a").to_numpy()
            for x, y, _ in _meeting(table, num, den):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], a[y])), pa.array(np.maximum(a[x], a[y]))], schema=_PAIRS)

    return run


def links_of_large(num: int, den: int):
    """Links, out of a partition's whole blocks with full sets."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        a, comp = table.column("a").to_numpy(), table.column("component").to_numpy()
        data, at = buffers(table.column("hashes"))
        sets = lambda r: data[at[r] : at[r + 1]].view(np.uint64)
        for x, y, agree in _meeting(table, num, den):
            root: dict[int, int] = {}

            def find(c: int, root=root) -> int:
                while root.get(c, c) != c:
                    root[c] = c = root.get(root[c], root[c])
                return c

            out = []
            order = np.argsort(-agree, kind="stable")
            for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
                u, v = find(int(comp[p])), find(int(comp[q]))
                if u != v and _linked(sets(p), sets(q), num, den):
                    root[max(u, v)] = min(u, v)
                    out.append((int(a[p]), int(a[q])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], schema=_PAIRS)

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two full sets (sorted hashes) meet in num/den of their union."""
    both = np.sort(np.concatenate([x, y]))
    meet = int((both[1:] == both[:-1]).sum())
    return den * meet >= num * (len(both) - meet)


def _sets(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                hashes, at = shingle_sets(data, offsets[i : j + 1], shingle)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array([hashes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=schema)

    return run


def _confirm(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(schema)

    return run


def near_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) per document."""
    parts = partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    found = cut(docs.mapInArrow(lean(features(shingle)), "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>"))
    classes = cut(found.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class_id")))
    members = classes.select(F.col("class_id").alias("a"), "n", "h1", "h2")
    first = found.filter("n > 0").join(members, (found.doc_id == members.a) & (found.n == members.n) & (found.h1 == members.h1) & (found.h2 == members.h2), "left_semi")
    bucketed = first.select("doc_id", F.explode("bands").alias("key"))
    shared = bucketed.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).filter("one < other").select("key", "size")
    shared = cut(shared)  # tables on both sides of a join by band let hot bands be split
    bucketed = cut(bucketed.join(shared, "key").select("key", "size", F.col("doc_id").alias("a")))
    known = cut(first.join(bucketed.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "n", "sig", "bands").dropDuplicates(["a"]))
    tidy(docs.sparkSession)
    sets = cut(docs.join(known.select(F.col("a").alias("doc_id")), "doc_id", "left_semi").mapInArrow(lean(_sets(shingle)), "doc_id long, hashes binary").groupBy("doc_id").agg(F.max_by("hashes", F.length("hashes")).alias("hashes")))
    tidy(docs.sparkSession)

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = sets.selectExpr("doc_id as a", "hashes as xs"), sets.selectExpr("doc_id as b", "hashes as ys")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "xs", "ys").mapInArrow(lean(_confirm(num, den)), "a long, b long")

    score = bucketed.groupBy("a").agg(F.sum("size").alias("score"))
    hubs = bucketed.join(score, "a").groupBy("key").agg(F.max(F.struct("score", (-F.col("a")).alias("a"))).alias("h")).select("key", (-F.col("h.a")).alias("b"))
    hubs = cut(hubs)
    star = bucketed.join(hubs, "key").filter("a <> b").select("a", "b").distinct()
    other = known.selectExpr("a as b", "n as nb", "sig as sb")
    star = star.join(known.selectExpr("a", "n as na", "sig as sa"), "a").join(other, "b")
    links = cut(confirmed(star.mapInArrow(lean(likely(num, den)), "a long, b long")))
    tidy(docs.sparkSession)
    labels = components(links)
    tidy(docs.sparkSession)
    placed = bucketed.join(labels.selectExpr("node as a", "component"), "a", "left").select("key", "size", "a", F.coalesce("component", "a").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    open_keys = cut(open_keys)
    rest = cut(placed.join(open_keys, "key", "left_semi").join(known, "a"))
    tidy(docs.sparkSession)
    one = rest.filter(F.col("size") <= SMALL).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "a", "component", "n", "sig", "bands")
    pairs = one.repartition(parts, "key").mapInArrow(lean(pairs_of_small(num, den)), "a long, b long")
    across = F.ceil(F.col("size") / BLOCK).cast("int")
    large = rest.filter(F.col("size") > SMALL).withColumn("at", F.pmod(F.xxhash64("a"), across).cast("int"))
    large = large.join(sets.select(F.col("doc_id").alias("a"), "hashes"), "a").withColumn("other", F.explode(F.sequence(F.lit(0), across - 1)))
    large = large.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).cast("int").alias("side"), "a", "component", "n", "sig", "bands", "hashes")
    met = large.repartition(parts, "key", "i", "j").mapInArrow(lean(links_of_large(num, den)), "a long, b long")
    more = cut(confirmed(pairs).union(met))
    tidy(docs.sparkSession)
    if not more.isEmpty():
        labels = components(links.union(more))
    forget(shared, bucketed, hubs, open_keys, rest, known, sets)
    # components are told to classes, one row each, before documents meet them; empty sets, which are no class, meet nothing
    told = cut(classes.join(labels.selectExpr("node as class_id", "component"), "class_id", "left").select("n", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component")))
    tidy(docs.sparkSession)
    linked = found.filter("n > 0").select("doc_id", "n", "h1", "h2").join(told, ["n", "h1", "h2"]).select("doc_id", "n", "component", "class_id")
    joined = linked.union(found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"), F.col("doc_id").alias("class_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "class_id")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


#: All pairs that share a shingle, so for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS meet FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * meet >= 85 * (na.n + nb.n - meet)
), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""
