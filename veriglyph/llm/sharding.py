"""Operator 6, sharding: minimax contiguous partition, with DataFrame functions only.

Rows of equal text are an atomic group; groups are ordered by their text's MD5, those larger than an equal share of
what the larger ones leave before all others. The least capacity with which the ordered
groups fit into ``shards`` runs is found by binary search, each try checked greedily. The search works on a bounded
summary: ``PAGES`` ranges of the order with their sizes. Only ranges in which some try might cut are looked into, each
by its 256 parts, until every cut lies between two groups; so the driver holds some 10**4 to 10**5 sums however many
groups there are, and the result is that of the search over all groups. Within the capacity found, each cut is then put
as near to an equal share as the later shards' capacity allows, and behind one more group at least, so that no shard is left
empty while there are groups.

Slots number a shard's rows from 0. Rows are counted by shard and hash of doc_id; the counts' running sums (at most
``shards`` x 1024) are broadcast and rows are numbered within those cells, so that neither a shard nor a group meets in one task.

Defined results: null text has no bytes, size 1, CRC 0 and goes with empty texts; rows with null doc_id are
placed like others; repeated rows are each placed; fewer groups than shards leave shards empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import cut

SHARDS, CELLS = 16, 1024
#: Digits of the first ranges (PAGES of them, and those of large groups), and more with each look inside.
FIRST, MORE = 4, 2
PAGES = 16 ** (FIRST - 1)


class Summary:
    """Ordered ranges (prefix, size, largest group, groups), of which those of one group can't be looked into."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = sorted(ranges)
        self.ends = list(accumulate(r[1] for r in self.ranges))
        self.total = self.ends[-1] if self.ends else 0
        self.largest = max((r[2] for r in self.ranges), default=0)

    def greedy(self, capacity: int, shards: int) -> bool:
        """Whether whole ranges fit."""
        at = 0
        for _ in range(shards):
            at = self.ends[k - 1] if (k := bisect_right(self.ends, at + capacity)) else 0
            if at >= self.total:
                return True
        return not self.total

    def least(self, shards: int) -> int:
        lo, hi = max(self.largest, -(-self.total // shards)), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.greedy(mid, shards) else (mid + 1, hi)
        return lo

    def boundary(self, at: int) -> int:
        """The last end of a range at or before ``at``."""
        k = bisect_right(self.ends, at)
        return self.ends[k - 1] if k else 0

    def inside(self, lo: int, hi: int) -> list[str]:
        """The ranges of many groups that reach into (lo, hi]."""
        first = bisect_right(self.ends, lo)
        out = []
        for k in range(first, len(self.ranges)):
            if self.ends[k] - self.ranges[k][1] > hi:
                break
            if self.ranges[k][3] > 1:
                out.append(self.ranges[k][0])
        return out

    def open(self, shards: int) -> list[str]:
        """The ranges in which the greedy check of a capacity that may be the least might cut."""
        low, high = max(self.largest, -(-self.total // shards)), self.least(shards)
        out, a, b = set(), 0, 0
        for _ in range(shards):
            a, b = self.boundary(min(a + low, self.total)), min(b + high, self.total)
            out.update(self.inside(a, b))
            if a >= self.total:
                break
        return sorted(out)

    def even(self, shards: int) -> tuple[list[int], list[str]]:
        """The cuts, each as near as may be to an equal share of what is left, and the ranges to look into for that."""
        capacity = self.least(shards)
        latest, at = [self.total], self.total  # where the last k shards may begin at the earliest
        starts = [0, *self.ends]
        for _ in range(shards):
            need = at - capacity
            at = 0 if need <= 0 else starts[bisect_right(starts, need - 1)]
            latest.append(at)
        cuts, at, vague = [], 0, set()
        for k in range(shards - 1, 0, -1):
            ideal = at + (self.total - at) / (k + 1)
            vague.update(self.inside(int(ideal) - 1, int(ideal) + 1))
            n = bisect_right(self.ends, ideal)
            choices = [x for x in (self.ends[n - 1] if n else 0, self.ends[min(n, len(self.ends) - 1)] if self.ends else 0) if max(at, latest[k]) <= x <= at + capacity]
            at = min(choices, key=lambda x: (x == at, abs(x - ideal), x)) if choices else max(at, latest[k])
            cuts.append(at)
        return cuts, sorted(vague)


def _look(groups: DataFrame, digits: int, inside: list[str] | None) -> list[tuple[str, int, int, int]]:
    rows = groups
    if inside is not None:
        rows = rows.filter(F.substring("key", 1, len(inside[0])).isin(inside))
    rows = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size"), F.max("size"), F.count("*"))
    return [tuple(r) for r in rows.collect()]


def ordered(groups: DataFrame, shards: int) -> Column:
    """The key by which groups are ordered: 0 or 1 and the MD5, 0 for a group larger than an equal share of what larger ones leave."""
    left, large = groups.agg(F.sum("size")).first()[0] or 0, []
    for key, size in groups.select("key", "size").orderBy(F.desc("size"), "key").limit(shards).collect():
        if size * (shards - len(large)) <= left:
            break
        left -= size
        large.append(key)
    return F.concat(F.when(F.col("key").isin(large), "0").otherwise("1"), "key")


def boundaries(groups: DataFrame, shards: int) -> list[str]:
    """The least key of each shard but the first; groups are (key, size)."""
    digits = FIRST
    ranges = {r[0]: r for r in _look(groups, digits, None)}
    for search in (Summary.open, lambda s, n: s.even(n)[1]):
        while vague := search(Summary(list(ranges.values())), shards):
            for size in sorted({len(v) for v in vague}):
                some = [v for v in vague if len(v) == size]
                for k in range(0, len(some), 4096):
                    found = _look(groups, min(33, size + MORE), some[k : k + 4096])
                    for v in some[k : k + 4096]:
                        del ranges[v]
                    ranges.update({r[0]: r for r in found})
    summary = Summary(list(ranges.values()))
    out = []
    for at in summary.even(shards)[0]:
        k = bisect_right(summary.ends, at) if at else 0
        out.append(summary.ranges[k][0] if k < len(summary.ranges) else "g")  # beyond all hexadecimal keys
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row, by the law ``bytes``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    order = ordered(groups, shards)
    number = sum((F.when(order >= b, 1).otherwise(0) for b in boundaries(groups.select(order.alias("key"), "size"), shards)), F.lit(0))
    placed = rows.select("doc_id", "size", "text_crc32", "key", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).alias("cell"))
    counts = placed.groupBy("shard", "cell").count()  # at most shards x CELLS rows
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("n", turn).join(F.broadcast(before), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
