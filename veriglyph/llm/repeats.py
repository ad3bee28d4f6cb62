"""Whole-corpus search for windows of symbols that also start elsewhere, without pairs of documents.

Winnowing marks in each window the rightmost seed of the least hash, its *anchor*. Equal windows mark
equal seeds at equal places, so a repeat can only lie between windows that hang on equal anchors. The
windows that hang on one anchor make a run; the symbols under the run are its *context*.

1. ``anchors``: a row for each anchor. Within a batch of documents equal contexts, confirmed on their bytes, are settled at
   once: all but the first are repeats as a whole. So no key has more rows than there are batches.
2. ``classes``: anchors are dealt by seed. Those whose seed is found nowhere else leave.
3. ``segments``: the other contexts' bytes are cut out of the texts.
4. ``refine``: dealt by seed again, the contexts are compared by the method of the caller, on their bytes. Hashes only
   deal rows here; what they hold is never taken as equal without a look at it.

A seed with more than ``HOT`` rows (a very common passage) would meet in one task; its contexts are cut
into single windows in step 3, which are dealt by their own hash, equal ones combined first.

Every step streams or holds one hash partition; the only thing gathered by document is its own spans.

A document is a doc_id and, where any doc_id has several rows, a hash of the text: rows that repeat both are one document,
rows of one doc_id with different texts are documents each, which are never copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import buffers, byte_codes, chunks, doubled, join, lean, mix, same_ranges, sliding, sliding_min, words

_ROW = "akey long, doc_id long, ver long, meta long"
_SEGMENT = "akey long, doc_id long, ver long, meta long, seg binary"
_BITS, _ALL = 8, 255
#: Contexts of one seed that are compared in one task.
HOT = 2048
#: Bytes of input for each partition at least, where the session sets fewer partitions.
PARTITION = 64 << 20


def partitions(df: DataFrame) -> int:
    """As many as the session sets, more for large inputs, so that a worker can hold one."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # what Spark takes where it can't tell
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // PARTITION, 200_000))


def pack(start, off, nwin, kind):
    """A run's place in one integer; kind 2: to be cut into windows."""
    return (((np.asarray(start, np.int64) << _BITS | off) << _BITS | nwin) << 2) | kind


def unpack(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return meta >> (2 * _BITS + 2), meta >> (_BITS + 2) & _ALL, meta >> 2 & _ALL, meta & 3


def pack_span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A settled span in one integer, of kind 1."""
    return (lo.astype(np.uint64) << np.uint64(33) | (hi - lo).astype(np.uint64) << np.uint64(2) | np.uint64(1)).view(np.int64)


def unpack_span(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.ascontiguousarray(meta, np.int64).view(np.uint64)
    lo = (m >> np.uint64(33)).astype(np.int64)
    return lo, lo + (m >> np.uint64(2) & np.uint64(0x7FFFFFFF)).astype(np.int64)


class Symbols:
    """Adjoining rows' symbols (words or bytes): each one's code, first byte and end, and the rows' offsets among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.data, self.unit = data, unit
        if unit == "word":
            self.start, self.end, self.codes, self.at = words(data, offsets)
        else:
            self.codes, self.at, self.base = byte_codes()[data[offsets[0] : offsets[-1]]], offsets - offsets[0], offsets[0]

    def bytes(self, a: int, b: int) -> bytes:
        """Symbols a to b as bytes, words parted by one space."""
        if self.unit == "byte":
            return self.data[self.base + a : self.base + b].tobytes()
        return b" ".join(self.data[self.start[a] : self.end[b - 1]].tobytes().split())


def symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> Iterator[tuple[int, int, Symbols]]:
    for i, j in chunks(offsets):
        yield i, j, Symbols(data, offsets[i : j + 1], unit)


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Whether the ``size`` words from a and from b are the same; the words' places are ``start`` and ``end``."""
    out, sums, at = np.zeros(len(a), bool), np.cumsum(size), 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        n = size[at:to]
        heads = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(heads, n)
        pairs, back = np.unique((inner + np.repeat(a[at:to], n)) * len(start) + inner + np.repeat(b[at:to], n), return_inverse=True)
        out[at:to] = np.logical_and.reduceat(same_ranges(data, start, end, pairs // len(start), pairs % len(start))[back], heads)
        at = to
    return out


def context_codes(codes: np.ndarray, a: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """A code for each range of ``window`` symbols or more: overlapping blocks of a power of two cover it."""
    s = 1 << window.bit_length() - 1
    blocks = doubled(codes, s)
    out = mix(size.astype(np.uint64))
    for k in range(-(-int(size.max(initial=1)) // s)):
        out = join(out, blocks[np.minimum(a + k * s, a + size - s)])
    return out


def runs(codes: np.ndarray, at: np.ndarray, window: int, seed: int):
    """Of adjoining rows' codes: each run's row, first window, number of windows, its anchor's place in it, seed code and context code."""
    n, w = len(codes), window - seed + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none, none
    seeds = sliding(codes, seed)
    first = np.arange(n - seed + 1)
    keyed = (seeds & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - first.astype(np.uint64))
    anchor = (np.uint64(0xFFFFFFFF) - (sliding_min(keyed, w) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    ok = np.zeros(n + 1, np.int32)  # windows that end within their row
    rows = np.flatnonzero(at[1:] - at[:-1] >= window)
    ok[at[rows]] += 1
    ok[at[rows + 1] - window + 1] -= 1
    valid = np.flatnonzero(np.cumsum(ok)[: n - window + 1])
    if not len(valid):
        return none, none, none, none, none, none
    anchor = anchor[valid]
    new = np.empty(len(valid), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    begin = np.zeros(n, dtype=bool)
    begin[at[:-1][at[:-1] < n]] = True
    new |= begin[valid]
    head = np.flatnonzero(new)
    a, p = valid[head], anchor[head]
    nwin = np.diff(np.append(head, len(valid)))
    ctx = join(context_codes(codes, a, nwin + (window - 1), window), (p - a).astype(np.uint64))
    row = np.searchsorted(at, a, side="right") - 1
    return row, a - at[row], nwin, p - a, seeds[p].view(np.int64), ctx


def later(group: np.ndarray, doc: np.ndarray, ver: np.ndarray, place: np.ndarray, strict: bool) -> np.ndarray:
    """Which items are repeats: an equal one (of the same group) is in a smaller doc_id or, unless ``strict``, earlier in the same document."""
    order = np.lexsort((place, ver, doc, group))
    g, d, v, p = group[order], doc[order], ver[order], place[order]
    new = np.append(True, g[1:] != g[:-1])[: len(g)]
    hit = d != d[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(g) else np.zeros(0, bool)
    if not strict:
        own = new | np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]))[: len(g)]
        hit |= p != p[np.flatnonzero(own)[np.cumsum(own) - 1]] if len(g) else hit
    out = np.empty(len(g), dtype=bool)
    out[order] = hit
    return out


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


_ROWS = pa.schema([("akey", pa.int64()), ("doc_id", pa.int64()), ("ver", pa.int64()), ("meta", pa.int64())])
_SEGS = pa.schema([("akey", pa.int64()), ("doc_id", pa.int64()), ("ver", pa.int64()), ("meta", pa.int64()), ("seg", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("ver", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def dealt_by_document(doc: np.ndarray) -> np.ndarray:
    """Settled rows only pass through: any even dealing will do."""
    return mix(doc.astype(np.int64).view(np.uint64)).view(np.int64)


def anchors(unit: str, window: int, seed: int, strict: bool) -> Callable:
    def run(batches):
        for batch in batches:
            ids, vers = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "ver"))
            data, offsets = buffers(batch.column("text"))
            parts, places, known = [], [], 0
            for i, j, sym in symbols(data, offsets, unit):
                row, start, nwin, off, akey, ctx = runs(sym.codes, sym.at, window, seed)
                first = start + sym.at[row] + (known if unit == "word" else sym.base)  # among the batch's words or bytes
                if len(row):
                    parts.append((row + i, pack(start, off, nwin, 0), akey, ctx, first))
                if unit == "word":
                    places.append((sym.start, sym.end))
                    known += len(sym.start)
            if not parts:
                continue
            row, meta, akey, ctx, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            doc, ver = ids[row], vers[row]
            _, number = np.unique(join(akey.view(np.uint64), ctx), return_inverse=True)
            again = later(number, doc, ver, meta, strict)
            some = np.flatnonzero(again)
            if len(some):  # confirmed against one of their group that isn't a repeat itself
                order = np.lexsort((meta, ver, doc, number))
                lead = order[np.searchsorted(number[order], number[some])]
                size = (meta[some] >> 2 & _ALL) + (window - 1)
                good = (meta[some] ^ meta[lead]) & ((1 << 2 * _BITS + 2) - 1) == 0
                a, b, size = first[some[good]], first[lead[good]], size[good]
                if unit == "word":
                    good[good] = same_words(data, *(np.concatenate(x) for x in zip(*places, strict=True)), a, b, size)
                else:
                    good[good] = same_ranges(data, np.concatenate([a, b]), np.concatenate([a + size, b + size]), np.arange(len(a)), np.arange(len(a)) + len(a))
                again[some[~good]] = False
            yield from _sliced(_ROWS, akey[~again], doc[~again], ver[~again], meta[~again])
            start, _, nwin, _ = unpack(meta[again])
            row, lo, hi = row[again], start, start + nwin + window - 1
            new = np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1]))[: len(row)]
            head = np.flatnonzero(new)
            row, span = row[head], pack_span(lo[head], hi[np.append(head[1:], len(row)) - 1]) if len(head) else lo
            yield from _sliced(_ROWS, dealt_by_document(ids[row]), ids[row], vers[row], span)

    return run


def _whole(batches, names: list[str]) -> list[np.ndarray]:
    """A partition's columns."""
    held = list(batches)
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0, np.int64) for n in names]


def classes(strict: bool, hot: int) -> Callable:
    def run(batches):
        akey, doc, ver, meta = _whole(batches, ["akey", "doc_id", "ver", "meta"])
        if not len(akey):
            return
        done = (meta & 1).astype(bool)
        yield from _sliced(_ROWS, akey[done], doc[done], ver[done], meta[done])
        akey, doc, ver, meta = (x[~done] for x in (akey, doc, ver, meta))
        if not len(akey):
            return
        order = np.argsort(akey, kind="stable")
        akey, doc, ver, meta = (x[order] for x in (akey, doc, ver, meta))
        heads = np.flatnonzero(np.append(True, akey[1:] != akey[:-1]))
        count = np.diff(np.append(heads, len(akey)))
        many = count > 1
        if strict:  # nothing to compare within one doc_id
            many &= np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        keep, kind = np.repeat(many, count), np.repeat(np.where(count > hot, 2, 0), count)
        yield from _sliced(_ROWS, akey[keep], doc[keep], ver[keep], (meta | kind)[keep])

    return run


def _sliced(schema, *columns, size: int = 100_000):
    for i in range(0, len(columns[0]), size):
        yield _table(schema, *(x[i : i + size] for x in columns))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that half-open spans cover."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > top[:-1]
    head = np.flatnonzero(new)
    return lo[head], top[np.append(head[1:], len(lo)) - 1]


def _windows(sym: Symbols, window: int, doc: np.ndarray, ver: np.ndarray, start: np.ndarray, first: np.ndarray, strict: bool):
    """Rows for single windows (of documents, at starts; ``first`` among the symbols), those settled within the batch among them."""
    text = [sym.bytes(a, a + window) for a in first.tolist()]
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(t, len(seen)) for t in text])
    again = later(number, doc, ver, start, strict)
    key = context_codes(sym.codes, first, np.full(len(first), window), window).view(np.int64)
    place = np.where(again, start << 2 | 1, pack(start, 0, 1, 0))
    key = np.where(again, dealt_by_document(doc), key)
    for k, d, v, p, s, t, a in zip(key.tolist(), doc.tolist(), ver.tolist(), place.tolist(), start.tolist(), text, again.tolist(), strict=True):
        yield k, d, v, p, (s + window).to_bytes(8, "little") if a else t


def segments(unit: str, window: int, strict: bool) -> Callable:
    """Settled spans are rows too: their kind is 1, their place the first symbol, their bytes the end."""

    def run(batches):
        for batch in batches:
            ids, vers = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "ver"))
            data, offsets = buffers(batch.column("text"))
            listed, at = _lists(batch.column("items"))
            akey, meta = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("akey", "meta"))
            for i, j, sym in symbols(data, offsets, unit):
                outs, hot = [], []
                for r in range(i, j):
                    k, m = akey[at[r] : at[r + 1]], meta[at[r] : at[r + 1]]
                    start, _, nwin, kind = unpack(m)
                    base, d, v = sym.at[r - i], int(ids[r]), int(vers[r])
                    lo, hi = merged(*unpack_span(m[kind == 1]))
                    x = int(dealt_by_document(ids[r : r + 1])[0])
                    outs += [(x, d, v, a << 2 | 1, b.to_bytes(8, "little")) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    todo = kind == 0
                    for x, y, a, size in zip(k[todo].tolist(), m[todo].tolist(), (start + base)[todo].tolist(), (nwin + window - 1)[todo].tolist(), strict=True):
                        outs.append((x, d, v, y, sym.bytes(a, a + size)))
                    n, first = nwin[kind == 2], start[kind == 2]
                    each = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n))
                    if len(each):
                        hot.append((np.full(len(each), d), np.full(len(each), v), each, each + base))
                if hot:
                    outs += _windows(sym, window, *(np.concatenate(x) for x in zip(*hot, strict=True)), strict)
                if outs:
                    yield _table(_SEGS, *zip(*outs, strict=True))

    return run


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column's items and its rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten(), np.concatenate([[0], np.cumsum(n)])


class Block:
    """Whole classes of contexts: their keys, documents, first windows, anchors' places and windows, and their bytes."""

    def __init__(self, akey, doc, ver, meta, data, at):
        self.akey, self.doc, self.ver = akey, doc, ver
        self.first, self.off, self.nwin, _ = unpack(meta)
        self.data, self.at = data, at
        self.owner = np.repeat(np.arange(len(akey)), self.nwin)
        self.base = np.cumsum(self.nwin) - self.nwin
        self.inner = np.arange(len(self.owner)) - self.base[self.owner]

    def spans(self, hit: np.ndarray, window: int):
        """The spans under adjoining windows that are hit."""
        same = np.append(False, self.owner[1:] == self.owner[:-1])[: len(hit)]
        up = np.flatnonzero(hit & ~(same & np.append(False, hit[:-1])[: len(hit)]))
        down = np.flatnonzero(hit & ~np.append(same[1:] & hit[1:], False)[: len(hit)])
        o = self.owner[up]
        return self.doc[o], self.ver[o], self.first[o] + self.inner[up], self.first[o] + self.inner[down] + window


def refine(window: int, method: Callable, block: int = 1 << 20) -> Callable:
    """method(block) tells for each context's each window whether it is a repeat."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        akey, doc, ver, meta = (table.column(n).to_numpy() for n in ("akey", "doc_id", "ver", "meta"))
        data, at = buffers(table.column("seg"))
        settled = np.flatnonzero(meta & 3 == 1)
        ends = data[(at[settled][:, None] + np.arange(8)).ravel()].reshape(-1, 8).copy().view(np.int64).ravel()
        yield from _sliced(_SPANS, doc[settled], ver[settled], meta[settled] >> 2, ends)
        todo = np.flatnonzero(meta & 3 != 1)
        todo = todo[np.argsort(akey[todo], kind="stable")]
        length = (at[1:] - at[:-1])[todo]
        heads = np.flatnonzero(np.append(True, akey[todo][1:] != akey[todo][:-1])) if len(todo) else np.zeros(0, np.int64)
        cuts, filled = [0], 0
        for h, x in zip(heads.tolist(), (np.add.reduceat(length, heads) if len(todo) else np.zeros(0)).tolist(), strict=True):  # about ``block`` bytes together
            if filled and filled + x > block:
                cuts.append(h)
                filled = 0
            filled += x
        for lo, hi in zip(cuts, [*cuts[1:], len(todo)], strict=True):
            rows, n = todo[lo:hi], length[lo:hi]
            if len(rows):
                offsets = np.concatenate([[0], np.cumsum(n)])
                index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(at[rows], n)
                part = Block(akey[rows], doc[rows], ver[rows], meta[rows], data[index], offsets)
                yield from _sliced(_SPANS, *part.spans(method(part), window))

    return run


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, ver, text): ``ver`` is 0 unless some doc_id has several rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # neither a literal nor nullable: either would change one plan of the dealt texts and not the other, so that they were dealt twice
    return docs.select("doc_id", (F.coalesce(F.col("doc_id") % 1, F.lit(0)) if unique else F.xxhash64("text")).cast("long").alias("ver"), "text")


def repeats(docs: DataFrame, unit: str, window: int, seed: int, strict: bool, method: Callable, hot: int = HOT) -> DataFrame:
    """(doc_id, ver, text, spans) for each row: the spans that repeated windows cover, unsorted and overlapping."""
    if not 0 < seed <= window or window - seed >= _ALL:
        raise ValueError(f"seeds must be shorter than windows, by less than {_ALL}")
    docs = versioned(docs)
    n = partitions(docs)
    key = ["doc_id", "ver"]
    found = docs.mapInArrow(lean(anchors(unit, window, seed, strict)), _ROW).repartition(n, "akey").mapInArrow(lean(classes(strict, hot)), _ROW)
    dealt = docs.repartition(n, *key)
    items = found.groupBy(*key).agg(F.collect_list(F.struct("akey", "meta")).alias("items"))
    cut = dealt.join(items.hint("shuffle_hash"), key).select(*key, "text", "items").mapInArrow(lean(segments(unit, window, strict)), _SEGMENT)
    spans = cut.repartition(n, "akey").mapInArrow(lean(refine(window, method)), "doc_id long, ver long, lo long, hi long")
    spans = spans.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return dealt.join(spans.hint("shuffle_hash"), key, "left").select(*key, "text", "spans")
