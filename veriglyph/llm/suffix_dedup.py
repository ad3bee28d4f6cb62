"""Operator 3, suffix-array dedup: column-wise construction over many strings.

The collection's strings are the pieces of documents that winnowed seeds mark as possible repeats (``repeats``; a
window whose seed is found nowhere else can't repeat). Classes of a seed are independent collections, and a task takes
about 1 MiB of strings at a time, equal ones once. Every round inserts one byte of each string, from the right: the byte takes
the place of its string's end mark in the Burrows-Wheeler transform, ranks among equal bytes tell where the longer suffixes belong,
and one pass merges them into the transform and into the common prefixes. Runs of common prefixes of a window or
more hold equal windows, told by the bytes and not by hashes.

The published method keeps both sequences in external files, since it holds one collection of everything. Here collections are
bounded, so both are arrays, read and written in order as the files would be; what goes to disk goes through shuffles.

Contract of ``removed_bytes``: a byte goes when a string of ``window`` bytes covers it that also starts earlier:
in a document of smaller doc_id, or earlier in the same one.

Defined results: null text is empty; rows with null doc_id take no part; rows that repeat a doc_id and text are one document,
not copies, and give a row each; rows of one doc_id with different texts are documents each, which are not copies of each other;
equal texts leave the smallest doc_id whole; an empty table gives no rows; other columns are ignored. Cutting may split a
character, so ``texts`` gives the kept bytes and, beside them, a text in which removed runs are shrunk to whole characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, Block, _lists, later, merged, repeats
from .rolling import exact_numbers, lean, range_codes

#: Windows and seeds in bytes, and the bytes that make a symbol.
WINDOW, SEED, GRAM = 100, 32, 1


def _minima(x: np.ndarray) -> np.ndarray:
    """In row k the least of each 2**k adjoining items."""
    out = np.empty((max(1, len(x).bit_length()), len(x)), x.dtype)
    out[0] = x
    for k in range(1, len(out)):
        n, half = len(x) - (1 << k) + 1, 1 << k - 1
        np.minimum(out[k - 1, :n], out[k - 1, half : half + n], out=out[k, :n])
    return out


def _range_min(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo:hi]."""
    k = np.frexp(hi - lo)[1] - 1
    return np.minimum(table[k, lo], table[k, hi - (1 << k)])


def collection(symbols: np.ndarray, last: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of many strings in order, and each one's prefix in common with the one before it, in symbols (255 at most).

    String z has ``count[z]`` symbols, at ``last[z]``, ``last[z] - step`` and so on to its first.
    Returns (place of each suffix's first symbol, common prefixes). Symbols are positive.
    """
    z, top = len(last), int(symbols.max(initial=0))
    kind = np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else np.int32
    symbols = symbols.astype(kind)
    # the transform (0 marks a string's end) and the common prefixes of all suffixes; the first z are empty ones
    bwt, lcp = np.zeros(z, kind), np.zeros(z, np.uint8)
    place = np.arange(z)  # of each string's longest suffix so far
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        bwt[place[live]] = symbols[last[live] - k * step]
        order = _followed(bwt)
        fresh, owner = np.zeros(len(bwt), bool), np.empty(len(bwt), np.int32)
        fresh[place[live]], owner[place[live]] = True, live
        fresh = fresh[order]  # which of the suffixes with a symbol are new, in their order
        at = np.flatnonzero(fresh)
        old = np.ones(z + len(order), dtype=bool)
        old[z + at] = False
        if len(live) < z:  # whole strings move with what is merged before them
            done = np.flatnonzero(count <= k)
            place[done] += np.searchsorted(z + at - np.arange(len(at)), place[done], side="right")
        place[owner[order[at]]] = z + at
        merged_bwt, merged_lcp = np.zeros(len(old), kind), np.zeros(len(old), np.uint8)
        merged_bwt[old], merged_lcp[old] = bwt, lcp
        ask = np.flatnonzero(fresh[1:] | fresh[:-1]) + 1  # a new suffix and the one behind it
        a, b = order[ask - 1], order[ask]
        merged_lcp[z + ask] = np.where(bwt[a] == bwt[b], 1 + np.minimum(_range_min(_minima(lcp), np.minimum(a + 1, b), b + 1), 254), 0)
        merged_lcp[z] = 0
        bwt, lcp = merged_bwt, merged_lcp
    order, where = _followed(bwt), np.zeros(len(bwt) - z, np.int64)
    live, first = np.flatnonzero(count > 0), last - (count - 1) * step
    at = place[live]
    for k in range(int(count.max(initial=0))):
        where[at - z] = first[live] + k * step
        go = count[live] > k + 1
        live, at = live[go], order[at[go] - z]
    return where, lcp[z:]


def _followed(bwt: np.ndarray) -> np.ndarray:
    """The places of symbols in the transform in the order of the suffixes they begin."""
    order = np.argsort(bwt, kind="stable")
    return order[len(bwt) - np.count_nonzero(bwt) :]


def by_collection(window: int, gram: int):
    def method(block: Block) -> np.ndarray:
        seen: dict[tuple[int, bytes], int] = {}  # equal strings are one, in its first place
        data, keys = block.data.tobytes(), block.akey.tolist()
        number = np.array([seen.setdefault((k, data[a:b]), len(seen)) for k, a, b in zip(keys, block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)])
        hit = later(number, block.doc, block.ver, block.first, False)[block.owner]
        _, kind, of_kind = np.unique(np.array([k for k, _ in seen]), return_inverse=True, return_counts=True)
        several = of_kind[kind] > 1  # a class's only string shares no window: its own hang on one anchor, so they differ
        several = np.flatnonzero(several)
        if not len(several):
            return hit
        strings = [x for _, x in seen]
        text = np.frombuffer(b"".join(strings[k] for k in several.tolist()), np.uint8)
        length = np.array([len(strings[k]) for k in several.tolist()])
        start = np.cumsum(length) - length
        if gram == 1:
            symbols = text.astype(np.uint16) + 1
        else:
            spot = np.arange(len(text) - gram + 1)
            symbols = exact_numbers(text, spot, spot + gram, range_codes(text, spot, spot + gram))[0] + 1
        first = (start[:, None] + np.arange(gram)).ravel()  # a string for each phase
        count = ((length[:, None] - np.arange(gram)) // gram).ravel()
        where, lcp = collection(symbols, first + (count - 1) * gram, count, gram)
        run = np.empty(len(text), np.int64)
        run[where] = np.cumsum(lcp < window // gram)
        chosen = np.full(len(strings), -1)
        chosen[several] = np.arange(len(several))
        rest = np.flatnonzero(~hit & (chosen[number] >= 0)[block.owner])
        o, k = block.owner[rest], block.inner[rest]
        hit[rest] = later(run[start[chosen[number[o]]] + k], block.doc[o], block.ver[o], block.first[o] + k, False)
        return hit

    return method


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left when the spans go, less the parts of characters that they only touch: those stay whole."""
    out, was = [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[was:a])
        was = b
    return b"".join([*out, data[was:]])


def _kept(texts: bool):
    schema = _OUT if texts else pa.schema(list(_OUT)[:5])

    def run(batches):
        for batch in batches:
            listed, at = _lists(batch.column("spans"))
            lo, hi = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
            rows = []
            for r, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b = (x.tolist() for x in merged(lo[at[r] : at[r + 1]], hi[at[r] : at[r + 1]]))
                kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True))
                row = (doc, len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, whole_characters(data, list(zip(a, b, strict=True))).decode(), [list(x) for x in zip(a, b, strict=True)]) if texts else row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def removed_bytes(docs: DataFrame, window: int = WINDOW, seed: int = SEED, gram: int = GRAM, texts: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document; with ``texts`` also kept bytes, text and spans. ``gram`` divides ``window``."""
    if window % gram or window // gram > 255:
        raise ValueError("gram must divide window, into 255 symbols at most")
    found = repeats(docs, "byte", window, seed, False, by_collection(window, gram), hot)
    more = ", kept binary, text string, spans array<array<long>>" if texts else ""
    return found.mapInArrow(lean(_kept(texts)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL
), win AS (
  SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)
), firsts AS (SELECT s, min(doc_id * 1000000000 + i) AS first FROM win GROUP BY s),
hits AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id * 1000000000 + i > first),
starts AS (
  SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100
                    OR row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS fresh FROM hits
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM starts) GROUP BY doc_id, r
), per AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, n, coalesce(gone, 0) AS gone, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2),
      lambda k: substr(x, 2 * (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END) + 1,
                       2 * ((CASE WHEN k > len(a) THEN n ELSE a[k] END) - (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)))), '') END AS y
  FROM h LEFT JOIN per USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM kept
"""
