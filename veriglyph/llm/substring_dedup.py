"""Operator 1, substring dedup: seed and extend over winnowed anchors.

Winnowed seeds join the documents (``repeats``). ``extend`` then grows all occurrences of a seed together, a word at
a time and both ways, each step parting those whose next words differ; words are equal if their bytes are. Windows of
``window`` words that stay together to their ends are repeats, and what adjoining ones cover are the maximal ones.

Contract of ``removed_words``: words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of ``window``
words covers it whose words also start in a document of smaller doc_id, judged on the input.

Defined results: null text has no words; rows with null doc_id take no part; a doc_id that comes twice, with one text or
several, gives a row for each, and its rows never count as copies of each other; equal texts leave the smallest doc_id
whole; documents shorter than a window stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .repeats import HOT, Block, _lists, later, merged, repeats
from .rolling import exact_numbers, lean, words

WINDOW, SEED = 13, 5


def parted(was: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both are."""
    return np.unique(was * (int(by.max(initial=0)) + 2) + by + 1, return_inverse=True)[1]


def extend(window: int, seed: int):
    """Grow all anchors of a class at once, word by word both ways; windows that stay together to their ends are repeats."""

    def method(block: Block) -> np.ndarray:
        start, end, codes, at = words(block.data, block.at)
        symbols, _ = exact_numbers(block.data, start, end, codes)
        anchor, last, rows = at[:-1] + block.off, at[1:], np.arange(len(block.akey))
        right = [np.unique(block.akey, return_inverse=True)[1]]
        for k in range(window):  # the anchor's own words, then those after it
            place = anchor + k
            right.append(parted(right[-1], np.where(place < last, symbols[np.minimum(place, len(symbols) - 1)], -1)))
        left = np.zeros(len(rows), np.int64)
        hit = np.zeros(len(block.owner), dtype=bool)
        for k in range(window - seed + 1):  # windows that begin k words before the anchor
            if k:
                left[rows] = parted(left[rows], symbols[(anchor - k)[rows]])
            rows = rows[block.off[rows] >= k]
            some = rows[block.off[rows] - k < block.nwin[rows]]
            place = block.off[some] - k
            hit[block.base[some] + place] = later(parted(left[some], right[window - k][some]), block.doc[some], block.ver[some], block.first[some] + place, True)
            rows = rows[block.off[rows] > k]
        return hit

    return method


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _kept(texts: bool):
    schema = _OUT if texts else pa.schema(list(_OUT)[:4])

    def run(batches):
        for batch in batches:
            listed, at = _lists(batch.column("spans"))
            lo, hi = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
            rows = []
            for r, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                found = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                a, b = (x.tolist() for x in merged(lo[at[r] : at[r + 1]], hi[at[r] : at[r + 1]]))
                left, was = [], 0
                for x, y in zip(a, b, strict=True):
                    left += found[was:x]
                    was = y
                left += found[was:]
                kept = b" ".join(left)
                row = (doc, len(found), len(found) - len(left), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode(), [list(x) for x in zip(a, b, strict=True)]) if texts else row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def removed_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document; with ``texts`` also the kept text and the removed word spans."""
    found = repeats(docs, "word", window, seed, True, extend(window, seed), hot)
    more = ", kept string, spans array<array<long>>" if texts else ""
    return found.mapInArrow(lean(_kept(texts)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN firsts USING (s) WHERE doc_id > first
), gone_l AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, ws, coalesce(len(ps), 0) AS n,
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ps, k)) END AS k
  FROM w LEFT JOIN gone_l USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
