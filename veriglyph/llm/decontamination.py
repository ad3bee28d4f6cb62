"""Operator 7, benchmark decontamination: a distributed positional inverted index, with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A benchmark item's windows are its runs of
``window`` words; an item of fewer, but not none, is one window. A document word inside an occurrence of a window is hit.

1. ``frequencies`` counts the benchmark's terms in all documents; a window with a term that never occurs is done with.
2. The *postings* (document, position) of each window's two rarest terms are taken from the documents. Each list is
   shifted by its term's offset in the window; where both shifted lists hold the same start, the window may occur.
3. The other terms' postings in those documents are intersected in the same way: a window occurs where all its offsets meet.

``proximity`` gives the looser matches: the two rarest terms of a window within ``slack`` words of their distance in it.

Tables of terms and windows depend on the benchmark alone. They are broadcast while their counted bytes are at most
``BROADCAST``, and joined by shuffling beyond. Postings are keyed by document, so no term's list meets in one task; counts are combined before
they are shuffled.

Defined results: null texts have no words; rows with null doc_id or item_id take no part; rows that repeat a doc_id are
judged each by its own text; equal rows give equal results; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import cut

WINDOW, BROADCAST = 13, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """A text's words in order; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, wid, length, terms) for each window of each item."""
    items = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = items.select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))).alias("at"))
    terms = starts.select("item_id", F.slice("ws", F.col("at"), F.lit(window)).alias("terms")).distinct()
    return terms.select("item_id", F.xxhash64("item_id", "terms").alias("wid"), F.size("terms").alias("length"), "terms")


def postings(docs: DataFrame) -> DataFrame:
    """The index: (doc_id, version, position, term); a version is a text of a doc_id."""
    return docs.select("doc_id", "version", F.posexplode(tokens(F.col("text"))).alias("position", "term"))


def _small(rows: DataFrame, strings: Column) -> DataFrame:
    """Hinted for broadcast if its counted bytes allow that: those of ``strings`` and 96 for the rest of a row."""
    size = rows.agg(F.sum(F.octet_length(strings) + 96)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST else rows


def versions(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def rarest(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, item_id, length, term, offset, rank) of the two rarest terms of each window whose terms all occur."""
    placed = windows.select("wid", "item_id", "length", F.posexplode("terms").alias("offset", "term"))
    terms = _small(placed.select("term").distinct(), F.col("term"))
    frequency = postings(docs).select("term").join(terms, "term", "left_semi").groupBy("term").count()
    best = F.slice(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))), 1, 2)
    ranked = placed.join(frequency, "term").groupBy("wid", "item_id", "length").agg(F.count("*").alias("met"), best.alias("best")).filter("met = length")
    return cut(ranked.select("wid", "item_id", "length", F.posexplode("best").alias("rank", "b")).select("wid", "item_id", "length", "rank", "b.offset", "b.term"))  # counted once


def occurrences(docs: DataFrame, windows: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, version, wid, item_id, start, length): every exact occurrence of a window."""
    rare = _small(rare, F.concat("item_id", "term"))
    shifted = postings(docs).join(rare, "term").select("doc_id", "version", "wid", "item_id", "length", "rank", (F.col("position") - F.col("offset")).alias("start")).filter("start >= 0")
    likely = shifted.groupBy("doc_id", "version", "wid", "item_id", "length", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met")).filter("bit_count(met) = least(2, length)").drop("met")  # ranks, whatever the copies of a row
    likely = cut(likely)  # read twice
    told = _small(windows.select("wid", "item_id", "terms"), F.concat("item_id", F.concat_ws(" " * 16, "terms")))  # an array's words have heads of 8 bytes and are padded
    wanted = likely.join(told, ["wid", "item_id"])
    wanted = wanted.select("doc_id", "version", "wid", "item_id", "length", "start", F.posexplode("terms").alias("offset", "term")).withColumn("position", F.col("start") + F.col("offset"))
    held = docs.join(likely.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    met = wanted.join(postings(held), ["doc_id", "version", "position", "term"])
    return met.groupBy("doc_id", "version", "wid", "item_id", "length", "start").agg(F.count("*").alias("met")).filter("met = length").drop("met")


def proximity(docs: DataFrame, items: DataFrame, slack: int = 5, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, wid, start): the two rarest terms of a window, at most ``slack`` words off their distance in it."""
    docs, windows = versions(docs), windows_of(items, window)
    rare = _small(rarest(docs, windows), F.concat("item_id", "term"))
    shifted = postings(docs).join(rare, "term").select("doc_id", "version", "wid", "item_id", "rank", (F.col("position") - F.col("offset")).alias("start"))
    width = max(1, slack)
    cell = F.floor(F.col("start") / width)
    one = shifted.filter("rank = 0").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    two = shifted.filter("rank = 1").select("doc_id", "version", "wid", "item_id", F.col("start").alias("other"), F.floor(F.col("start") / width).alias("cell"))
    return one.join(two, ["doc_id", "version", "wid", "item_id", "cell"]).filter(F.abs(F.col("start") - F.col("other")) <= slack).select("doc_id", "item_id", "wid", "start").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = 20) -> DataFrame:
    """(doc_id, version, n_words, n_hit, n_items, items_sha256, contaminated) for each document row: contaminated if a word of ``least`` is hit."""
    docs, windows = versions(docs), windows_of(items, window)
    found = occurrences(docs, windows, rarest(docs, windows))
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + length - 1)")))))
    hits = found.groupBy("doc_id", "version").agg(covered.cast("long").alias("hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = docs.select("doc_id", "version", F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    n_hit, names = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    out = counted.join(hits, ["doc_id", "version"], "left").select("doc_id", "version", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("version")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)
), hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
