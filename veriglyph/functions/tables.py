"""Lookup tables: confusable maps, visual weights, ranked look-alikes, word lists.

Large tables aren't kept here. What follows Unicode's own data is built by rule from the running Python's Unicode
database; what was published as a file is read from a path that the caller names:

* ``confusables_txt(path)`` parses Unicode's confusables.txt into a full map;
* ``weights(path)``, ``lookalikes(path)`` and ``words(path)`` read Parquet or JSON through Spark.

Without a path, the short fixed tables below serve.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALNUM = re.compile(r"[a-z0-9]\Z")

# Characters that look like ASCII letters or digits, with what they look like (Unicode TR39 data,
# scripts in order of their blocks; Unicode License v3).
LOOKALIKES = {
    # Latin
    "×": "x", "þ": "p", "ı": "i",
    "Ƅ": "b", "ƍ": "g", "ƒ": "f", "Ɩ": "l", "Ʀ": "r", "Ƨ": "2", "Ʒ": "3", "Ƽ": "5",
    "ƽ": "s", "ƿ": "p", "ǀ": "l", "Ȝ": "3", "Ȣ": "8", "ȣ": "8",
    "ɑ": "a", "ɡ": "g", "ɣ": "y", "ɩ": "i", "ɪ": "i", "ɯ": "w", "ʋ": "u", "ʏ": "y",
    "˛": "i",
    # Greek
    "ͺ": "i", "Ϳ": "j", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "l",
    "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u",
    "ϒ": "y", "Ϝ": "f", "Ϩ": "2", "Ϭ": "6", "ϭ": "o", "ϱ": "p", "ϲ": "c", "ϳ": "j",
    "ϸ": "p", "Ϲ": "c", "Ϻ": "m",
    # Cyrillic
    "Ѕ": "s", "І": "l", "Ј": "j", "А": "a", "В": "b", "Е": "e", "З": "3", "К": "k",
    "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x",
    "Ь": "b", "а": "a", "б": "6", "г": "r", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ш": "w", "ѕ": "s", "і": "i", "ј": "j", "ѡ": "w", "Ѵ": "v",
    "ѵ": "v", "Ү": "y", "ү": "y", "һ": "h", "ҽ": "e", "Ӏ": "l", "ӏ": "l", "Ӡ": "3",
    "ԁ": "d", "Ԍ": "g", "ԛ": "q", "Ԝ": "w", "ԝ": "w",
    # Armenian
    "Ս": "u", "Տ": "s", "Օ": "o", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "ո": "n",
    "ռ": "n", "ս": "u", "ց": "g", "ւ": "i", "ք": "f", "օ": "o",
    # Hebrew
    "׀": "l", "ו": "l", "ט": "v", "ן": "l", "ס": "o",
    # Georgian
    "ყ": "y", "ჿ": "o",
    # Cherokee
    "Ꭰ": "d", "Ꭱ": "r", "Ꭲ": "t", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "a", "Ꭻ": "j", "Ꭼ": "e",
    "Ꮃ": "w", "Ꮇ": "m", "Ꮋ": "h", "Ꮍ": "y", "Ꮐ": "g", "Ꮒ": "h", "Ꮓ": "z", "Ꮞ": "4",
    "Ꮟ": "b", "Ꮢ": "r", "Ꮤ": "w", "Ꮥ": "s", "Ꮩ": "v", "Ꮪ": "s", "Ꮮ": "l", "Ꮯ": "c",
    "Ꮲ": "p", "Ꮶ": "k", "Ꮷ": "d", "Ꮾ": "6", "Ᏻ": "g", "Ᏼ": "b",
    # Latin small capitals
    "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o",
    "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}

# Ranked look-alikes with their measured likeness, for text preprocessing
# (character, Latin, likeness, source, script, width ratio, height ratio).
RANKED = [
    ("×", "x", 0.4614, "tr39", "Common", 1.0, 1.0),
    ("ì", "i", 0.7164, "novel", "Latin", 1.13, 1.03),
    ("í", "i", 0.7673, "novel", "Latin", 1.08, 1.0),
    ("þ", "p", 1.0, "tr39", "Latin", 1.32, 1.29),
    ("ī", "i", 0.7136, "novel", "Latin", 2.5, 1.03),
    ("İ", "i", 0.7005, "novel", "Latin", 1.2, 1.21),
    ("İ", "l", 0.6883, "novel", "Latin", 1.2, 1.21),
    ("ı", "i", 0.6625, "tr39", "Latin", 1.0, 1.0),
    ("ĺ", "l", 0.7523, "novel", "Latin", 1.0, 1.0),
    ("ļ", "l", 0.7468, "novel", "Latin", 2.0, 1.27),
    ("ł", "l", 0.738, "novel", "Latin", 1.0, 1.0),
]

# Measured visual weights (source, target, danger, stable danger, cost); flags are false.
WEIGHTS = [
    ("0", "ᅌ", 0.7612, 0.7612, 0.2388),
    ("1", "І", 0.9991, 0.7171, 0.2829),
    ("1", "Ӏ", 0.9991, 0.7424, 0.2576),
    ("1", "亅", 0.8957, 0.7012, 0.2988),
    ("A", "Ά", 0.9594, 0.7004, 0.2996),
]

#: A few mild words; pass a list of your own.
WORDS = ["damn", "crap", "bastard", "bollocks"]

WEIGHT_SCHEMA = "src string, tgt string, danger double, stable_danger double, cost double, glyph_reuse boolean, xid_continue boolean, idna_pvalid boolean, tr39_allowed boolean"
LLM_SCHEMA = "ch string, rank int, latin string, ssim double, source string, script string, codepoint string, width_ratio double, height_ratio double"

# Fixed value: the wide letters that TR39 lists.
WIDE = "ABCEHIJKMNOPSTXYZaceghijlopsvxy"

#: Blocks of Unicode 16 letters that older databases don't know: (first, last, what the first stands for).
_NEWER = [(0x1CCD6, 0x1CCEF, "A"), (0x1CCF0, 0x1CCF9, "0")]


def nfkc(text: str) -> str:
    """NFKC, with the newer letters' compatibility mappings."""
    if any(0x1CCD6 <= ord(c) <= 0x1CCF9 for c in text):
        text = "".join(next((chr(ord(to) + ord(c) - a) for a, b, to in _NEWER if a <= ord(c) <= b), c) for c in text)
    return unicodedata.normalize("NFKC", text)


def prototype(compat: str) -> str:
    """What a compatibility variant of an ASCII letter or digit looks like: I, l and 1 alike, O and 0 alike."""
    return {"I": "l", "0": "o", "1": "l"}.get(compat, compat.lower())


@cache
def compatibility_variants() -> dict[str, str]:
    """By rule: styled, wide and compatibility characters of one ASCII letter or digit."""
    out = {}
    for cp in [*range(0x80, 0xD800), *range(0xF900, 0x20000)]:
        tag = unicodedata.decomposition(chr(cp)).split(" ")[0]
        newer = any(a <= cp <= b for a, b, _ in _NEWER)
        if tag not in ("<font>", "<wide>", "<compat>") and not newer:
            continue
        to = nfkc(chr(cp))
        if len(to) == 1 and to.isascii() and to.isalnum() and to != "m" and (tag != "<wide>" or to in WIDE):  # m looks like rn
            out[chr(cp)] = prototype(to)
    out["ſ"] = "f"  # the long s
    return out


@cache
def full_map() -> dict[str, str]:
    """Characters to what they look like: the short table and the rule's."""
    return dict(sorted((LOOKALIKES | compatibility_variants()).items()))


def filtered(full: dict[str, str]) -> dict[str, str]:
    """The entries that NFKC and lower-casing don't already make acceptable in an identifier."""
    return {k: v for k, v in full.items() if not re.fullmatch(r"[a-z0-9-]+", nfkc(k).lower())}


def divergent(ch: str, to: str) -> bool:
    """Whether NFKC leads to another letter or digit than likeness does."""
    other = nfkc(ch).lower()
    return bool(ALNUM.match(other)) and other != to


def vectors(full: dict[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """(char, code_point, tr39, nfkc) where the two disagree, by code point."""
    full = full_map() if full is None else full
    return [(c, f"U+{ord(c):04X}", to, nfkc(c).lower()) for c, to in sorted(full.items(), key=lambda kv: (ord(kv[0]), kv[1])) if divergent(c, to)]


def confusables_txt(lines) -> dict[str, str]:
    """A full map from the lines of Unicode's confusables.txt: single-character ASCII targets, lower-cased; the first wins."""
    out: dict[str, str] = {}
    for line in lines:
        fields = [x.strip() for x in line.split("#")[0].lstrip("﻿").split(";")]
        if len(fields) < 2 or not re.fullmatch(r"[0-9A-Fa-f]+", fields[0]) or len(fields[1].split()) != 1:
            continue
        source, target = chr(int(fields[0], 16)), chr(int(fields[1], 16))
        if source.isascii() and source.isalnum() or not (target.isascii() and target.isalnum()):
            continue
        out.setdefault(source, target.lower())
    for ch in "ᴀᴅᴇᴊᴋᴍᴘᴛ":  # small capitals that the file lacks
        out.setdefault(ch, LOOKALIKES[ch])
    return out


def rank_lookalikes(edges, full: dict[str, str]) -> list[tuple]:
    """Ranked look-alikes of (ch, latin, ssim, script, width, height) edges: the best first, TR39's before others of equal likeness."""
    by: dict[str, dict[str, tuple]] = {}
    for ch, latin, ssim, script, w, h in edges:
        source = "tr39" if full.get(ch) == latin else "novel"
        if latin not in by.setdefault(ch, {}) or by[ch][latin][1] < ssim:
            by[ch][latin] = (latin, ssim, source, script, w, h)
    for ch, latin in full.items():
        by.setdefault(ch, {}).setdefault(latin, (latin, 1.0, "tr39", script_name(ch), None, None))
    out = []
    for ch in sorted(by):
        ranked = sorted(by[ch].values(), key=lambda e: (-e[1], e[2] != "tr39", e[0], e[3]))
        out += [(ch, k, latin, float(ssim), source, script, f"U+{ord(ch):04X}", w, h) for k, (latin, ssim, source, script, w, h) in enumerate(ranked)]
    return out


def script_name(ch: str) -> str:
    """The script that a letter's name begins with, in title case."""
    first = unicodedata.name(ch, "COMMON").split(" ")[0]
    known = {"LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "CHEROKEE", "GEORGIAN", "THAI", "DEVANAGARI"}
    return first.title() if first in known else "Common"


@cache
def ranked() -> list[tuple]:
    """The ranked look-alikes: measured ones as given, the short table's others with likeness 1."""
    measured = [(ch, latin, s, script, w, h) for ch, latin, s, _, script, w, h in RANKED]
    return rank_lookalikes(measured, {k: v for k, v in LOOKALIKES.items() if ord(k) >= 0xD7})


def map_frame(spark: SparkSession, table: dict[str, str] | None = None) -> DataFrame:
    """(ch, proto, divergent)."""
    table = full_map() if table is None else table
    return spark.createDataFrame([(k, v, divergent(k, v)) for k, v in table.items()], "ch string, proto string, divergent boolean")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path.rstrip("/").endswith(".json"):
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(schema).parquet(path)


def weights(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Visual weights; absent flags are false."""
    if path is None:
        return spark.createDataFrame([(*w, False, False, False, False) for w in WEIGHTS], WEIGHT_SCHEMA)
    return _read(spark, path, WEIGHT_SCHEMA).fillna(False)


def edge_weights(edges: DataFrame) -> DataFrame:
    """D3: measured edges (src, tgt, danger, stable_danger, cost and flags) as weights; absent flags are false."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in edges.columns else F.lit(False).alias(c) for c in ("glyph_reuse", "xid_continue", "idna_pvalid", "tr39_allowed")]
    return edges.select("src", "tgt", *[F.col(c).cast("double").alias(c) for c in ("danger", "stable_danger", "cost")], *flags).dropDuplicates(["src", "tgt"])


def font_weights(edges: DataFrame, least: float = 0.7) -> DataFrame:
    """D3: (font, then as weights) of (font, src, tgt, ssim and flags) edges alike enough in a font; danger is the likeness."""
    danger = F.floor(F.col("ssim") * 10000 + F.lit(0.5)) / 10000
    cost = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - danger)) * 10000 + F.lit(0.5)) / 10000
    rows = edges.filter(F.col("ssim") >= least).withColumns({"danger": danger, "stable_danger": danger, "cost": cost})
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in edges.columns else F.lit(False).alias(c) for c in ("xid_continue", "idna_pvalid", "tr39_allowed")]
    return rows.select("font", "src", "tgt", "danger", "stable_danger", "cost", F.lit(False).alias("glyph_reuse"), *flags).dropDuplicates(["font", "src", "tgt"])


def lookalikes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Ranked look-alikes; rank is their order."""
    return spark.createDataFrame(ranked(), LLM_SCHEMA) if path is None else _read(spark, path, LLM_SCHEMA)


def words(spark: SparkSession, path: str | None = None) -> list[str]:
    return list(WORDS) if path is None else [r[0] for r in _read(spark, path, "word string").collect()]


def composability_vectors(spark: SparkSession, table: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(vectors(table), "char string, code_point string, tr39 string, nfkc string")


COMPOSABILITY_VECTOR_SUITE = "nfkc-tr39-divergence-v1"
