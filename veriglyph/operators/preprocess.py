"""Text preprocessing: look-alikes replaced, scanned for, or only detected.

Look-alikes are resolved once per options to a map of one entry a character, on the driver (its size is that of the
table). Rows without any of its characters are settled natively and go to Python as nulls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.tables import ranked
from ..functions.text import WORD, col

# Words whose imitation counts as aimed.
RISK_TERMS = ["liability", "indemnity", "penalty", "damages", "termination", "breach", "warranty", "payment", "invoice", "governing", "jurisdiction", "arbitration", "confidentiality"]
FINDING = "struct<char: string, codepoint: string, script: string, latin_equivalent: string, ssim_score: double, source: string, index: int, utf16_index: int, word: string, mixed_script: boolean>"
RESULT = f"has_confusables boolean, count int, findings array<{FINDING}>, distinct_chars int, words_affected int, scripts_detected array<string>, risk_level string"


@dataclass
class ScanOptions:
    """T8. ``table``: ranked look-alikes (ch, rank, latin, ssim, source, script, codepoint, width, height)."""

    threshold: float = 0.7
    include_novel: bool = True
    scripts: list[str] | None = None
    risk_terms: list[str] | None = None
    strategy: str = "mixed"
    max_size_ratio: float | None = 3.0
    table: list[tuple] | None = field(default=None, repr=False)

    def __post_init__(self):
        self.threshold = min(max(self.threshold, 0.0), 1.0)
        self.strategy = "all" if self.strategy == "all" else "mixed"
        self.scripts = [s for s in (x.strip().lower() for x in self.scripts or []) if s] or None
        self.risk_terms = [t.lower() for t in self.risk_terms or []] or RISK_TERMS

    @property
    def everywhere(self) -> bool:
        return self.strategy == "all"

    def entries(self) -> dict[str, tuple]:
        """T4: for each character the first entry that passes."""
        most = self.max_size_ratio if self.max_size_ratio is not None else float("inf")
        out: dict[str, tuple] = {}
        for ch, _, latin, ssim, source, script, codepoint, w, h in sorted(self.table or ranked(), key=lambda e: (e[0], e[1])):
            wide = source == "novel" and most != float("inf") and any(r is not None and r > most for r in (w, h))
            if ch in out or ssim < self.threshold or (source == "novel" and not self.include_novel) or (self.scripts and script.lower() not in self.scripts) or wide:
                continue
            out[ch] = (latin, ssim, source, script, codepoint)
        return out


def _any_of(entries: dict) -> str:
    """A class of the characters; one range is tried first, which few characters of most texts get past."""
    listed = "".join(re.sub(r"([\[\]\\^&-])", r"\\\1", c) for c in sorted(entries))
    return rf"[\x{{{ord(min(entries)):X}}}-\x{{{ord(max(entries)):X}}}&&[{listed}]]"


def canonicalise(c, options: ScanOptions | None = None) -> Column:
    """Look-alikes replaced, in words with a Latin letter or (strategy ``all``) in all."""
    o = options or ScanOptions()
    entries, everywhere, c = o.entries(), o.everywhere, col(c)
    if not entries:
        return c

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: kernels.canonicalise(x, entries, everywhere), na_action="ignore")

    hard = c.rlike(_any_of(entries))
    return F.when(hard, run(F.when(hard, c))).otherwise(c)


def scan(c, options: ScanOptions | None = None) -> Column:
    """A struct of findings and summary. ``index`` counts code points, ``utf16_index`` UTF-16 units."""
    o = options or ScanOptions()
    entries, everywhere, terms, c = o.entries(), o.everywhere, o.risk_terms, col(c)
    names = ["has_confusables", "count", "findings", "distinct_chars", "words_affected", "scripts_detected", "risk_level"]

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(names) if x is None else kernels.scan(x, entries, everywhere, terms) for x in s], columns=names)

    nothing = F.struct(F.lit(False).alias("has_confusables"), F.lit(0).alias("count"), F.array().cast(f"array<{FINDING}>").alias("findings"), F.lit(0).alias("distinct_chars"), F.lit(0).alias("words_affected"), F.array().cast("array<string>").alias("scripts_detected"), F.lit("none").alias("risk_level"))
    if not entries:
        return F.when(c.isNotNull(), nothing)
    hard = c.rlike(_any_of(entries))
    return F.when(hard, run(F.when(hard, c))).when(c.isNotNull(), nothing)


def findings(rows: DataFrame, column: str, keep: list[str], options: ScanOptions | None = None) -> DataFrame:
    """T2 as rows: a row for each finding."""
    return rows.select(*keep, F.explode(scan(column, options)["findings"]).alias("f")).select(*keep, "f.*")


def is_clean(c, options: ScanOptions | None = None) -> Column:
    """T3, natively: no word that has both Latin and other letters (strategy ``all``: no word) holds a look-alike."""
    o = options or ScanOptions()
    entries, c = o.entries(), col(c)
    if not entries:
        return F.when(c.isNotNull(), F.lit(True))
    found = F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    bad = lambda w: w.rlike(_any_of(entries))
    if not o.everywhere:
        mixed = lambda w: w.rlike(r"[\p{L}&&\p{IsLatin}]") & w.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
        return F.when(c.rlike(_any_of(entries)), ~F.exists(found, lambda w: bad(w) & mixed(w))).when(c.isNotNull(), F.lit(True))
    return F.when(c.rlike(_any_of(entries)), ~F.exists(found, bad)).when(c.isNotNull(), F.lit(True))
