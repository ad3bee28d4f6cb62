"""Column builders for text. Native expressions; where Unicode normalization is needed, a vectorised UDF that gets nulls
instead of the ASCII rows, which need none."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels
from .tables import divergent, full_map, nfkc

#: White space of JavaScript's trim.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
IGNORABLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
BIDI = r"[\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
NON_ASCII = r"[^\x00-\x7F]"
LATIN, OTHER = r"[\p{L}&&\p{IsLatin}]", r"[\p{L}&&[^\p{IsLatin}]]"
WORD = r"[\p{L}\p{N}\p{M}_]+"
SCRIPTS = ["latin", "cyrillic", "greek", "armenian", "hebrew", "arabic", "devanagari", "han", "hiragana", "katakana", "hangul", "georgian", "thai"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c) -> Column:
    return ~col(c).rlike(NON_ASCII)


def _where_needed(c: Column, kernel: Callable[[str], object], kind: str, plain: Column) -> Column:
    """kernel(c) for rows that aren't ASCII, ``plain`` for the others."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(kernel, na_action="ignore")

    hard = c.rlike(NON_ASCII)
    return F.when(hard, run(F.when(hard, c))).otherwise(plain)


def js_trim(c) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def nfkc_column(c) -> Column:
    return _where_needed(col(c), nfkc, "string", col(c))


def normalize(c, unicode: bool = True) -> Column:
    """Trimmed, NFKC unless ``unicode`` is false, lower-cased, without leading @."""
    c = js_trim(c)
    return F.regexp_replace(F.lower(nfkc_column(c) if unicode else c), "^@+", "")


def code_point_label(c) -> Column:
    """U+0041 for the first character."""
    return F.format_string("U+%04X", F.ascii(col(c)))


def skeleton(c, table: dict[str, str] | None = None) -> Column:
    """N3."""
    table = full_map() if table is None else table
    if any(k.isascii() for k in table):

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: kernels.skeleton(x, table), na_action="ignore")

        return run(col(c))
    return _where_needed(col(c), lambda x: kernels.skeleton(x, table), "string", F.lower(col(c)))


def has_ignorable(c) -> Column:
    return col(c).rlike(IGNORABLE)


def count_ignorables(c) -> Column:
    """N9."""
    c = col(c)
    return F.length(c) - F.length(F.regexp_replace(c, IGNORABLE, ""))


def without_ignorables(c) -> Column:
    """N4."""
    return F.regexp_replace(col(c), IGNORABLE, "")


def has_bidi(c) -> Column:
    """N5."""
    return col(c).rlike(BIDI)


def has_mark(c) -> Column:
    """N6."""
    return col(c).rlike(r"\p{M}")


def has_mixed_scripts(c) -> Column:
    """A Latin letter and another letter."""
    return col(c).rlike(LATIN) & col(c).rlike(OTHER)


def script_tag(c) -> Column:
    """Of a single character."""
    c = col(c)
    out = F.when(c.rlike(r"\p{L}"), F.lit("other-letter")).otherwise(F.lit("non-letter"))
    for name in reversed(SCRIPTS):
        out = F.when(c.rlike(rf"\p{{Is{name.title()}}}"), F.lit(name)).otherwise(out)
    return out


def scripts(c) -> Column:
    """The known scripts of a text's characters, in order."""
    c = col(c)
    return F.array_compact(F.array(*[F.when(c.rlike(rf"\p{{Is{name.title()}}}"), F.lit(name)) for name in sorted(SCRIPTS)]))


def count_mapped(c, table: dict[str, str] | None = None) -> tuple[Column, Column]:
    """How many characters a map has, and for how many of them NFKC disagrees."""
    c, table = col(c), full_map() if table is None else table
    apart = "".join(k for k, v in table.items() if divergent(k, v))

    def count(keys: str) -> Column:
        return F.length(c) - F.length(F.translate(c, keys, "")) if keys else F.lit(0)

    return count("".join(table)), count(apart)


def tokens(c) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(col(c), F.lit(f"({WORD})"), 1)


def round_half_up(c, digits: int = 3) -> Column:
    """Halves go up, below zero too."""
    f = float(10**digits)
    return F.floor(col(c).cast("double") * f + F.lit(0.5)) / F.lit(f)


def clamp(c, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def safe_divide(a, b) -> Column:
    """0 where the denominator is 0."""
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def unique_strings(c) -> Column:
    """Trimmed, without empty ones, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(col(c), js_trim), lambda x: x != ""))


def label(c) -> Column:
    """True, false or null of a label's text."""
    v = F.lower(js_trim(col(c).cast("string")))
    return F.when(v.isin("1", "true", "attack", "malicious", "spoof", "positive"), F.lit(True)).when(v.isin("0", "false", "benign", "safe", "negative"), F.lit(False))


def protect_list(c) -> Column:
    """A comma string's or an array's names; null gives none."""
    return F.coalesce(F.filter(F.transform(F.split(col(c), ","), js_trim), lambda x: x != ""), F.array().cast("array<string>"))


def protect_array(c) -> Column:
    return F.coalesce(F.filter(F.transform(col(c), js_trim), lambda x: x != ""), F.array().cast("array<string>"))


def pick_string(columns: list) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(js_trim(c), F.lit("")) for c in columns]) if columns else F.lit(None).cast("string")


def weight(c) -> Column:
    """1 for null, null for what isn't a positive finite number."""
    c = col(c).cast("double")
    return F.when(c.isNull(), F.lit(1.0)).when((c > 0) & (c < float("inf")), c)
