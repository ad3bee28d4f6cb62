"""Validators: functions of a column that give a rejection message or null."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..functions.tables import WORDS, filtered, full_map

Validator = Callable[[Column], Column]

PATTERN = "^[a-z0-9][a-z0-9-]{1,29}$"
NUMERIC = r"^[0-9]+(-[0-9]+)*$"
NOT_ALLOWED = "That name is not allowed."


def message_when(bad: Column, message: str) -> Column:
    return F.when(bad, F.lit(message))


def predicate(blocked: Callable[[Column], Column], message: str = NOT_ALLOWED, transform: Callable[[Column], Column] | None = None) -> Validator:
    """V7: of any boolean expression or UDF."""
    return lambda c: message_when(F.coalesce(blocked(transform(c) if transform else c), F.lit(False)), message)


def _java(words) -> str:
    """An alternation of literal words for Java's regular expressions."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", w) for w in sorted(words))


def profanity(words: list[str] | None = None, message: str = NOT_ALLOWED, substrings: bool = True, mode: str = "evasion", profile: str = "balanced", least: int = 4, table: dict[str, str] | None = None, most: int | None = None) -> Validator:
    """A listed word, or one of ``least`` characters inside; in ``evasion`` mode also behind substitutes.

    All readings of a value count; with ``most`` only its first ones, at most so many after each character.
    """
    known = sorted({w.strip().lower() for w in (WORDS if words is None else words)} - {""})
    table = full_map() if table is None else table
    least = max(1, int(least))
    substitutes = kernels.AGGRESSIVE if profile == "aggressive" else kernels.BALANCED
    inside = [w for w in known if len(w) >= least] if substrings else []

    def basic(c: Column) -> Column:
        c = F.lower(c)
        bad = c.isin(known) if known else F.lit(False)
        return bad | c.rlike(_java(inside)) if inside else bad

    if mode == "basic" or not known:
        return predicate(basic, message)
    whole, parts = kernels.Folded(known, table, substitutes), kernels.Folded(inside, table, substitutes)

    def all_readings(value: str) -> bool:
        found = kernels.readings(value, table, substitutes)
        return parts.meets(found, True) or whole.meets(found, False)

    def first_readings(value: str) -> bool:
        found = kernels.folds(value, table, substitutes, most)
        return any(f in exact for f in found) or bool(p) and any(p.search(f) for f in found)

    evades = all_readings
    if most is not None:
        most, evades = max(1, int(most)), first_readings
        exact, held = ({f for w in words for f in kernels.folds(w, table, substitutes, min(16, most))} for words in (known, inside))
        p = re.compile("|".join(map(re.escape, sorted(held)))) if held else None

    @F.pandas_udf("boolean")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(evades, na_action="ignore")

    def full(c: Column) -> Column:
        plain = basic(c)
        return plain | F.coalesce(folded(F.when(~plain, F.lower(c))), F.lit(False))

    return predicate(full, message)


def homoglyph(message: str = "That name contains characters that could be confused with other letters.", additional: dict[str, str] | None = None, mixed: bool = False, table: dict[str, str] | None = None, js_surrogate_compat: bool = False) -> Validator:
    """Any character of the map. ``js_surrogate_compat`` also takes characters that share half of a surrogate pair with one."""
    keys = "".join((filtered(full_map()) if table is None else table) | (additional or {}))

    def bad(c: Column) -> Column:
        found = F.length(F.translate(c, keys, "")) < F.length(c) if keys else F.lit(False)
        if js_surrogate_compat:
            units = {u for k in keys if ord(k) > 0xFFFF for u in (0xD800 + (ord(k) - 0x10000 >> 10), 0xDC00 + (ord(k) - 0x10000 & 0x3FF))}

            @F.pandas_udf("boolean")
            def shares(s: pd.Series) -> pd.Series:
                return s.map(lambda v: any(ord(x) > 0xFFFF and (0xD800 + (ord(x) - 0x10000 >> 10) in units or 0xDC00 + (ord(x) - 0x10000 & 0x3FF) in units) for x in v), na_action="ignore")

            found = found | F.coalesce(shares(F.when(c.rlike(r"[\x{10000}-\x{10FFFF}]"), c)), F.lit(False))
        return found | text.has_mixed_scripts(c) if mixed else found

    return predicate(bad, message)


def invisible(message: str = "That name contains invisible or direction-control characters.", ignorables: bool = True, bidi: bool = True, marks: bool = False) -> Validator:
    """V14."""

    def bad(c: Column) -> Column:
        found = F.lit(False)
        for on, test in ((bidi, text.has_bidi), (ignorables, text.has_ignorable), (marks, text.has_mark)):
            found = found | test(c) if on else found
        return found

    return predicate(bad, message)


def chain(validators: list[Validator]) -> Validator:
    """The first rejection."""
    return lambda c: F.coalesce(*[v(c) for v in validators]) if validators else F.lit(None).cast("string")
