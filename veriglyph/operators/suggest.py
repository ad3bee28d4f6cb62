"""Suggestion strategies: functions of a column that give an array of candidates, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kernels import max_length
from .validators import PATTERN

Strategy = Callable[[Column], Column]

# Suffixes, prefixes and keyboard neighbours.
SUFFIX_WORDS = ["dev", "io", "app", "hq", "pro", "team", "labs", "hub", "go", "one"]
SIMILAR_PREFIXES = ["the", "my", "x", "i"]
SIMILAR_SUFFIXES = ["x", "o", "i", "z"]
NEARBY = {
    "a": "sqwz", "b": "vngh", "c": "xdfv", "d": "sfce", "e": "wrd", "f": "dgcv", "g": "fhtb", "h": "gjyn", "i": "uko",
    "j": "hknm", "k": "jli", "l": "kop", "m": "njk", "n": "bmhj", "o": "ipl", "p": "ol", "q": "wa", "r": "eft",
    "s": "adwz", "t": "rgy", "u": "yij", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tuh", "z": "xas",
    "0": "19", "1": "02", "2": "13", "3": "24", "4": "35", "5": "46", "6": "57", "7": "68", "8": "79", "9": "80",
}
BASE36 = "abcdefghijklmnopqrstuvwxyz0123456789"


def _fits(a: Column, most: int) -> Column:
    return F.filter(a, lambda x: F.length(x) <= most)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sequential(pattern: str = PATTERN) -> Strategy:
    """Id-1, id1 ... id-9, id9; near the length limit also the shortened id with a digit."""
    most = max_length(pattern)
    digits = _texts("123456789")

    def run(c: Column) -> Column:
        plain = _fits(F.flatten(F.transform(digits, lambda i: F.array(F.concat(c, F.lit("-"), i), F.concat(c, i)))), most)
        cut = F.filter(F.transform(digits, lambda i: F.concat(F.substring(c, 1, most - 1), i)), lambda x: x != c)
        return F.when(F.length(c) >= most - 1, F.concat(plain, F.array_except(cut, plain))).otherwise(plain)

    return run


def random_digits(pattern: str = PATTERN, seed: int = 0, draws: int = 15) -> Strategy:
    """15 draws from 100 to 9999; a hash of identifier and ``seed`` in place of chance."""
    most = max_length(pattern)
    return lambda c: _fits(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.concat(c, F.lit("-"), (F.pmod(F.xxhash64(c, F.lit(seed), i), F.lit(9900)) + 100).cast("string")))), most)


def suffix_words(pattern: str = PATTERN) -> Strategy:
    """U3."""
    most = max_length(pattern)
    return lambda c: _fits(F.transform(_texts(SUFFIX_WORDS), lambda w: F.concat(c, F.lit("-"), w)), most)


def short_random(pattern: str = PATTERN, seed: int = 0, draws: int = 10) -> Strategy:
    """U4: 10 draws of three base-36 characters, seeded like U2."""
    most = max_length(pattern)

    def one(c: Column, i: Column, k: int) -> Column:
        return F.substring(F.lit(BASE36), (F.pmod(F.xxhash64(c, F.lit(seed), i, F.lit(k)), F.lit(36)) + 1).cast("int"), F.lit(1))

    return lambda c: _fits(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.concat(c, F.lit("-"), one(c, i, 0), one(c, i, 1), one(c, i, 2)))), most)


def _sub(c: Column, start, length) -> Column:
    return F.substring(c, start, length)


def _places(c: Column, last: Column) -> Column:
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def scramble(pattern: str = PATTERN) -> Strategy:
    """Neighbours exchanged."""

    def run(c: Column) -> Column:
        n = F.length(c)
        swapped = F.transform(_places(c, n - 1), lambda i: F.concat(_sub(c, F.lit(1), i - 1), _sub(c, i + 1, F.lit(1)), _sub(c, i, F.lit(1)), _sub(c, i + 2, n)))
        return F.array_distinct(F.filter(swapped, lambda x: x != c))

    return run


def similar(pattern: str = PATTERN) -> Strategy:
    """One letter less, a neighbouring key, a prefix or a suffix."""
    most = max_length(pattern)
    keys = F.create_map(*[F.lit(x) for k, v in NEARBY.items() for x in (k, v)])

    def run(c: Column) -> Column:
        n = F.length(c)
        at = _places(c, n)
        less = F.transform(at, lambda i: F.concat(_sub(c, F.lit(1), i - 1), _sub(c, i + 1, n)))
        near = F.flatten(F.transform(at, lambda i: F.transform(F.filter(F.split(F.coalesce(F.try_element_at(keys, _sub(c, i, F.lit(1))), F.lit("")), ""), lambda x: x != ""), lambda k: F.concat(_sub(c, F.lit(1), i - 1), k, _sub(c, i + 1, n)))))
        more = F.concat(F.transform(_texts(SIMILAR_PREFIXES), lambda p: F.concat(p, c)), F.transform(_texts(SIMILAR_SUFFIXES), lambda s: F.concat(c, s)))
        return F.array_distinct(F.filter(F.concat(less, near, more), lambda x: (F.length(x) >= 2) & (F.length(x) <= most) & (x != c) & x.rlike(pattern)))

    return run


STRATEGIES = {"sequential": sequential, "random-digits": random_digits, "suffix-words": suffix_words, "short-random": short_random, "scramble": scramble, "similar": similar}


def compose(strategies: list[Strategy]) -> Strategy:
    """One of each in turn, first of equal ones; a single strategy as it is."""
    if len(strategies) == 1:
        return strategies[0]

    def run(c: Column) -> Column:
        lists = [s(c) for s in strategies]
        longest = F.greatest(*[F.size(x) for x in lists]) if len(lists) > 1 else F.size(lists[0])
        turns = F.flatten(F.transform(_places(c, longest), lambda i: F.array(*[F.try_element_at(x, i) for x in lists])))
        return F.array_distinct(F.filter(turns, lambda x: x.isNotNull()))

    return run


def resolve(strategy=None, generate: Strategy | None = None, pattern: str = PATTERN) -> Strategy:
    """U8: ``generate`` before a function before names; by default sequential and random-digits."""
    if generate:
        return generate
    if callable(strategy):
        return strategy
    names = [strategy] if isinstance(strategy, str) else list(strategy or ["sequential", "random-digits"])
    return compose([STRATEGIES[n](pattern) for n in names])
