"""Pure string kernels, for what Spark's own functions can't express; no Spark is imported here.

``Map`` values are dicts of one character to one ASCII character.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import islice, product

from .tables import divergent, nfkc

#: Default-ignorable code points, a fixed range list.
IGNORABLE_CLASS = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
IGNORABLE = re.compile(f"[{IGNORABLE_CLASS}]")

# Substitutes by which words are spelled around a filter.
BALANCED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "+": "t", "!": "i", "|": "i"}
AGGRESSIVE = BALANCED | {"1": "il", "2": "z", "6": "g", "8": "b", "9": "g", "!": "il", "|": "il"}


def nfd(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def skeleton(text: str, table: dict[str, str]) -> str:
    """What a text looks like: decomposed, ignorables dropped, mapped, decomposed again, lower-cased last."""
    text = IGNORABLE.sub("", nfd(text))
    return nfd("".join([table.get(c, c) for c in text])).lower()


@lru_cache(maxsize=100_000)
def script_tag(ch: str) -> str:
    """A letter's script among those that are told apart, else other-letter; non-letter for the rest."""
    name = unicodedata.name(ch, "")
    first = name.split(" ")[0].lower()
    if not unicodedata.category(ch).startswith("L"):
        return "non-letter"
    if first == "fullwidth" or name.startswith(("FEMININE ORDINAL", "MASCULINE ORDINAL")):
        first = "latin"
    first = {"cjk": "han", "halfwidth": name.split(" ")[1].lower() if " " in name else ""}.get(first, first)
    known = ("latin", "cyrillic", "greek", "armenian", "hebrew", "arabic", "devanagari", "han", "hiragana", "katakana", "hangul", "georgian", "thai")
    return first if first in known else "other-letter"


class Costs:
    """Edit costs under a map and, if given, weights {(a, b): (cost, reuse, xid, idna)}; character pairs are remembered."""

    def __init__(self, table: dict[str, str], weights: dict | None = None, context: str = "all"):
        self.table, self.weights, self.context, self.known = table, weights or {}, context, {}

    def weight(self, a: str, b: str):
        w = self.weights.get((a, b)) or self.weights.get((b, a))
        if w is None or (self.context == "identifier" and not w[2]) or (self.context == "domain" and not w[3]):
            return None
        return w

    def replace(self, a: str, b: str) -> tuple:
        """(cost, operation, reason, cross-script, divergent, prototype)."""
        if (a, b) not in self.known:
            self.known[a, b] = self._replace(a, b)
        return self.known[a, b]

    def _replace(self, a: str, b: str) -> tuple:
        if a == b:
            return 0.0, "match", None, False, False, None
        w, pa, pb = self.weight(a, b), self.table.get(a, a), self.table.get(b, b)
        if pa == pb:
            sa, sb = script_tag(a), script_tag(b)
            cross = "non-letter" not in (sa, sb) and sa != sb
            apart = divergent(a, pa) or divergent(b, pb)
            cost = 0.35 if w is None else 0.0 if w[1] else w[0]
            cost = cost + 0.2 if cross else cost
            cost = cost + 0.1 if apart else cost
            return cost, "confusable-substitution", "cross-script" if cross else "nfkc-divergence" if apart else None, cross, apart, pa
        if nfkc(a).lower() == nfkc(b).lower():
            return 0.45, "substitution", "nfkc-equivalent", False, False, None
        if w is not None:
            return w[0], "substitution", "visual-weight", False, False, None
        return 1.0, "substitution", None, False, False, None

    @staticmethod
    def drop(ch: str) -> float:
        return 0.05 if IGNORABLE.match(ch) else 1.0


def round3(x: float) -> float:
    """Rounded to three places, halves up."""
    return math.floor(x * 1000 + 0.5) / 1000


def distance(a: str, b: str, costs: Costs) -> dict:
    """The cheapest edits from a to b. Among equal totals a replacement goes before a deletion before an insertion."""
    left, right = nfd(a).lower(), nfd(b).lower()
    m, n = len(left), len(right)
    drops, adds = [costs.drop(c) for c in left], [costs.drop(c) for c in right]
    rows, moves = [[0.0]], [[""]]
    for j in range(n):
        rows[0].append(rows[0][-1] + adds[j])
        moves[0].append("i")
    for i in range(m):
        up, row, move = rows[-1], [rows[-1][0] + drops[i]], ["d"]
        for j in range(n):
            total, how = up[j] + costs.replace(left[i], right[j])[0], "r"
            if up[j + 1] + drops[i] < total:
                total, how = up[j + 1] + drops[i], "d"
            if row[j] + adds[j] < total:
                total, how = row[j] + adds[j], "i"
            row.append(total)
            move.append(how)
        rows.append(row)
        moves.append(move)
    steps, i, j = [], m, n
    while i or j:
        how = moves[i][j]
        if how == "r":
            i, j = i - 1, j - 1
            cost, op, reason, cross, apart, proto = costs.replace(left[i], right[j])
            steps.append({"op": op, "from": left[i], "to": right[j], "from_index": i, "to_index": j, "cost": cost, "prototype": proto, "cross_script": cross, "divergence": apart, "reason": reason})
            continue
        i, j = (i - 1, j) if how == "d" else (i, j - 1)
        ch, cost = (left[i], drops[i]) if how == "d" else (right[j], adds[j])
        steps.append({"op": "deletion" if how == "d" else "insertion", "from": ch if how == "d" else None, "to": None if how == "d" else ch, "from_index": i, "to_index": j, "cost": cost, "prototype": None, "cross_script": False, "divergence": False, "reason": "default-ignorable" if cost < 1 else None})
    steps.reverse()
    longest, raw = max(m, n, 1), rows[m][n]
    return {
        "distance": round3(raw), "max_distance": longest, "similarity": round3(1 - min(max(raw / longest, 0), 1)),
        "skeleton_equal": skeleton(a, costs.table) == skeleton(b, costs.table), "normalized_equal": nfkc(a).lower() == nfkc(b).lower(),
        "chain_depth": sum(s["op"] != "match" for s in steps), "cross_script_count": sum(s["cross_script"] for s in steps),
        "ignorable_count": sum(s["reason"] == "default-ignorable" for s in steps), "divergence_count": sum(s["divergence"] for s in steps), "steps": steps,
    }


def _distinct(items: Iterable[str]) -> Iterator[str]:
    seen: set[str] = set()
    return (x for x in items if not (x in seen or seen.add(x)))


def readings(value: str, table: dict[str, str], substitutes: dict[str, str]) -> list[list[str]]:
    """How each character of a value can be read: as itself, if it is one of a-z or 0-9 (else as nothing), and as each of its substitutes."""
    return [[ch if ch.isascii() and ch.isalnum() and ch == ch.lower() else "", *substitutes.get(ch, "")] for ch in skeleton(nfkc(value), table)]


def folds(value: str, table: dict[str, str], substitutes: dict[str, str], most: int) -> list[str]:
    """Readings of a value with substitutes undone and separators left out: at most ``most`` after each character, in order."""
    heads = reduce(lambda heads, tails: list(islice(_distinct(map("".join, product(heads, tails))), most)), readings(value, table, substitutes), [""])
    return [x for x in _distinct("".join(c for c in head if c.isascii() and c.isalnum() and not c.isupper()) for head in heads) if x]


class Folded:
    """Words under all their readings, as a tree by which all readings of a value are followed at once, however many there are.

    A node stands for the first characters of words; those that can be read as nothing are also passed without a character.
    """

    def __init__(self, words: list[str], table: dict[str, str], substitutes: dict[str, str]):
        children: list[dict[tuple, int]] = [{}]
        ends = set()
        for w in words:
            at = 0
            for r in readings(w, table, substitutes):
                if r != [""]:
                    at = children[at].setdefault(tuple(r), len(children))
                    if at == len(children):
                        children.append({})
            if at:
                ends.add(at)
        reached: list[set[int]] = [set()] * len(children)  # from a node without a character; children follow their parents
        self.ends, self.after = set(ends), [{} for _ in children]
        for at in reversed(range(len(children))):
            reached[at] = {at}.union(*(reached[x] for r, x in children[at].items() if "" in r))
            if reached[at] & ends and at:
                self.ends.add(at)
        for at in range(len(children)):
            for x in reached[at]:
                for r, y in children[x].items():
                    for c in filter(None, r):
                        self.after[at].setdefault(c, set()).add(y)

    def meets(self, value: list[list[str]], inside: bool) -> bool:
        """Whether a reading of the value is one of a word or, with ``inside``, holds one."""
        now, begins = set(), True
        for r in value:
            moved = {y for at in (now | {0} if begins else now) for c in r for y in self.after[at].get(c, ())}
            if inside and moved & self.ends:
                return True
            now = moved | now if "" in r else moved
            begins = inside or (begins and "" in r)
        return not inside and bool(now & self.ends)


def _ranges(kinds: str, extra: str) -> str:
    """A character class of the general categories that begin with one of ``kinds``, and ``extra``."""
    out, first = [re.escape(extra)], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] in kinds
        if inside and first is None:
            first = cp
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Maximal runs of letters, digits, marks and underscores."""
    return re.compile(_ranges("LNM", "_") + "+")


def marked_words(text: str, entries: dict):
    """(start, word) of each word that holds a character of ``entries``."""
    marks = [k for k, c in enumerate(text) if c in entries]
    at = 0
    for m in word_pattern().finditer(text) if marks else ():
        while at < len(marks) and marks[at] < m.start():
            at += 1
        if at == len(marks):
            return
        if marks[at] < m.end():
            yield m.start(), m.group()


def scripts_of(word: str) -> tuple[bool, bool]:
    """(has a Latin letter, has another letter)."""
    letters = [c for c in word if unicodedata.category(c)[0] == "L"]
    latin = [script_tag(c) == "latin" for c in letters]
    return any(latin), not all(latin)


def cased(source: str, latin: str) -> str:
    return latin.upper() if len(latin) == 1 and "a" <= latin <= "z" and source == source.upper() != source.lower() else latin


def canonicalise(text: str, entries: dict[str, tuple], everywhere: bool) -> str:
    """Look-alikes replaced: in all words, or in those with a Latin letter."""
    out, was = [], 0
    for start, word in marked_words(text, entries):
        if not everywhere and not scripts_of(word)[0]:
            continue
        out += [text[was:start], "".join(cased(c, entries[c][0]) if c in entries else c for c in word)]
        was = start + len(word)
    return "".join([*out, text[was:]])


def scan(text: str, entries: dict[str, tuple], everywhere: bool, terms: list[str]) -> dict:
    """Findings and their summary; entries are {ch: (latin, ssim, source, script, codepoint)}."""
    findings, mixed_words, targeted, words = [], set(), set(), set()
    wide = 0
    astral = [k for k, c in enumerate(text) if ord(c) > 0xFFFF]
    for start, word in marked_words(text, entries):
        hits = [(k, c) for k, c in enumerate(word) if c in entries]
        latin, other = scripts_of(word)
        mixed = latin and other
        for k, c in hits:
            latin_c, ssim, source, script, codepoint = entries[c]
            while wide < len(astral) and astral[wide] < start + k:
                wide += 1
            findings.append({"char": c, "codepoint": codepoint or f"U+{ord(c):04X}", "script": script, "latin_equivalent": latin_c, "ssim_score": ssim, "source": source, "index": start + k, "utf16_index": start + k + wide, "word": word, "mixed_script": mixed})
        words.add(word.lower())
        if mixed or everywhere:
            mixed_words.add(word.lower())
            plain = "".join(cased(c, entries[c][0]) if c in entries else c for c in word).lower()
            if any(t in plain for t in terms):
                targeted.add(word.lower())
    counted = len(findings) if everywhere else sum(f["mixed_script"] for f in findings)
    level = "none"
    if findings:
        level = "low" if not counted else "high" if len(mixed_words) >= 3 or counted >= 6 or len(targeted) >= 2 or (targeted and counted >= 3) else "medium"
    return {"has_confusables": bool(findings), "count": len(findings), "findings": findings, "distinct_chars": len({f["char"] for f in findings}), "words_affected": len(words), "scripts_detected": sorted({f["script"] for f in findings}, key=lambda s: (s.lower(), s)), "risk_level": level}


#: What names are made of when a pattern's longest is looked for, and the length up to which it is.
SAMPLES, LONGEST = ("a", "1", "a1", "a-1"), 100


def max_length(pattern: str, fallback: int = 30) -> int:
    """The most characters, up to LONGEST, of a name that a pattern takes: its parsed width, where a name of samples that long fits."""
    takes = re.compile(pattern).search
    width = min(re._parser.parse(pattern).getwidth()[1], LONGEST)
    fitting = (n for n in (width, *range(LONGEST, 0, -1)) if n and any(takes((s * n)[:n]) for s in SAMPLES))
    return next(fitting, fallback)


#: What database drivers call a duplicate key, and where an error keeps the one behind it.
DUPLICATE_CODES = {"23505", "P2002", "ER_DUP_ENTRY", "SQLITE_CONSTRAINT", "SQLITE_CONSTRAINT_UNIQUE", "11000"}
DUPLICATE_NUMBERS = {1062, 11000}
DUPLICATE_PHRASES = ("duplicate key", "unique constraint", "unique violation", "already exists", "e11000", "constraint failed")
INNER = ("cause", "__cause__", "parent", "original", "meta")


def is_unique_violation(error, depth: int = 6) -> bool:
    """Whether an error, or one up to ``depth`` - 1 steps behind it, tells of a duplicate key."""
    if depth == 0 or error is None or isinstance(error, (str, bool, int, float)):
        return False
    fields = error if isinstance(error, dict) else {k: getattr(error, k, None) for k in ("code", "errno", "sqlstate", "message", *INNER)}
    told = fields.get("message") or (error if isinstance(error, BaseException) else "")
    marks = {str(fields.get("code")), str(fields.get("sqlstate"))}
    number = fields.get("errno")
    return (
        not marks.isdisjoint(DUPLICATE_CODES)
        or (isinstance(number, int) and number in DUPLICATE_NUMBERS)
        or any(phrase in str(told).lower() for phrase in DUPLICATE_PHRASES)
        or any(is_unique_violation(fields.get(k), depth - 1) for k in INNER)
    )
