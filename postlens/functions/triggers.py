"""Which of many regular expressions can match a text at all, found in one pass.

``required`` reads a pattern's syntax tree and returns strings of which every match must
contain one: the best of its mandatory stretches, with alternatives, optional parts and small
classes written out. All patterns' strings go into one Aho-Corasick automaton; a text is
folded (case, digits to 0, white space to blank; the folds only ever join what a pattern
may tell apart, never the reverse) and read once, and the result is a bit mask of the
patterns that can match. Only those need to be run, so a text without any
trigger costs one pass, however many patterns there are.
"""

from __future__ import annotations

import re
import sys
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 400  # strings written out for one stretch
# letters beyond ASCII that case-insensitive matching takes for ASCII ones
SAME_LETTER = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


@cache
def fold_table() -> dict[int, str]:
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    digits, blanks = (dict.fromkeys(map(ord, re.findall(p, every)), to) for p, to in ((r"\d", "0"), (r"\s", " ")))
    return {c: chr(c + 32) for c in range(65, 91)} | SAME_LETTER | digits | blanks


def fold(text: str) -> str:
    return text.translate(fold_table())


def _exact(node) -> frozenset | None:
    """All folded strings that a node matches, or None if they are too many or not known."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return frozenset([fold(chr(arg))])
    if op == "AT":
        return frozenset([""])
    if op == "CATEGORY":
        return {"CATEGORY_DIGIT": frozenset("0"), "CATEGORY_SPACE": frozenset(" ")}.get(str(arg))
    if op == "IN":
        parts = [_exact(x) for x in arg]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    if op == "RANGE":
        low, high = arg
        return frozenset(fold(chr(c)) for c in range(low, high + 1)) if high - low < 64 else None
    if op == "SUBPATTERN":
        return _all(arg[-1])
    if op == "BRANCH":
        parts = [_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        one = _all(inner)
        if one is None or int(high) > 3:
            return None
        out: set = set()
        for n in range(int(low), int(high) + 1):
            got = _cross([one] * n)
            if got is None:
                return None
            out |= got
        return frozenset(out)
    return None


def _cross(sets) -> frozenset | None:
    out = frozenset([""])
    for s in sets:
        if len(out) * len(s) > LARGEST:
            return None
        out = frozenset(a + b for a in out for b in s)
    return out


def _all(seq) -> frozenset | None:
    parts = [_exact(x) for x in seq]
    return None if any(p is None for p in parts) else _cross(parts)


def _score(s: frozenset) -> tuple:
    return min(map(len, s)), -len(s)


def _best(seq) -> frozenset:
    """The most telling set of strings of which every match of the sequence contains one ({""}: none)."""
    found, now = [], frozenset([""])
    for node in seq:
        e = _exact(node)
        if e is not None:
            longer = _cross([now, e])
            if longer is None:
                found.append(now)
                longer = e
            now = longer
            continue
        op, arg = str(node[0]), node[1]
        if op in ("MAX_REPEAT", "MIN_REPEAT") and int(arg[0]) >= 1:
            one = _all(arg[2])  # at least once: it goes on to there
            found.append((one is not None and _cross([now, one])) or now)
        else:
            found.append(now)
            if op == "SUBPATTERN":
                found.append(_best(arg[-1]))
            elif op == "BRANCH":
                found.append(frozenset().union(*map(_best, arg[1])))
        now = frozenset([""])
    return max([*found, now], key=_score)


def required(pattern: str) -> frozenset:
    """Folded strings of which every match contains one; {""} if nothing is known to be required."""
    import re._parser as parser  # the standard library's own reader of patterns

    best = _best(parser.parse(pattern, re.IGNORECASE))
    return frozenset(s for s in best if not any(t != s and t in s for t in best))


class Triggers:
    """The automaton of several patterns; bit k of a text's mask says that pattern k may match."""

    def __init__(self, patterns):
        self.always, self.words = 0, {}
        for k, p in enumerate(patterns):
            need = required(p)
            if "" in need:
                self.always |= 1 << k
                continue
            for s in need:
                self.words[s] = self.words.get(s, 0) | 1 << k
        self.automaton = None

    def mask(self, text: str | None) -> int:
        if text is None:
            return 0
        if not self.words:
            return self.always
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for s, bits in self.words.items():
                self.automaton.add_word(s, bits)
            self.automaton.make_automaton()
        return reduce(int.__or__, {bits for _, bits in self.automaton.iter(fold(text))}, self.always)

    def __getstate__(self):
        return {"always": self.always, "words": self.words, "automaton": None}

    def column(self, text: Column) -> Column:
        """The mask of a text column (at most 63 patterns), texts sent in Arrow batches."""

        @F.pandas_udf("long")
        def trigger_mask(texts: pd.Series) -> pd.Series:
            return pd.Series([self.mask(t) for t in texts], dtype="int64")

        return trigger_mask(text)
