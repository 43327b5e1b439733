"""Column-level text functions (all JVM-side, codegen friendly).

Every function takes and returns a ``Column``; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() separates on Unicode white space and on the control
# characters U+001C..U+001F; Java's (?U)\s covers the former.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """``str(x)`` of a nullable text: null becomes the three-letter word ``nan``."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def words(c) -> Column:
    """Whitespace tokens of a text, like ``text.split()`` (no empty tokens)."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_PATTERN), F.lit(0))


def word_count(c, null_as_nan: bool = True) -> Column:
    """Number of whitespace tokens; null text counts as the word ``nan`` (1)."""
    src = as_text(c) if null_as_nan else _col(c)
    return F.size(words(src)).cast("long")


def user_from_tid(c) -> Column:
    """User id = text before the first ``_`` (the whole id when there is none)."""
    return F.substring_index(_col(c).cast("string"), "_", 1)


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing white space (Unicode aware)."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def truncate_text(c, n: int = 200, suffix: str = "...") -> Column:
    col = _col(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def strip_quotes(c, variant: str = "a") -> Column:
    """Remove white space and surrounding quotes from a generated text.

    a: strip; if at least 2 chars and wrapped in one matching pair of ``"`` or ``'``,
       drop the pair and strip again
    b: strip; drop a ``"`` pair, then a ``'`` pair; strip again
    c: strip, then remove every ``"`` / ``'`` at both ends
    d: strip; drop a ``"`` pair and strip again
    e: strip only

    Each step is one anchored regular expression over the previous step, so the
    expression stays linear in size (no repeated copies of the input).
    """
    s = py_strip(_col(c))

    def drop(x, q):
        # a lone quote character counts as a pair (text[1:-1] of a 1-char string is empty)
        return F.regexp_replace(x, f"(?s)^{q}(.*){q}$|^{q}$", "$1")

    if variant == "a":
        return py_strip(F.regexp_replace(s, "(?s)^\"(.*)\"$|^'(.*)'$", "$1$2"))
    if variant == "b":
        return py_strip(drop(drop(s, '"'), "'"))
    if variant == "c":
        return F.regexp_replace(s, r"^[\"']+|[\"']+$", "")
    if variant == "d":
        return py_strip(drop(s, '"'))
    if variant == "e":
        return s
    raise ValueError(f"unknown quote variant {variant!r}")


def normalize_column_name(name: str, lower: bool = True) -> str:
    """trim; optionally lower-case and turn white-space runs into ``_``."""
    import re

    n = name.strip()
    if lower:
        n = re.sub(r"\s+", "_", n.lower())
    return n
