"""Disclosure patterns and the age / gender / education normalisers.

The pattern texts, phrase lists and lexicons below are fixed values: they must be
identical to the published extraction rules for the results to agree. They are
stated once, in their natural order. Everything else (how they are evaluated) is
expressed with Spark column functions in the JVM; one automaton over the patterns'
required strings (``triggers``) says first which of the 43 can match a text at all.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import py_strip
from postlens.functions.triggers import Triggers

TRAITS = ("age", "gender", "education")

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the published extraction rules)
# (trait, disclosure type, pattern, ignore_case)
# ---------------------------------------------------------------------------
PATTERNS = [
    ("age", "explicit", r"\bI[' ]?m (\d{1,2})\b", True),
    ("age", "explicit", r"\bI am (\d{1,2})\b", True),
    ("age", "explicit", r"\bI was (\d{1,2})\b", True),
    ("age", "explicit", r"\b(\d{1,2})\s?[mMfF]\b", False),
    ("age", "explicit", r"\bI[' ]?m a (\d{1,2})[- ]?(year[- ]old|yo)\b", True),
    ("age", "explicit", r"\bjust turned (\d{1,2})\b", True),
    ("age", "explicit", r"\bturned (\d{1,2}) (today|last week|this week)\b", True),
    ("age", "explicit", r"\bwhen I was (?:about|around)? ?(\d{1,2})\b", True),
    ("age", "explicit", r"\bin (\d{1,2})(?:st|nd|rd|th)? grade\b", True),
    ("age", "explicit", r"\bstarted high school at (\d{1,2})\b", True),
    ("age", "explicit", r"\bage[:：]?\s*(\d{1,2})\b", True),
    ("age", "explicit", r"\bjust reached (\d{1,2})\b", True),
    ("age", "explicit", r"\b(?:only|still) (\d{1,2})\b", True),
    ("age", "explicit", r"\bnow that I'm (\d{1,2})\b", True),
    ("age", "explicit", r"\bI'm now (\d{1,2})\b", True),
    ("age", "explicit", r"\bI'm already (\d{1,2})\b", True),
    ("age", "implicit", r"\bi[' ]?m (?:a )?teenager\b", True),
    ("age", "implicit", r"\bi[' ]?m a preteen\b", True),
    ("age", "implicit", r"\bi[' ]?m a minor\b", True),
    ("age", "implicit", r"\bi[' ]?m under\s+(\d{2})\b", True),
    ("age", "implicit", r"\byoung adult\b", True),
    ("age", "implicit", r"\btwentysomething\b", True),
    ("age", "implicit", r"\bi[' ]?m too young to (drive|drink|vote)\b", True),
    ("gender", "explicit", r"\bI[' ]?m (?:a[n]? )?(guy|boy|man|male|female|woman|girl)\b", True),
    ("gender", "explicit", r"\bI[' ]?m a (?:cis|trans)? ?(guy|girl|man|woman)\b", True),
    ("gender", "explicit", r"\bmy pronouns are (he/him|she/her|they/them|xe/xem|ze/zir|any pronouns|it/its)\b", True),
    ("gender", "explicit", r"\bi[' ]?m transgender\b", True),
    ("gender", "explicit", r"\bi[' ]?m non[- ]?binary\b", True),
    ("gender", "explicit", r"\bi[' ]?m (cisgender|cis|trans|nonbinary|genderqueer|genderfluid|agender)\b", True),
    ("gender", "explicit", r"\bas a (guy|man|girl|woman)\b", True),
    ("gender", "explicit", r"\bi[' ]?ve always been a (boy|girl|guy|woman|man)\b", True),
    ("gender", "implicit", r"\bi [' ]?m attracted to (men|women|both|everyone)\b", True),
    ("gender", "implicit", r"\bmy (boyfriend|girlfriend)\b", True),
    ("gender", "implicit", r"\b(he|she|they) said I was (beautiful|handsome|cute)\b", True),
    ("education", "explicit", r"\b(I[' ]?m|currently)?\s*(studying|study|studied|majoring in)\s+(.*?)(college|university|school)\b", True),
    ("education", "explicit", r"\bI[' ]?m (?:a[n]? )?(.*?)(student|major|undergrad|grad)\b", True),
    ("education", "explicit", r"\bjust got accepted to (college|university|med school|law school)\b", True),
    ("education", "explicit", r"\benrolled in (an?|a)? ?(engineering|design|psych|cs|medical|nursing|humanities|business|arts) program\b", True),
    ("education", "explicit", r"\b(freshman|sophomore|junior|senior) (in|at)? ?(college|university|high school)?\b", True),
    ("education", "explicit", r"\bgraduated with (?:a|an)? ?(BA|BS|MA|MS|PhD|associate's|bachelor's|master's) in\b", True),
    ("education", "implicit", r"\btaking a gap year\b", True),
    ("education", "implicit", r"\bdorm\b|\bcampus\b|\bstudent center\b|\blibrary\b", True),
    ("education", "implicit", r"\balumni|alumnus|graduate\b", True),
]

# Age phrases tried in this order when a match holds no digits.
AGE_PHRASE_BINS = [
    ("preteen", "<18"), ("minor", "<18"), ("teenager", "<18"), ("teen", "<18"),
    ("young adult", "18-25"), ("twentysomething", "18-25"), ("early 20s", "18-25"),
    ("mid 20s", "18-25"), ("late 20s", "18-25"), ("college", "18-25"), ("university", "18-25"),
    ("high school", "<18"), ("middle school", "<18"), ("elementary school", "<18"),
    ("kid", "<18"), ("child", "<18"), ("too young to drive", "<18"),
    ("too young to drink", "<18"), ("too young to vote", "<18"),
    ("finally legal", "18-25"), ("legal age", "18-25"), ("approaching 18", "<18"),
    ("almost 18", "<18"),
]
# Numeric age bins: upper bound (inclusive) -> label; above the last bound: "50+".
AGE_NUMERIC_BINS = [(17, "<18"), (25, "18-25"), (35, "26-35"), (50, "36-50")]

GENDER_NA = ["na", "none", "unknown", "unspecified", "prefer not to say", "nan"]
GENDER_FEMALE = ["female", "girl", "woman", "lady", "f"]
GENDER_MALE = ["male", "man", "boy", "g"]
GENDER_NONBINARY = ["nonbinary", "nb", "they", "other"]
GENDER_TRANS = ["trans", "transgender", "mtf", "ftm"]

EDUCATION_LEVELS = [
    ("Master’s Degree", ["phd", "doctorate", "doctoral", "dr", "dphil", "master", "masters", "msc", "ms", "ma", "mba"]),
    ("Bachelor’s Degree", ["bachelor", "ba", "bs", "bsc"]),
    ("Community College", ["community college", "assoc degree", "associates", "aa", "as", "some college"]),
    ("High School", ["high school", "secondary", "hs", "ged"]),
]
# ---------------------------------------------------------------------------


def spark_pattern(pattern: str, ignore_case: bool) -> str:
    """Java regex with Python-3 ``str`` semantics: Unicode ``\\b \\d \\w \\s``."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def re2_pattern(pattern: str, ignore_case: bool) -> str:
    """RE2 (DuckDB) form used only by the SQL oracle: (?i) only, (?U) means ungreedy there."""
    return ("(?i)" if ignore_case else "") + pattern


def pattern_table():
    """Rows (pattern_ord, trait, trait_ord, dtype, type_ord, pattern, ignore_case)."""
    rows = []
    for i, (trait, dtype, pat, ic) in enumerate(PATTERNS):
        rows.append((i, trait, TRAITS.index(trait), dtype, 0 if dtype == "explicit" else 1, pat, ic))
    return rows


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bin_age(c) -> Column:
    """Digits of the phrase as an integer -> numeric bin; else first phrase found; else unknown."""
    s = F.lower(py_strip(_col(c)))
    digits = F.regexp_replace(s, r"(?U)\D", "")
    age = F.when(F.length(digits) > 0, digits.try_cast("decimal(38,0)"))
    out = None
    for bound, label in AGE_NUMERIC_BINS:
        cond = age <= F.lit(bound)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    out = out.when(age.isNotNull(), F.lit("50+"))
    for phrase, label in AGE_PHRASE_BINS:
        out = out.when(F.instr(s, phrase) > 0, F.lit(label))
    return out.otherwise(F.lit("unknown"))


def normalize_gender(c, compat: bool = True) -> Column:
    """Female / Male / Non-binary/other / Unknown from a gender phrase.

    Token tests first, then substring tests in the same order. ``compat=False``
    drops the one-letter substring terms (``f``, ``g``) that make "my boyfriend"
    read as Female.
    """
    text = F.regexp_replace(F.lower(py_strip(_col(c).cast("string"))), r"(?U)[^a-z\s]", "")
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))

    def any_token(terms):
        return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))

    def any_sub(terms):
        cond = F.lit(False)
        for t in terms:
            if not compat and len(t) == 1:
                continue
            cond = cond | (F.instr(text, t) > 0)
        return cond

    other = GENDER_TRANS + GENDER_NONBINARY
    return (
        F.when(_col(c).isNull() | (F.length(text) == 0) | text.isin(*GENDER_NA), F.lit("Unknown"))
        .when(any_token(GENDER_FEMALE), F.lit("Female"))
        .when(any_token(GENDER_MALE), F.lit("Male"))
        .when(any_token(other), F.lit("Non-binary/other"))
        .when(any_sub(GENDER_FEMALE), F.lit("Female"))
        .when(any_sub(GENDER_MALE), F.lit("Male"))
        .when(any_sub(other), F.lit("Non-binary/other"))
        .otherwise(F.lit("Unknown"))
    )


def education_regex(terms) -> str:
    return r"\b(" + "|".join(terms) + r")\b"


def normalize_education(c) -> Column:
    """Whole-word lexicon tests, highest level first; else Unknown."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(py_strip(_col(c).cast("string"))), r"(?U)[^a-z0-9\s]", ""), F.lit(" "))
    out = None
    for label, terms in EDUCATION_LEVELS:
        cond = text.rlike(education_regex(terms))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("Unknown"))


def normalize_trait(trait_col, phrase_col, compat: bool = True) -> Column:
    t = _col(trait_col)
    return (F.when(t == "age", bin_age(phrase_col))
            .when(t == "gender", normalize_gender(phrase_col, compat))
            .otherwise(normalize_education(phrase_col)))


@cache
def triggers() -> Triggers:
    return Triggers([p for _, _, p, _ in PATTERNS])


def extract_matches(text_col, mask_col) -> Column:
    """Array of struct(pattern_ord, matches) in pattern order, for the patterns that the mask of ``triggers`` allows."""
    t, mask = _col(text_col), _col(mask_col)
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0,
               F.struct(F.lit(i).alias("pattern_ord"),
                        F.regexp_extract_all(t, F.lit(spark_pattern(p, ic)), F.lit(0)).alias("matches")))
        for i, (_, _, p, ic) in enumerate(PATTERNS)
    ]))
