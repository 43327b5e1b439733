"""DuckDB SQL builders for the text oracles (normalisers, extraction, quote strip)."""

from __future__ import annotations

from postlens.functions.demographics import (AGE_NUMERIC_BINS, AGE_PHRASE_BINS, EDUCATION_LEVELS, GENDER_FEMALE,
                                             GENDER_MALE, GENDER_NA, GENDER_NONBINARY, GENDER_TRANS, PATTERNS,
                                             education_regex, re2_pattern)
from postlens.plans.oracle_views import WORDS_RE2, sql_list, sql_str


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def bin_age_sql(x: str) -> str:
    s = f"lower({strip_sql(x)})"
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    age = f"TRY_CAST({digits} AS DECIMAL(38,0))"
    parts = [f"WHEN {digits} <> '' AND {age} <= {b} THEN {sql_str(lab)}" for b, lab in AGE_NUMERIC_BINS]
    parts.append(f"WHEN {digits} <> '' THEN '50+'")
    parts += [f"WHEN contains({s}, {sql_str(p)}) THEN {sql_str(lab)}" for p, lab in AGE_PHRASE_BINS]
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def gender_sql(x: str) -> str:
    t = rf"regexp_replace(lower({strip_sql(x)}), '[^a-z\s]', '', 'g')"
    toks = f"regexp_extract_all({t}, '{WORDS_RE2}')"
    other = GENDER_TRANS + GENDER_NONBINARY

    def sub(terms):
        return "(" + " OR ".join(f"contains({t}, {sql_str(w)})" for w in terms) + ")"

    return (f"CASE WHEN {x} IS NULL OR length({t}) = 0 OR {t} IN ({', '.join(sql_str(v) for v in GENDER_NA)}) THEN 'Unknown' "
            f"WHEN list_has_any({toks}, {sql_list(GENDER_FEMALE)}) THEN 'Female' "
            f"WHEN list_has_any({toks}, {sql_list(GENDER_MALE)}) THEN 'Male' "
            f"WHEN list_has_any({toks}, {sql_list(other)}) THEN 'Non-binary/other' "
            f"WHEN {sub(GENDER_FEMALE)} THEN 'Female' WHEN {sub(GENDER_MALE)} THEN 'Male' "
            f"WHEN {sub(other)} THEN 'Non-binary/other' ELSE 'Unknown' END")


def education_sql(x: str) -> str:
    t = rf"(' ' || regexp_replace(lower({strip_sql(x)}), '[^a-z0-9\s]', '', 'g') || ' ')"
    parts = [f"WHEN regexp_matches({t}, {sql_str(education_regex(terms))}) THEN {sql_str(label)}"
             for label, terms in EDUCATION_LEVELS]
    return "CASE " + " ".join(parts) + " ELSE 'Unknown' END"


def normalize_sql(trait: str, phrase: str) -> str:
    return (f"CASE WHEN {trait} = 'age' THEN {bin_age_sql(phrase)} WHEN {trait} = 'gender' THEN {gender_sql(phrase)} "
            f"ELSE {education_sql(phrase)} END")


def extract_sql(src: str, text: str, keep: list[str]) -> str:
    """SELECT keep..., pattern_ord, match_idx, Trait, DisclosureType, MatchedPhrase, Normalized FROM src."""
    structs = ", ".join(
        f"{{'p': {i}, 'ms': regexp_extract_all({text}, {sql_str(re2_pattern(p, ic))})}}"
        for i, (_, _, p, ic) in enumerate(PATTERNS))
    traits = sql_list([t for t, _, _, _ in PATTERNS])
    types = sql_list([d for _, d, _, _ in PATTERNS])
    k = ", ".join(keep)
    return f"""(SELECT {k}, pattern_ord, match_idx, Trait, DisclosureType, MatchedPhrase,
       {normalize_sql('Trait', 'MatchedPhrase')} AS Normalized FROM (
  SELECT {k}, CAST(s.p AS BIGINT) AS pattern_ord, CAST(i AS BIGINT) AS match_idx, s.ms[i + 1] AS MatchedPhrase,
         ({traits})[s.p + 1] AS Trait, ({types})[s.p + 1] AS DisclosureType
  FROM (SELECT {k}, s, unnest(range(len(s.ms))) AS i
        FROM (SELECT {k}, unnest([{structs}]) AS s FROM {src}) WHERE len(s.ms) > 0)))"""


def strip_quotes_sql(x: str, variant: str) -> str:
    s = strip_sql(x)

    def inner(v):
        return f"substr({v}, 2, greatest(length({v}) - 2, 0))"

    def wrapped(v, q):
        q = sql_str(q)
        return f"(starts_with({v}, {q}) AND ends_with({v}, {q}))"

    if variant == "a":
        return (f"CASE WHEN length({s}) >= 2 AND ({wrapped(s, chr(34))} OR {wrapped(s, chr(39))}) "
                f"THEN {strip_sql(inner(s))} ELSE {s} END")
    if variant == "b":
        d = f"CASE WHEN {wrapped(s, chr(34))} THEN {inner(s)} ELSE {s} END"
        e = f"CASE WHEN {wrapped(d, chr(39))} THEN {inner(d)} ELSE {d} END"
        return strip_sql(e)
    if variant == "c":
        return f"""regexp_replace({s}, '^["'']+|["'']+$', '', 'g')"""
    if variant == "d":
        return f"CASE WHEN {wrapped(s, chr(34))} THEN {strip_sql(inner(s))} ELSE {s} END"
    return s


def windows_sql(words_expr_src: str, keys: str, size: int, step: int) -> str:
    """Rows (keys, ChunkID, text) of windows of ``size`` words every ``step`` words."""
    return f"""(SELECT {keys}, CAST(st // {step} + 1 AS BIGINT) AS ChunkID,
       array_to_string(w[st + 1:st + {size}], ' ') AS text
  FROM (SELECT {keys}, w, unnest(range(0, len(w), {step})) AS st FROM {words_expr_src}))"""
