"""Prompt building and screening of generated comments (tables in, tables out).

Generation itself (a local LLM) is not part of the library: attempts arrive as
rows (prompt_id, attempt, text). Profiles are drawn per row with a seeded md5
choice from value-list tables, prompts are literal concatenations chosen by the
``settings`` table, and screening is a set of string predicates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import py_strip, strip_quotes, words
from postlens.operators.ordered import md5_rank_key

# ---------------------------------------------------------------------------
# FIXED VALUES (wording, word lists and settings of the published scripts)
# ---------------------------------------------------------------------------
SETTINGS = [
    # setting, model, every_k, tries, min_words, quote variant, opener list
    ("AFS", "Mistral-7B", 5, 1, None, "d", "full"),
    ("AZS", "Mistral-7B", 5, 1, None, "e", "full"),
    ("IFS", "Mistral-7B", 5, 1, None, "a", "full"),
    ("IZS", "Mistral-7B", 5, 1, None, "e", "full"),
    ("MAFS", "Llama-3-70B", 5, 4, 20, "b", "full"),
    ("MAZS", "Llama-3-70B", 10, 6, 20, "b", "full"),
    ("MIFS", "Llama-3-70B", 10, 6, 15, "a", "short"),
    ("MIZS", "Llama-3-70B", 10, 6, 20, "b", "full"),
]

BANNED_STARTS = (
    "you are", "as a", "hello", "hi", "i am", "as someone", "this is my comment",
    "my comment", "dear", "greetings", "i'm", "as an", "i have", "i think", "in my opinion",
    "i've noticed", "recently", "it’s interesting", "for me", "it’s funny", "in my experience",
    "personally", "i always", "i've been", "i've always", "i find", "one thing", "just wanted to say",
    "to me", "i wonder",
)
BANNED_STARTS_SHORT = (
    "you are", "as a", "hello", "hi", "i am", "as someone", "this is my comment",
    "my comment", "dear", "greetings", "as an",
    "in my opinion", "recently", "for me", "it’s funny", "in my experience", "personally", "i always",
    "i've been", "one thing", "just wanted to say",
    "to me", "i wonder",
)
BANNED_CONTAINS = (
    "bipolar", "mental health", "diagnosed", "condition", "as a person", "as an ai", "as an assistant",
)
BANNED_ENDS = (
    "hope this helps", "thanks for reading", "that's my comment", "that's it", "just my thoughts",
    "anyone else", "anyone else?", "anyone else.", "anyone else have", "does anyone else", "anyone have",
    "what do you think", "has anyone", "who else", "do you agree?", "is it just me?", "am i the only one?",
)
NO_COMMENT = "[No valid comment]"
ERROR_PREFIX = "[Error"

MISTRAL_TASK = (
    "\nNow independently imagine yourself as a normal reddit user and write exactly one reddit comment that would fit "
    "in the subreddit {sub}.\n"
)
MISTRAL_ONE = "Generate only one comment per iteration.\n"
MISTRAL_RULES = (
    "Your comment must be {about} words long. Do not use any hashtags in your comment. "
    "Do not use greetings like \"hello\" or exclamations like \"wow\"\nat the start. Exclude preambles. "
)
MISTRAL_SILENCE = (  # positive settings only; IFS has no blanks at its line ends
    "The mention of any explicit reference to bipolar disorder is not allowed. \n"
    "You must avoid using any language related to mental health such as a condition or general terms like "
    "\"mental illness\", \n\"diagnosed with\", or \"suffering from\". "
)
MISTRAL_STYLE = "Be creative with your response. Focus on general behavior, expression, and tone. Do not use a title."
IMITATE = ("You should imitate the examples I have provided, but you cannot simply modify or rewrite "
           "the examples I have given.")
IZS_CONDITION = "\nYou are diagnosed with Bipolar Disorder."
IFS_TAIL = "        "
AZS_DIVERSITY = """
Provide something more diverse than the previous posts.
Change the structure at the beginning of your response: it shouldn't follow the format of your previous posts.
"""
LLAMA_DIVERSITY = "Make your writing style or structure different from previous comments. Try a new approach or tone."
LLAMA_SYSTEM = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n"
    "You are a helpful assistant that writes realistic, Reddit-style comments based on persona and subreddit context.\n"
    "Your outputs should strictly follow the instructions.\n"
    "<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
)
LLAMA_ASSISTANT = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
MAFS_INSTRUCTIONS = (
    " Write only the comment—no greetings, sign-offs, summaries, or meta-statements. "
    "Do not say 'Here is a reddit comment' or anything similar to that in the beginning of the output. "
    "Do not start your comment with phrases like 'Just', 'Here', 'As a', 'I am', 'This is', "
    "'I'm', greetings, or phrases like 'I've been', 'I spent', 'I just', 'I recently', or similar. "
    "Start directly with a statement, opinion, detail, or description—avoid Reddit formulaic openers. "
    "Try not to use the same opener or sentence structure as earlier comments. Use unique phrasings. "
    "Sound casual and authentic, like a real Redditor. "
    "If the persona is married, do not always mention or focus on your spouse in your comment—"
    "write as you would on Reddit, where many users do not reference their marriage directly in every post. "
    "Do not end your comment by asking the crowd for agreement or saying 'anyone else?' or similar phrases. "
    "Vary your language and sentence structure from comment to comment. "
)
MAFS_IMITATE = ("You should imitate the examples I have provided, but you cannot simply modify or rewrite "
                "the examples I have given./n")
MAZS_INSTRUCTIONS = (
    " Write only the comment—no greetings, sign-offs, summaries, or meta-statements. "
    "Do not start your comment with phrases like 'Just', 'Here', 'As a', 'I am', 'This is', 'I'm', greetings, "
    "or phrases like                     'I've been', 'I spent', 'I just', 'I recently', or similar. "
    "Start directly with a statement, opinion, detail, or description—avoid Reddit formulaic openers. "
    "Try not to use the same opener or sentence structure as earlier comments. Use unique phrasings."
    "Sound casual and authentic, like a real Redditor. "
    "If the persona is married, do not always mention or focus on your spouse in your comment—"
    "write as you would on Reddit, where                 many users do not reference their marriage directly in every post."
    "Do not end your comment by asking the crowd for agreement or saying 'anyone else?' or similar phrases. "
    "Vary your language and sentence structure. Generate exactly one comment."
)
INFERRED_CONDITION = " You are diagnosed with bipolar disorder. (do not mention the diagnosis or mental health in your comment)"
INFERRED_INSTRUCTIONS = (
    "Write only the comment—no greetings, sign‐offs, summaries, or meta-statements. "
    "Do not start your comment with phrases like 'Just', 'Here', 'As a', 'I am', 'This is', "
    "'I'm', greetings, or phrases like 'I've been', 'I spent', 'I just', 'I recently', or similar. "
    "Start directly with a statement, opinion, detail, or description—avoid Reddit formulaic openers. "
    "Try not to use the same opener or sentence structure as earlier comments. Use unique phrasings. "
    "Sound casual and authentic, like a real Redditor. "
    "If the persona is married, do not always mention or focus on your spouse—write as you would on Reddit. "
    "Do not end your comment by asking 'anyone else?' or similar."
)
LLAMA_TASK = "Write a single, realistic Reddit comment that is about {about} words for r/{sub}. {persona}"
#: Words before the examples: (positive, control); the positive ones of AFS and MAFS name both groups.
EXAMPLES_INTRO = {
    "AFS": ("Here are example comments written by different users:\n\n", "Here are example comments written by control users:\n\n"),
    "MAFS": ("Here are some example comments for reference:\n\n", "Here are some example comments from control users:\n\n"),
    "IFS": ("Here are example comments for reference:\n\n", "Here are example comments for reference:\n\n"),
    "MIFS": ("Here are example comments for reference:\n", "Here are example comments for reference:\n"),
}
EXAMPLES_POSITIVE = "Examples from users with bipolar disorder:\n"
EXAMPLES_CONTROL = "Examples from control users:\n"
WORDS_ASKED = {  # setting -> (positive, control)
    "AFS": ("approximately 70-85", "approximately 40-60"), "AZS": ("approximately 77", "around 40-60"),
    "IFS": ("approximately 70-85", "approximately 40-60"), "IZS": ("approximately 77", "approximately 40-60"),
    "MAFS": ("70-80", "40-60"), "MAZS": ("70-80", "40-60"), "MIFS": ("70–80", "40–60"), "MIZS": ("70–80", "40–60"),
}
PERSONA_STYLE = {"AFS": "attribute_mistral", "AZS": "attribute_mistral", "IFS": "reddit_user", "IZS": "inferred",
                 "MAFS": "attribute_llama", "MAZS": "attribute_llama", "MIFS": "inferred", "MIZS": "inferred"}
SAMPLER = {  # setting -> max_tokens, temperature, top_p, top_k, repeat_penalty, presence_penalty, frequency_penalty
    "AFS": (2000, 0.8, 0.9, 40, 1.1, 0.0, 0.0), "AZS": (360, 0.8, 0.9, 20, 1.1, 0.0, 0.0),
    "IFS": (2048, 0.8, 0.95, 40, 1.1, 0.0, 0.0), "IZS": (360, 0.8, 0.9, 20, 1.1, 0.0, 0.0),
    "MAFS": (3000, 0.95, 0.95, 40, 1.1, 0.0, 0.0), "MAZS": (270, 0.95, 0.95, 40, 1.1, 0.0, 0.0),
    "MIFS": (2048, 0.9, 0.95, 40, 1.05, 0.0, 0.0), "MIZS": (270, 0.95, 0.95, 40, 1.1, 0.0, 0.0),
}
SAMPLER_CONTROL = {"MAFS": (2000, 0.95, 0.95, 40, 1.1, 0.0, 0.0)}  # control settings that differ from the positive ones
SAMPLER_NAMES = ("max_tokens", "temperature", "top_p", "top_k", "repeat_penalty", "presence_penalty", "frequency_penalty")
# ---------------------------------------------------------------------------

# Value lists for profile sampling. The published lists live in a module that is
# not part of the published code, so these are our own.
PROFILE_LISTS = {
    "age": [str(a) for a in range(18, 66)],
    "gender": ["male", "female", "non-binary"],
    "education": ["High School", "Community College", "Bachelor’s Degree", "Master’s Degree"],
    "occupation": ["teacher", "nurse", "software developer", "electrician", "accountant", "chef", "student",
                   "graphic designer", "mechanic", "sales associate", "farmer", "librarian"],
    "interests": ["hiking", "gaming", "cooking", "photography", "music", "reading", "travel", "gardening",
                  "fitness", "movies", "painting", "cycling", "astronomy", "chess"],
    "subreddit": ["AskReddit", "books", "cooking", "gaming", "fitness", "personalfinance", "travel", "movies"],
    "nationality": ["the United States", "Canada", "the United Kingdom", "Germany", "India", "Australia",
                    "Brazil", "Nigeria", "Japan", "Mexico"],
    "marital_status": ["single", "married", "divorced", "widowed", "in a relationship"],
}
N_INTERESTS = 3


def sample_profiles(df: DataFrame, id_col: str, seed: int = 42, lists: dict | None = None,
                    condition: str = "Bipolar Disorder") -> DataFrame:
    """One seeded-random profile per row: each field = list[md5(seed|id|field) mod n]; interests = the
    N_INTERESTS list items with the smallest md5(seed|id|item)."""
    lists = lists or PROFILE_LISTS
    out = df
    for field, values in lists.items():
        arr = F.array(*[F.lit(v) for v in values])
        if field == "interests":
            ranked = F.transform(arr, lambda x: F.struct(md5_rank_key(seed, id_col, F.lit("interests"), x).alias("h"),
                                                         x.alias("v")))
            out = out.withColumn("interests", F.transform(F.slice(F.array_sort(ranked), 1, N_INTERESTS),
                                                          lambda s: s["v"]))
        else:
            idx = F.pmod(md5_rank_key(seed, id_col, F.lit(field)), F.lit(len(values))) + 1
            out = out.withColumn(field, F.element_at(arr, idx.cast("int")))
    return out.withColumn("condition", F.lit(condition))


def persona_line(style: str, with_condition: bool = True, persona_text_col: str = "persona_text") -> Column:
    """The persona sentence in one of its four wordings, with the condition or (control) without."""
    interests = F.array_join("interests", ", ")
    if style == "attribute_mistral":
        parts = [F.lit("Your age is: "), F.col("age"), F.lit(". You are a "), F.col("gender"), F.lit(" from "),
                 F.col("nationality"), F.lit(". Your occupation is: "), F.col("occupation"),
                 F.lit(". Your marital status is: "), F.col("marital_status"), F.lit(". Your interests are: "),
                 interests, F.lit(".")]
        # the control wording ends with the blank that stands before the condition
        parts += [F.lit(" You are diagnosed with the condition: "), F.col("condition"), F.lit(".")] if with_condition else [F.lit(" ")]
        return F.concat(*parts)
    if style == "attribute_llama":
        parts = [F.lit("You are a "), F.col("age"), F.lit("-year-old "), F.col("gender"), F.lit(" from "),
                 F.col("nationality"), F.lit(", "), F.col("marital_status"), F.lit(", working as a "),
                 F.col("occupation"), F.lit(", interested in " if with_condition else ", and interested in "), interests]
        if with_condition:
            parts += [F.lit(", diagnosed with "), F.col("condition"),
                      F.lit(" (do not mention the diagnosis or mental health in your comment).")]
        else:
            parts += [F.lit(".")]
        return F.concat(*parts)
    if style == "inferred":
        return F.concat(F.lit("You are "), py_strip(F.col(persona_text_col)))
    if style == "reddit_user":
        return F.concat(F.lit("You are a Reddit user with the following persona: "), F.col(persona_text_col),
                        F.lit(". You are diagnosed with Bipolar Disorder." if with_condition else "."))
    raise ValueError(f"unknown persona style {style!r}")


def prompt_template(setting: str, control: bool = False) -> str:
    """The text of a setting with {persona}, {sub}, {examples} and {diversity} where the row's parts go."""
    about = WORDS_ASKED[setting][control]
    if setting.startswith("M"):
        task = LLAMA_TASK.replace("{about}", about)
        if setting in ("MAFS", "MAZS"):
            task += MAFS_INSTRUCTIONS + "{examples}" if setting == "MAFS" else MAZS_INSTRUCTIONS
        else:
            task += (" " if control else INFERRED_CONDITION) + INFERRED_INSTRUCTIONS
        after = {"MAFS": MAFS_IMITATE + "\n", "MIFS": "{examples}" + IMITATE}.get(setting, "")
        return LLAMA_SYSTEM + task + "{diversity}\n" + after + LLAMA_ASSISTANT
    silence = "" if control else MISTRAL_SILENCE
    few = setting in ("AFS", "IFS")
    body = (("" if control or setting != "IZS" else IZS_CONDITION) + MISTRAL_TASK + (MISTRAL_ONE if few else "")
            + MISTRAL_RULES.replace("{about}", about) + silence + MISTRAL_STYLE)
    if setting == "IFS":
        body = body.replace(" \n", "\n")
    body += {"AFS": " \n" + IMITATE + "\n", "IFS": "\n" + IMITATE + "\n" + IFS_TAIL}.get(setting, "\n")
    text = "[INST] {persona}\n\n{examples}" + body + "{diversity} [/INST]"
    return f"[INST] {text} [/INST]" if setting == "IFS" else text  # published so: wrapped again when sent


def diversity_text(setting: str) -> str:
    if setting.startswith("M"):
        return " " + LLAMA_DIVERSITY
    return "\n" + AZS_DIVERSITY + IFS_TAIL if setting == "IFS" else "\n\n" + AZS_DIVERSITY


def prompt_parts(setting: str, index_col: str = "prompt_index", examples: Column | None = None, persona_text_col: str = "persona_text",
                 control: bool = False) -> tuple[Column, Column]:
    """(persona line, full prompt) of one setting; every k-th prompt (1-based index) gets the diversity text."""
    every_k = {s[0]: s[2] for s in SETTINGS}[setting]
    diverse = F.when(F.pmod(F.col(index_col), F.lit(every_k)) == 0, diversity_text(setting)).otherwise("")
    line = persona_line(PERSONA_STYLE[setting], not control, persona_text_col)
    given = {"persona": line, "sub": F.col("subreddit"), "diversity": diverse, "examples": F.lit("") if examples is None else examples}
    parts = [given[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(persona|sub|diversity|examples)\}",
                                                                         prompt_template(setting, control))) if x]
    return line, F.concat(*parts)


def build_prompts(df: DataFrame, setting: str, index_col: str = "prompt_index", examples_col: str | None = None,
                  persona_text_col: str = "persona_text", control: bool = False) -> DataFrame:
    """Full prompt text per row for one setting.

    ``examples_col`` holds the row's examples block (``examples_block`` or ``few_shot_texts``).
    """
    line, prompt = prompt_parts(setting, index_col, F.col(examples_col) if examples_col else None, persona_text_col, control)
    return df.withColumn("persona_line", line).withColumn("Prompt", prompt)


def build_variants(df: DataFrame, variants: Sequence[tuple[str, bool]], examples: dict | None = None, index_col: str = "prompt_index",
                   persona_text_col: str = "persona_text") -> DataFrame:
    """One row per row of ``df`` and (setting, control) variant: setting, control, model, sampler settings, persona_line, Prompt.

    ``examples`` maps variants to their examples block. Profiles are read once and multiplied by one
    ``explode``, not by a branch of the plan for every variant.
    """
    spec = {s[0]: s for s in SETTINGS}
    made = []
    for setting, control in variants:
        line, prompt = prompt_parts(setting, index_col, (examples or {}).get((setting, control)), persona_text_col, control)
        sampler = SAMPLER_CONTROL.get(setting, SAMPLER[setting]) if control else SAMPLER[setting]
        made.append(F.struct(F.lit(setting).alias("setting"), F.lit(control).alias("control"), F.lit(spec[setting][1]).alias("model"),
                             *[F.lit(v).alias(n) for v, n in zip(sampler, SAMPLER_NAMES, strict=True)],
                             line.alias("persona_line"), prompt.alias("Prompt")))
    return df.withColumn("_v", F.explode(F.array(*made))).select("*", "_v.*").drop("_v")


def examples_block(setting: str, control: bool, first: Column, second: Column | None = None) -> Column:
    """The examples of a setting from numbered texts; positive AFS and MAFS take two groups, positive first."""
    intro = F.lit(EXAMPLES_INTRO[setting][control])
    if setting in ("AFS", "MAFS") and not control:
        return F.concat(intro, F.lit(EXAMPLES_POSITIVE), first, F.lit("\n\n" + EXAMPLES_CONTROL), second, F.lit("\n\n"))
    return F.concat(intro, first, F.lit("\n" if setting == "MIFS" else "\n\n"))


def few_shot_texts(examples: DataFrame, members: DataFrame, id_col: str = "persona_id", member_id: str = "vec_id",
                   text_col: str = "text", out: str = "examples") -> DataFrame:
    """(id, numbered texts) from retrieved (id, example_no, member_id): the members' texts, at most six a persona."""
    t = members.select(F.col(member_id).alias("member_id"), F.col(text_col).alias("_text"))
    rows = F.sort_array(F.collect_list(F.struct("example_no", "_text")))
    packed = examples.join(t, "member_id").groupBy(id_col).agg(rows.alias("_r"))
    return packed.select(id_col, F.array_join(F.transform("_r", lambda x: F.concat(
        x["example_no"].cast("string"), F.lit(". "), x["_text"])), "\n").alias(out))


def screen(text: Column, min_words: int | None = 20, short_openers: bool = False, low: Column | None = None) -> Column:
    """True when a cleaned comment passes: not empty, no banned opener / term / closer, enough words.

    Pass ``low`` (an already projected lower-case column) to evaluate ``lower`` once.
    """
    low = F.lower(text) if low is None else low
    starts = BANNED_STARTS_SHORT if short_openers else BANNED_STARTS
    quoted = lambda items: "(?:" + "|".join("\\Q" + x + "\\E" for x in items) + ")"
    pattern = rf"\A{quoted(starts)}|{quoted(BANNED_CONTAINS)}|{quoted(BANNED_ENDS)}\z"
    bad = text.isNull() | (F.length(text) == 0) | low.rlike(pattern)
    if min_words:
        bad = bad | (F.size(words(text)) < min_words)
    return ~bad


def screen_comments(attempts: DataFrame, setting: str, text_col: str = "text") -> DataFrame:
    """Clean every attempt with the setting's quote rule, then screen it."""
    spec = {s[0]: s for s in SETTINGS}[setting]
    cleaned = attempts.withColumn("clean_text", strip_quotes(text_col, spec[5])).withColumn(
        "_low", F.lower("clean_text"))
    ok = screen(F.col("clean_text"), spec[4], spec[6] == "short", low=F.col("_low"))
    return cleaned.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_low")


def first_valid_attempt(attempts: DataFrame, setting: str, prompt_col: str = "prompt_id", attempt_col: str = "attempt",
                        text_col: str = "text") -> DataFrame:
    """Per prompt: the first accepted attempt within the setting's try limit, else the sentinel.

    The choice is a partial aggregate (min attempt), so a prompt with many
    attempts never lands in a single sorted task.
    """
    spec = {s[0]: s for s in SETTINGS}[setting]
    s = screen_comments(attempts, setting, text_col)
    ok = F.col("accepted") & (F.col(attempt_col) <= spec[3])
    one = F.struct(F.col(attempt_col).alias("attempt"), F.col("clean_text").alias("text"))
    first = s.groupBy(prompt_col).agg(F.min(F.when(ok, one)).alias("first"))  # no filter: screened once per attempt
    return first.select(prompt_col, F.col("first.attempt").alias("accepted_attempt"),
                        F.coalesce(F.col("first.text"), F.lit(NO_COMMENT)).alias("Generated Text"))


def first_valid_attempts(attempts: DataFrame, settings: Sequence[str], prompt_col: str = "prompt_id", attempt_col: str = "attempt",
                         text_col: str = "text") -> DataFrame:
    """``first_valid_attempt`` for several settings in one pass and one shuffle: (prompt, setting, accepted_attempt, Generated Text)."""
    spec = {s[0]: s for s in SETTINGS}
    kinds = sorted({spec[s][5] for s in settings})
    cleaned = attempts.select(prompt_col, attempt_col, *[strip_quotes(text_col, k).alias(f"_c{k}") for k in kinds])
    cleaned = cleaned.select("*", *[F.lower(f"_c{k}").alias(f"_l{k}") for k in kinds])
    firsts = []
    for s in settings:
        _, _, _, tries, words_at_least, kind, openers = spec[s]
        ok = F.coalesce(screen(F.col(f"_c{kind}"), words_at_least, openers == "short", low=F.col(f"_l{kind}")), F.lit(False))
        one = F.struct(F.col(attempt_col).alias("attempt"), F.col(f"_c{kind}").alias("text"))
        firsts.append(F.min(F.when(ok & (F.col(attempt_col) <= tries), one)).alias(f"_f{s}"))
    got = cleaned.groupBy(prompt_col).agg(*firsts)
    got = got.select(prompt_col, F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.col(f"_f{s}").alias("first")) for s in settings])).alias("_x"))
    return got.select(prompt_col, F.col("_x.setting").alias("setting"), F.col("_x.first.attempt").alias("accepted_attempt"),
                      F.coalesce(F.col("_x.first.text"), F.lit(NO_COMMENT)).alias("Generated Text"))


def with_results(profiles: DataFrame, results: DataFrame, id_col: str, key: str = "prompt_id", out: str = "_results") -> DataFrame:
    """``profiles`` with the map setting -> generated text of ``first_valid_attempts`` rows, at most one entry a setting.

    Joined before ``build_variants`` multiplies the rows: prompts, which repeat a profile's texts in every variant, are never shuffled.
    """
    packed = results.groupBy(F.col(key).alias(id_col)).agg(F.map_from_entries(F.collect_list(F.struct("setting", "Generated Text"))).alias(out))
    return profiles.join(packed, id_col, "left")


def generation_records(prompts: DataFrame, id_cols: Sequence[str], results_col: str = "_results") -> DataFrame:
    """Result rows of ``build_variants`` rows over ``with_results`` profiles: ids, profile columns, persona, prompt, generated
    text, sampler settings, model base name, setting, control.

    Control records carry the condition as the positive ones do (it is in the profile; published so).
    """
    text = F.try_element_at(F.col(results_col), F.col("setting"))
    return prompts.select(*id_cols, F.col("age").alias("Age"), F.col("gender").alias("Gender"),
                          F.col("education").alias("Education"), F.col("occupation").alias("Occupation"),
                          F.array_join("interests", ", ").alias("Interests"), F.col("subreddit").alias("Subreddit"),
                          F.col("nationality").alias("Nationality"), F.col("marital_status").alias("Marital Status"),
                          F.col("condition").alias("Condition"), F.col("persona_line").alias("Persona"), "Prompt",
                          F.coalesce(text, F.lit(NO_COMMENT)).alias("Generated Text"),
                          *SAMPLER_NAMES, "model", "setting", "control")


def generation_error_rate(df: DataFrame, text_col: str = "text", group_cols: Sequence[str] = ()) -> DataFrame:
    err = F.coalesce(F.col(text_col).startswith(ERROR_PREFIX), F.lit(False))
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"), F.count_if(err).alias("errors"),
                                       (F.count_if(err) / F.count(F.lit(1))).alias("error_rate"))
