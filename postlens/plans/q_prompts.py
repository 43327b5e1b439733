"""Catalog: profile sampling, persona lines, prompts, screening, first valid attempt."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import prompts as P
from postlens.operators import sampling
from postlens.operators.ordered import md5_rank_key_sql, row_position
from postlens.plans import q_models
from postlens.plans import views as V
from postlens.plans.oracle_text import strip_quotes_sql
from postlens.plans.oracle_views import define, sql_list, sql_str, with_views
from postlens.plans.registry import query

SEED = 42
PROFILE_FIELDS = [f for f in P.PROFILE_LISTS if f != "interests"]


def profiles(spark, d):
    p = V.v_personas(spark, d)
    p = row_position(p, ["persona_id"], out="prompt_index")
    return P.sample_profiles(p, "persona_id", SEED)


_fields_sql = ",\n".join(
    f"({sql_list(P.PROFILE_LISTS[f])})[CAST({md5_rank_key_sql(SEED, 'p.persona_id', sql_str(f))} % {len(P.PROFILE_LISTS[f])} AS INTEGER) + 1] AS {f}"
    for f in PROFILE_FIELDS)
define("prof", ["v_personas"], f"""
SELECT p.persona_id, p.persona_text, CAST(row_number() OVER (ORDER BY p.persona_id) AS BIGINT) AS prompt_index,
       {_fields_sql}, i.interests, 'Bipolar Disorder' AS condition
FROM v_personas p JOIN (
  SELECT persona_id, string_agg(v, ', ' ORDER BY r) AS interests FROM (
    SELECT persona_id, v, row_number() OVER (PARTITION BY persona_id
             ORDER BY {md5_rank_key_sql(SEED, 'persona_id', "'interests'", 'v')}, v) AS r
    FROM (SELECT persona_id, unnest({sql_list(P.PROFILE_LISTS['interests'])}) AS v FROM v_personas))
  WHERE r <= {P.N_INTERESTS} GROUP BY persona_id) i ON i.persona_id = p.persona_id""")


@query("sample_profiles", with_views("prof") + "SELECT persona_id, " + ", ".join(PROFILE_FIELDS) +
       ", interests, condition FROM prof")
def q_sample_profiles(spark, d):
    p = profiles(spark, d)
    return p.select("persona_id", *PROFILE_FIELDS, F.array_join("interests", ", ").alias("interests"), "condition")


def _strip_sql(x):
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


PERSONA_SQL = {
    "attribute_mistral": ("'Your age is: ' || age || '. You are a ' || gender || ' from ' || nationality || "
                          "'. Your occupation is: ' || occupation || '. Your marital status is: ' || marital_status || "
                          "'. Your interests are: ' || interests || '.' || ' You are diagnosed with the condition: ' || "
                          "condition || '.'"),
    "attribute_llama": ("'You are a ' || age || '-year-old ' || gender || ' from ' || nationality || ', ' || "
                        "marital_status || ', working as a ' || occupation || ', interested in ' || interests || "
                        "', diagnosed with ' || condition || ' (do not mention the diagnosis or mental health in your comment).'"),
    "inferred": f"'You are ' || {_strip_sql('persona_text')}",
    "reddit_user": "'You are a Reddit user with the following persona: ' || persona_text || '. You are diagnosed with Bipolar Disorder.'",
}


@query("persona_line", with_views("prof") + "SELECT persona_id, " + ", ".join(
    f"{expr} AS {name}" for name, expr in PERSONA_SQL.items()) + " FROM prof")
def q_persona_line(spark, d):
    p = profiles(spark, d)
    return p.select("persona_id", *[P.persona_line(s).alias(s) for s in PERSONA_SQL])


def numbered(spark, d, post: bool):
    """Three sampled posts of one kind, numbered (one value)."""
    posts = V.v_posts(spark, d)
    kind = F.col("type") == "post" if post else F.col("type") != "post"
    return sampling.numbered_block(sampling.sample_texts(posts.where(kind), 3, SEED, key_col="TID")).scalar()


def _numbered_sql(cond: str) -> str:
    return f"""(SELECT string_agg(CAST(n AS VARCHAR) || '. ' || text, chr(10) ORDER BY n) FROM (
      SELECT row_number() OVER (ORDER BY h, TID) AS n, text FROM (
        SELECT TID, text, {md5_rank_key_sql(SEED, 'TID')} AS h FROM v_posts WHERE text IS NOT NULL AND {cond}
        ORDER BY h, TID LIMIT 3)))"""


CONTROL_PERSONA_SQL = {
    "attribute_mistral": PERSONA_SQL["attribute_mistral"].replace("'.' || ' You are diagnosed with the condition: ' || condition || '.'", "'. '"),
    "attribute_llama": PERSONA_SQL["attribute_llama"].replace("', interested in '", "', and interested in '").replace(
        "', diagnosed with ' || condition || ' (do not mention the diagnosis or mental health in your comment).'", "'.'"),
    "inferred": PERSONA_SQL["inferred"],
    "reddit_user": "'You are a Reddit user with the following persona: ' || persona_text || '.'",
}
RETRIEVED = ("IFS", "MIFS")  # settings whose examples are the persona's own six retrieved texts
VARIANTS = [(s[0], c) for s in P.SETTINGS for c in (False, True)]


def _prompt_expr(setting: str, control: bool) -> str:
    """The template with its marks replaced one after the other, as a script would format it."""
    if setting in ("AFS", "MAFS") and not control:
        ex = (f"{sql_str(P.EXAMPLES_INTRO[setting][0] + P.EXAMPLES_POSITIVE)} || pos || "
              f"{sql_str(chr(10) * 2 + P.EXAMPLES_CONTROL)} || ctl || {sql_str(chr(10) * 2)}")
    elif setting in P.EXAMPLES_INTRO:
        ex = f"{sql_str(P.EXAMPLES_INTRO[setting][control])} || {'few' if setting in RETRIEVED else 'ctl'} || {sql_str(chr(10) * (1 if setting == 'MIFS' else 2))}"
    else:
        ex = "''"
    k = {s[0]: s[2] for s in P.SETTINGS}[setting]
    div = f"CASE WHEN prompt_index % {k} = 0 THEN {sql_str(P.diversity_text(setting))} ELSE '' END"
    persona = (CONTROL_PERSONA_SQL if control else PERSONA_SQL)[P.PERSONA_STYLE[setting]]
    out = sql_str(P.prompt_template(setting, control))
    for mark, value in (("diversity", div), ("sub", "subreddit"), ("persona", persona), ("examples", ex)):
        out = f"replace({out}, '{{{mark}}}', {value})"
    return out


def _prompt_sql(setting: str, control: bool) -> str:
    return (f"SELECT persona_id, '{setting}' AS setting, {str(control).lower()} AS control, "
            f"{_prompt_expr(setting, control)} AS Prompt FROM pf, b")


EXAMPLES_SQL = f""", b AS (SELECT {_numbered_sql("type = 'post'")} AS pos, {_numbered_sql("type <> 'post'")} AS ctl),
fs AS (SELECT f.persona_id, string_agg(CAST(f.example_no AS VARCHAR) || '. ' || t.text, chr(10) ORDER BY f.example_no) AS few
  FROM fse f JOIN v_member_texts t ON t.vec_id = f.member_id GROUP BY f.persona_id),
pf AS (SELECT prof.*, fs.few FROM prof LEFT JOIN fs USING (persona_id))
"""


def variants(spark, d, results=None):
    """All sixteen variants: eight settings, positive and control; retrieved texts where the setting asks for them."""
    few = P.few_shot_texts(q_models.few_shot(spark, d), V.v_member_texts(spark, d), out="_few")
    p = profiles(spark, d).join(few, "persona_id", "left").withColumn("_pos", numbered(spark, d, True)).withColumn("_ctl", numbered(spark, d, False))
    p = p if results is None else P.with_results(p, results, "persona_id")
    examples = {}
    for setting, control in VARIANTS:
        if setting in P.EXAMPLES_INTRO:
            first = "_few" if setting in RETRIEVED else "_ctl" if control else "_pos"
            examples[setting, control] = P.examples_block(setting, control, F.col(first), F.col("_ctl"))
    return P.build_variants(p, VARIANTS, examples)


@query("few_shot_texts", with_views("fse", "v_member_texts") + """
SELECT f.persona_id, string_agg(CAST(f.example_no AS VARCHAR) || '. ' || t.text, chr(10) ORDER BY f.example_no) AS examples
FROM fse f JOIN v_member_texts t ON t.vec_id = f.member_id GROUP BY f.persona_id""")
def q_few_shot_texts(spark, d):
    """Each persona's six retrieved texts, numbered."""
    return P.few_shot_texts(q_models.few_shot(spark, d), V.v_member_texts(spark, d))


@query("build_prompts", with_views("prof", "v_posts", "fse", "v_member_texts") + EXAMPLES_SQL + " UNION ALL ".join(_prompt_sql(*v) for v in VARIANTS))
def q_build_prompts(spark, d):
    """All sixteen variants: eight settings, positive and control."""
    return variants(spark, d).select("persona_id", "setting", "control", "Prompt")


def _screen_sql(text: str, min_words: int, short: bool) -> str:
    starts = P.BANNED_STARTS_SHORT if short else P.BANNED_STARTS
    low = f"lower({text})"
    bad = [f"{text} IS NULL", f"length({text}) = 0"]
    bad += [f"starts_with({low}, {sql_str(s)})" for s in starts]
    bad += [f"contains({low}, {sql_str(s)})" for s in P.BANNED_CONTAINS]
    bad += [f"ends_with({low}, {sql_str(s)})" for s in P.BANNED_ENDS]
    if min_words:
        bad.append(rf"len(regexp_extract_all({text}, '[^\s\x1c-\x1f]+')) < {min_words}")
    return "NOT coalesce(" + " OR ".join(bad) + ", false)"


def _screened_sql(setting: str) -> str:
    spec = {s[0]: s for s in P.SETTINGS}[setting]
    return f"""(SELECT prompt_id, attempt, clean_text, {_screen_sql('clean_text', spec[4], spec[6] == 'short')} AS accepted
     FROM (SELECT prompt_id, attempt, {strip_quotes_sql('text', spec[5])} AS clean_text FROM v_generated))"""


@query("screen_comments", with_views("v_generated") + "SELECT *, 'MAFS' AS setting FROM " + _screened_sql("MAFS") +
       " UNION ALL SELECT *, 'MIFS' FROM " + _screened_sql("MIFS"))
def q_screen_comments(spark, d):
    g = V.v_generated(spark, d)
    out = None
    for s in ("MAFS", "MIFS"):
        x = P.screen_comments(g, s).select("prompt_id", "attempt", "clean_text", "accepted", F.lit(s).alias("setting"))
        out = x if out is None else out.unionByName(x)
    return out


def _first_sql(setting: str) -> str:
    spec = {s[0]: s for s in P.SETTINGS}[setting]
    return f"""(SELECT p.prompt_id, f.attempt AS accepted_attempt, coalesce(f.clean_text, {sql_str(P.NO_COMMENT)}) AS "Generated Text",
       {sql_str(setting)} AS setting
     FROM (SELECT DISTINCT prompt_id FROM v_generated) p LEFT JOIN (
       SELECT prompt_id, attempt, clean_text FROM (
         SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY attempt) AS rn FROM {_screened_sql(setting)}
         WHERE accepted AND attempt <= {spec[3]}) WHERE rn = 1) f ON f.prompt_id = p.prompt_id)"""


@query("first_valid_attempt", with_views("v_generated") + "SELECT * FROM " + _first_sql("MAFS") +
       " UNION ALL SELECT * FROM " + _first_sql("MIZS"))
def q_first_valid_attempt(spark, d):
    g = V.v_generated(spark, d)
    out = None
    for s in ("MAFS", "MIZS"):
        x = P.first_valid_attempt(g, s).withColumn("setting", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out


def _record_sql(setting: str, control: bool) -> str:
    persona = (CONTROL_PERSONA_SQL if control else PERSONA_SQL)[P.PERSONA_STYLE[setting]]
    sampler = P.SAMPLER_CONTROL.get(setting, P.SAMPLER[setting]) if control else P.SAMPLER[setting]
    model = {s[0]: s[1] for s in P.SETTINGS}[setting]
    return f"""
SELECT persona_id, age AS Age, gender AS Gender, education AS Education, occupation AS Occupation, interests AS Interests,
       subreddit AS Subreddit, nationality AS Nationality, marital_status AS "Marital Status", condition AS Condition,
       ({persona}) AS Persona, {_prompt_expr(setting, control)} AS Prompt,
       coalesce(r."Generated Text", {sql_str(P.NO_COMMENT)}) AS "Generated Text",
       {", ".join(f"CAST({v} AS {'INTEGER' if isinstance(v, int) else 'DOUBLE'}) AS {n}" for v, n in zip(sampler, P.SAMPLER_NAMES))},
       '{model}' AS model, '{setting}' AS setting, {str(control).lower()} AS control
FROM b, pf LEFT JOIN {_first_sql(setting)} r ON r.prompt_id = pf.persona_id"""


@query("generation_records", with_views("prof", "v_posts", "fse", "v_member_texts", "v_generated") + EXAMPLES_SQL
       + " UNION ALL ".join(_record_sql(*v) for v in VARIANTS))
def q_generation_records(spark, d):
    """Result records of all sixteen variants, positive and control."""
    res = P.first_valid_attempts(V.v_generated(spark, d), [s[0] for s in P.SETTINGS])
    return P.generation_records(variants(spark, d, res), ["persona_id"])


@query("generation_error_rate", with_views("v_generated") + """
SELECT count(*) AS rows, count(*) FILTER (WHERE starts_with(text, '[Error')) AS errors,
       count(*) FILTER (WHERE starts_with(text, '[Error')) / count(*) AS error_rate FROM v_generated""")
def q_generation_error_rate(spark, d):
    return P.generation_error_rate(V.v_generated(spark, d))
