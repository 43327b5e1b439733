from pyspark.sql import functions as F

from postlens.operators import prompts as P


def test_every_setting_builds_both_variants(spark):
    df = spark.createDataFrame([(k, "25", "male", "Canada", "nurse", "single", ["chess", "music"], "books", "Bipolar Disorder", " a reader ")
                                for k in (9, 10)], "prompt_index long, age string, gender string, nationality string, occupation string, "
                               "marital_status string, interests array<string>, subreddit string, condition string, persona_text string")
    for setting, *_ in P.SETTINGS:
        for control in (False, True):
            df2 = df.withColumn("ex", P.examples_block(setting, control, F.lit("1. one"), F.lit("1. two"))) if setting in P.EXAMPLES_INTRO else df
            rows = P.build_prompts(df2, setting, examples_col="ex" if setting in P.EXAMPLES_INTRO else None, control=control).orderBy(
                "prompt_index").collect()
            plain, diverse = rows[0].Prompt, rows[1].Prompt
            assert "{" not in plain and "books" in plain and len(diverse) > len(plain)
            assert ("40" in plain) == control
            assert ("diagnosed with" in rows[0].persona_line) == (not control and P.PERSONA_STYLE[setting] != "inferred")
            assert ("1. one" in plain) == (setting in P.EXAMPLES_INTRO)


def test_few_shot_texts_are_joined_back(spark):
    ex = spark.createDataFrame([("p", 2, "u_1"), ("p", 1, "u_2")], "persona_id string, example_no long, member_id string")
    members = spark.createDataFrame([("u_1", "b"), ("u_2", "a"), ("u_3", "c")], "vec_id string, text string")
    assert P.few_shot_texts(ex, members).collect()[0][:] == ("p", "1. a\n2. b")
