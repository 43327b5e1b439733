"""Refusals, null keys, tolerant JSON lines, cuts, and every oracle at the smallest scale."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import model as M
from postlens.operators import prep, sampling
from postlens.operators import prompts as P
from postlens.operators import windows as W
from postlens.operators.ordered import running_sum
from postlens.sources import files

from conftest import SF001


def test_strict_calls_are_refused(spark):
    df = spark.createDataFrame([(str(i), f"{i}_1") for i in range(5)], "user_id string, TID string").withColumn("ord", F.col("TID"))
    with pytest.raises(ValueError):
        sampling.sample_user_posts(df, n=100)
    with pytest.raises(ValueError):
        sampling.first_n_matching(df, F.lit(True), n=6)
    assert sampling.sample_user_posts(df, n=5).count() == 5
    with pytest.raises(Exception, match="too few"):
        prep.enforce(df, F.lit(False), "too few").count()
    assert prep.enforce(df, F.lit(True), "too few").count() == 5


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(20)], "id int, y string")
    out = running_sum(df, ["y"], ["id"], F.lit(1), "n", key_total="all", num_partitions=4)
    assert out.count() == 20 and out.where("y is null").agg(F.max("n"), F.max("all")).first()[:] == (4, 4)
    assert sampling.class_sample(df, 1.0, label_col="y", key_cols=["id"]).count() == 20
    assert M.stratified_split(df, "y", ["id"], 42).count() == 20


def test_tolerant_json_lines_keep_every_object(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user_id": "a", "created_utc": 1600000000}\n{"user_id": 7, "created_utc": 1600000000.0}\n'
                                      '{"user_id": "c", "created_utc": "1600000000", "text": "x"}\n{"user_id": "d"\n\n[1]\nnonsense\n{}\n')
    from postlens.plans.q_io import JSONL_SCHEMA
    rows = files.read_jsonl_tolerant(spark, str(tmp_path), JSONL_SCHEMA, {"user_id": "", "text": "", "created_utc": 0}).collect()
    assert sorted((r.user_id, r.text, r.created_utc) for r in rows) == [
        ("", "", 0), ("7", "", 1600000000), ("a", "", 1600000000), ("c", "x", 1600000000)]


def test_separator_of_four_blanks_keeps_data_like_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a    b\n1    2\na    b\n3    \n")
    rows = files.read_detect_sep(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.a, r.b) for r in rows) == [("1", "2"), ("3", ""), ("a", "b")]


@pytest.mark.parametrize("limit,kept", [(1, 2), (2, 2), (3, 5), (6, 6), (7, 7), (99, 7)])
def test_cut_after_the_users_run(spark, limit, kept):
    tids = ["a_1", "a_2", "b_1", "b_2", "b_3", "a_3", "c_1"]
    df = spark.createDataFrame(list(enumerate(tids)), "ord int, TID string").repartition(3)
    assert sorted(r.ord for r in W.cut_whole_user(df, ["ord"], limit).collect()) == list(range(kept))


def test_first_valid_attempt_plan_screens_once(spark):
    df = spark.createDataFrame([(1, 1, "x")], "prompt_id int, attempt int, text string")
    out = P.first_valid_attempt(df, "MAFS")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 10


#: Fits and encoders take long here and have tests of their own.
SLOW = {"rf_grid_search"}


def test_every_oracle_at_the_smallest_scale(spark):
    import duckdb

    from postlens.plans.catalog import ORACLES, QUERIES
    from scripts.check_oracles import TABLES, norm
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    wrong = []
    for key in sorted(set(ORACLES) - SLOW):
        df = QUERIES[key](spark, SF001)
        cur = con.execute(ORACLES[key])
        cols = [c[0] for c in cur.description]
        want = sorted(repr(tuple(norm(x) for x in r)) for r in cur.fetchall())
        got = sorted(repr(tuple(norm(x) for x in r)) for r in df.select(*cols).collect()) if sorted(cols) == sorted(df.columns) else None
        if want != got:
            wrong.append(key)
    assert not wrong


def test_text_column_falls_back(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "z", None)], "ord int, comment_text string, other string")
    assert [r.text for r in prep.resolve_text(df, ["ord"]).orderBy("ord").collect()] == ["x", "z"]
    assert [r.text for r in prep.resolve_text(df.drop("comment_text"), ["ord"]).orderBy("ord").collect()] == ["Comment 0", "Comment 1"]


def test_retrieval_takes_text_ids(spark):
    from postlens.operators import vectors as VEC
    members = spark.createDataFrame([(f"u_{i}", [float(i % 7), 1.0, float(i)], 1) for i in range(40)],
                                    "vec_id string, embedding array<double>, cluster long")
    req = spark.createDataFrame([("p_1", 1, [1.0, 1.0, 5.0])], "persona_id string, cluster long, _p array<double>")
    top = VEC.cluster_top_n(req, members, 3, block_size=8).orderBy("rank").collect()
    ext = VEC.cluster_extremes(req, members, block_size=8).first()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].member_id == ext.most_id and top[0].sim >= top[1].sim >= top[2].sim


def test_final_model_refits_the_best_grid_point(spark, monkeypatch):
    from postlens.operators import model as M
    from postlens.plans.q_models import q_final_model

    found = {"n_estimators": 3, "max_depth": 2, "min_samples_split": 5, "min_samples_leaf": 2, "dev_f1": 0.5}
    fit, used = M.final_fit, []
    monkeypatch.setattr(M, "rf_grid_search", lambda *a, **k: ([found], found))
    monkeypatch.setattr(M, "final_fit", lambda *a: used.append(a[4]) or fit(*a))
    assert q_final_model(spark, SF001).count() == 5
    assert used == [found]


def test_tf_idf_keeps_heavy_terms_out_of_the_shuffle(spark):
    from postlens.operators.lexical import tf_idf
    docs = spark.createDataFrame([(i, ["the", "of", f"w{i % 37}", f"x{i}", "the"]) for i in range(400)], "d long, tokens array<string>").repartition(5)
    got = tf_idf(docs, "d", heavy_terms=10)
    rows = {(r.d, r.term): (r.tf, r.df) for r in got.collect()}
    assert len(rows) == 1600 and rows[3, "the"] == (2, 400) and rows[3, "of"] == (1, 400) and rows[3, "x3"] == (1, 1) and rows[3, "w3"] == (1, 11)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert tf_idf(docs, "d", heavy_terms=1).count() == tf_idf(docs, "d", heavy_terms=100_000).count() == 1600
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
