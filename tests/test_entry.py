import __spark_entry__ as E
from conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "posts", "words", "avg_words"]
    assert df.count() >= 0


def test_every_query_has_callable_and_oracles_match_keys():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 90


def test_small_queries_run_on_smallest_data(spark):
    for key in ["user_word_stats", "segment_posts", "latest_disclosure", "few_shot_examples", "feature_distance_summary"]:
        E.queries()[key](spark, SF001).count()
