import corpus_pipeline as C
from odd_rows import SF001, docs, labels, none  # noqa: F401
from postlens.llm import queries as Q
from postlens.llm.common import stored


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    cols, kept = docs.columns, docs
    for name, stage in C.STAGES:
        before, kept = kept, stored(stage(spark, kept, SF001), name)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != C.STAGES[-1][0]:
            assert kept.columns == cols and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert kept.count() == len(ids)
    assert kept.count() == C.run(spark, SF001).count()


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0


def test_every_query_is_registered_once():
    names = sorted(Q.QUERIES, key=lambda k: int(k[2:].split("_")[0]))
    assert [k.split("_")[0] for k in names] == [f"op{n}" for n in range(1, 14)]
    assert set(Q.ORACLES) <= set(Q.QUERIES) and len(C.STAGES) == 5
