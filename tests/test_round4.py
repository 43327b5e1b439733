"""Findings of the third review: rows of this file's own making."""

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import prompts as P
from postlens.operators import vectors as V


def vectors(spark, x, labels, names=("vec_id", "embedding", "cluster")):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))],
                                 f"{names[0]} long, {names[1]} array<float>, {names[2]} long").repartition(3)


def test_search_leaves_winners_of_tiles_only(spark):
    """Evenly spread vectors: no request travels to each block it must see, and many tiles find what one finds."""
    rng = np.random.default_rng(3)
    x, xc = rng.normal(size=(900, 12)), np.arange(900) % 2
    members, req = vectors(spark, x, xc), vectors(spark, x[:300], xc[:300], ("persona_id", "_p", "cluster"))
    index = V.member_index(members, block_size=16)
    for tile, tiles in ((V.TILE, 1), (64, 8)):  # 450 members a cluster
        got = V._search(req, index, "persona_id", "cluster", 1, True, tile=tile)
        rows = got.collect()
        assert 0 < len(rows) <= 300 * 2 * tiles  # a row for every visited block before: over 10,000
        u = x.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for p in range(0, 300, 7):
            s = np.where(xc == xc[p], u @ u[p], np.nan)
            best, worst = max((r for r in rows if r.pid == p and r.high), key=lambda r: r.sim), min((r for r in rows if r.pid == p and not r.high), key=lambda r: r.sim)
            assert (best.member, worst.member) == (np.nanargmax(s), np.nanargmin(s))


def test_search_takes_vectors_that_are_not_finite_for_none(spark):
    members = vectors(spark, [[1, 0], [float("nan"), 1], [0, float("inf")], [1, 1]], [0, 0, 0, 0])
    got = V.cluster_extremes(vectors(spark, [[2, 0], [float("nan"), 1]], [0, 0], ("persona_id", "_p", "cluster")), members).collect()
    assert [(r.persona_id, r.most_id, r.least_id) for r in got] == [(0, 0, 3)]


def test_records_join_before_prompts_multiply(spark):
    settings = [s[0] for s in P.SETTINGS]
    profiles = P.sample_profiles(spark.createDataFrame([(1, "likes tea", 1), (2, None, 2)], "persona_id long, persona_text string, prompt_index long"), "persona_id")
    tries = spark.createDataFrame([(1, 1, "word " * 60)], "prompt_id long, attempt long, text string")
    made = P.build_variants(P.with_results(profiles, P.first_valid_attempts(tries, settings), "persona_id"), [(s, c) for s in settings for c in (False, True)])
    out = P.generation_records(made, ["persona_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the tree's first explode (of the variants) stands over the join: prompts are not shuffled
    assert min(k for k, x in enumerate(plan) if "Generate" in x) < min(k for k, x in enumerate(plan) if "Join" in x)
    rows = out.collect()
    assert len(rows) == 32
    texts = {(r["persona_id"], r["Generated Text"]) for r in rows}
    assert (2, P.NO_COMMENT) in texts and (1, ("word " * 60).strip()) in {(i, t.strip()) for i, t in texts}


def test_language_model_and_thresholds_use_every_training_row(spark):
    from postlens.llm import langid

    rng = np.random.default_rng(1)
    # every text has a letter of its own; before, one row in twenty was in no count
    rows = [(i, " ".join("".join(rng.choice(list("abcde" if i % 2 else "fghij"), 5)) for _ in range(8)) + " " + chr(0x4E00 + i), "en" if i % 2 else "xx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, F.lit(True))
    gram = [g for _, g, *_ in langid.ngrams([t.split()[-1].encode() for _, t, _ in rows], 1)][0]
    assert langid._find(m.grams[1][0], gram)[0].all()
    got = langid.calibration(langid.measured(docs, m, "doc_id", "text", [F.col("lang").alias("_lang")]), m.languages, m.languages)
    n = {r.k - len(langid.SETTINGS): r.v for r in got.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    assert n[0] == n[1] == 150 and np.isfinite(m.limits).all()  # rows of each language, none left out
    assert all(r.lang_pred == ("en" if r.id % 2 else "xx") and r.accepted for r in langid.predict(docs, m).collect())
