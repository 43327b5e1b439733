"""Encoders, projection and linear models against what they must satisfy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import model as M
from postlens.operators import vectors as V


def test_embed_text_is_the_unit_count_vector_of_its_words(spark):
    texts = ["red fish blue fish", "fish blue RED, fish!", "one two", None, "", "blue"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, text string, _keep string")
    out = V.embed_text(df, dim=4096)
    got = [np.array(r.embedding) for r in out.orderBy("i").collect()]
    assert out.columns == ["i", "text", "_keep", "embedding"]
    assert np.allclose(got[0], got[1]) and np.allclose(sorted(got[0][got[0] > 0]), np.array([1, 1, 2]) / np.sqrt(6))
    assert all(np.linalg.norm(g) == pytest.approx(1) for g in (got[0], got[2], got[5])) and not got[3].any() and not got[4].any()
    assert got[0] @ got[5] == pytest.approx(1 / np.sqrt(6)) and got[0] @ got[2] == 0


def test_projection_is_the_two_leading_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_id long, a double, b double, c double, d double")
    got = np.array([(r.pc1, r.pc2) for r in M.project_2d(df, ["a", "b", "c", "d"]).orderBy("user_id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, axes = np.linalg.eigh(z.T @ z)
    want = z @ axes[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_linear_models_fit_what_they_should(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (1.5 * x[:, 0] - x[:, 1] + 0.3 + 0.5 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, y long, a double, b double")
    w = np.zeros(3)  # the logistic regression itself, by Newton's method
    z = np.column_stack([x, np.ones(600)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z, z.T @ (p - y))
    got = {r.id: r.prediction for r in M.linear_model("logistic_regression", df, df, ["a", "b"]).collect()}
    assert np.mean([got[i] == (m > 0) for i, m in enumerate(z @ w)]) > 0.995
    svm = M.linear_model("linear_svm", df, df, ["a", "b"])
    assert svm.columns == ["id", "y", "a", "b", "model", "prediction"] and svm.where(F.col("prediction") == F.col("y")).count() > 520
