"""The trained encoder against numpy, and against hashed counts."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import encoder as E
from postlens.operators import vectors as V

SF001 = "/root/testdata/sf0.001"


def dense(texts, idf):
    x = np.zeros((len(texts), len(idf)))
    for k, t in enumerate(texts):
        idx, val = E.weighed(t, idf)
        x[k, idx] = val
    return x


def test_axes_are_the_leading_directions(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").repartition(5)
    enc = E.train_encoder(df, dim=6, buckets=512, passes=12, extra=30)
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    x = dense(texts, enc.idf)
    values, axes = np.linalg.eigh(x.T @ x)
    assert np.allclose(enc.values, values[::-1][:6], rtol=1e-4)
    assert np.allclose(np.linalg.svd(enc.axes.T @ axes[:, ::-1][:, :6])[1], 1, atol=1e-3)  # the same subspace
    got = np.array([r.embedding for r in enc.encode(df).orderBy("doc_id").collect()])
    want = x @ enc.axes
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-9)


def test_related_texts_without_shared_words_come_closer(spark):
    rng = np.random.default_rng(1)
    topics = [[f"{a}{i}" for i in range(30)] for a in "xyz"]
    texts = [" ".join(rng.choice(topics[k % 3], 12)) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    enc = E.train_encoder(df, dim=3, buckets=1024)
    pair = spark.createDataFrame([(0, " ".join(topics[0][:6])), (1, " ".join(topics[0][20:26])), (2, " ".join(topics[1][:6])), (3, None), (4, "")], "i long, text string")
    a = [np.array(r.embedding) for r in enc.encode(pair).orderBy("i").collect()]
    b = [np.array(r.embedding) for r in V.embed_text(pair).orderBy("i").collect()]
    assert a[0] @ a[1] > 0.8 > 0.3 > abs(a[0] @ a[2]) and b[0] @ b[1] < 0.3
    assert not a[3].any() and not a[4].any()
    empty = E.train_encoder(df.where("false"), dim=3, buckets=64)
    assert not empty.axes.any() and enc.encode(df.where("false")).count() == 0


def test_texts_are_read_once_to_train(spark):
    read = spark.sparkContext.accumulator(0)
    texts = F.udf(lambda i: read.add(1) or (None if i == 7 else " ".join(f"w{i % k}" for k in range(1, 40))))
    df = spark.range(60, numPartitions=3).select(texts("id").alias("text"))
    enc = E.train_encoder(df, dim=5, buckets=256, passes=3)
    assert read.value == 60
    got = E.counted("b a B c", 256)
    assert got[0].tolist() == sorted(zlib.crc32(w) % 256 for w in (b"a", b"b", b"c")) and sorted(got[1]) == [1, 1, 1 + np.log(2)]
    x = dense([r.text for r in df.collect()], enc.idf)
    q = np.random.default_rng(1).normal(size=(256, 4))
    rows = spark.createDataFrame([(i.tolist(), v.tolist()) for i, v in (E.weighed(r.text, enc.idf) for r in df.collect()) if len(i)], "idx array<int>, val array<double>")
    assert np.allclose(E.gram_times(rows, q), x.T @ (x @ q))
