"""Rows that every operator must take."""

import pytest

SF001 = "/root/testdata/sf0.001"

#: Odd texts every operator must take: null, empty, blanks, one word, non-ASCII, upper case, repeats, a very long one.
ODD = [None, "", "  \n\t ", "word", "Été ÜBER ñandú straße", "A b C a B c", "A b C a B c", "x" * 5000, "lorem ipsum " * 40_000,
       "1.2.3.4 and a@b.co", "日本語 テキスト 😀", "same same same same same same same same"]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd texts with repeated and null ids, and columns whose names could clash with an operator's own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (4, "other text of the same id"), (None, "no id here")]
    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", len(t or ""), k, "q") for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long, score int, id string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 11)) for i in range(12)] + [(None, 1, 1), (99, None, None)],
                                 "doc_id long, quality int, toxic int")
