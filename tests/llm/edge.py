"""Rows that every operator on documents must take, and what they share."""

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use themselves
    "id long, `row` string, norm string, part int, run long, first boolean, `key` string, node string, "
    "size long, target double, share double, batch long, kind string, `a.b` string"
)
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "Same  text\nhere"),
    (7, "Same text here"), (7, "Same text here"), (None, "Same text here"), (None, None),
    (8, LONG), (9, LONG), (10, "same TEXT here"), (11, "tie"), (11, "tie two"), (12, "é 😀 ñandú"),
    (13, "a. b. c."), (14, "12.12.12.12 x@y.zz +49 170 1234567 4111 1111 1111 1111"),
]


def rows(spark, texts=None):
    sources = ["a", "b", None, ""]
    data = [
        (i, t, None, sources[k % 4], None, k, None, "n", k, k, True, "k", "n", k, 1.0, 0.5, k, None, "d")
        for k, (i, t) in enumerate(TEXTS if texts is None else texts)
    ]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return rows(spark, [])


def written(spark, frame, folder):
    """As a table that a query reads."""
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same(got, wanted):
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, wanted), key=key)


approx = pytest.approx
