import pytest

from matchspark.llm.common import on_workers  # noqa: F401

ODD = [
    (1, "The same short words again and again in one text of some length."),
    (1, "The same short words again and again in one text of some length."),
    (2, "The same short words again and again in one text of some length."),
    (3, ""),
    (4, None),
    (None, "A row without an id has words too, and more of them."),
    (5, " \n\t \x0b\x0c\r "),
    (6, "x" * 30_000),
    (7, "long tail words " * 20_000),
    (8, "Ünïcode ßtraße 東京 🙂 mail a.b@c.example.org"),
    (9, "\x00\x01 control \u2028 separators\u00a0here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns whose names could clash."""
    on_workers(spark)
    names = ("_label", "_copy", "_first", "key", "row", "text2", "fp", "node", "component_id", "score", "label", "salt", "bucket", "n", "a", "b")
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "src", None if k % 4 == 0 else 1, *(["clash"] * len(names))) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (7, 1, 0, None), (8, 0, 1, None)], "doc_id long, quality int, toxic int, text string")
