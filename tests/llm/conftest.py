import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (None, None), (None, "a b c d e"), (1, ""), (1, ""), (2, LONG), (3, "same text here"), (3, "same text here"), (4, "same\ttext  here"),
    (5, "x\ny\nz\nx\ny\nz"), (6, "mail a.b@c.org or +1 (212) 555-0100 now"), (7, "日本語 テキスト é\x85ß"), (8, "\n\n\n"), (2, "other text, same id"),
]
EXTRA = ["digest", "fp", "kept", "score", "slot", "shard", "row", "line", "window", "key", "part", "lang", "bucket", "sequence_id", "stratum", "base", "added", "tail", "__id", "__digest", "spans"]


def frame(spark, rows):
    extra = {name: i for i, name in enumerate(EXTRA)}
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(d, t, None, None, *[f"x{i}" for i in extra.values()]) for d, t in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ids that repeat with another text, extra columns with clashing names."""
    return frame(spark, ROWS).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
