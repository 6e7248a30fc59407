import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(words, k):
    """A copy with every k-th word replaced."""
    return " ".join(f"alt{i}" if i % k == k - 1 else w for i, w in enumerate(words))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with the cases that every operator must stand: nulls, empty, long, repeated, copies."""
    base = [f"word{(i * 7919) % 991}" for i in range(120)]
    other = [f"term{(i * 104729) % 997}" for i in range(90)]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, near(base, 60)), (4, near(base, 3)), (5, " ".join(other)), (6, " ".join(other).upper()),
        (7, ""), (8, None), (9, "   \n\t "), (10, "one"), (11, "one"), (12, "one two"), (None, "a text without an id but with words"), (14, "é日本 ▁x\x00   😀" * 3),
        (15, " ".join(f"w{i}" for i in range(60_000))), (16, "x" * 300_000), (17, "the end"), (17, "the end"), (-5, "minus five is an id too"),
    ]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with further columns under names that operators use."""
    from pyspark.sql import functions as F

    names = ("score", "row", "found", "node", "pii", "key", "bucket", "comp", "component_id", "kept", "raw", "pieces", "stats", "__row", "__t", "__cut", "n_words", "label", "id", "block")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])

