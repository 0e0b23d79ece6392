import pytest

#: id, text, source: nulls, empty texts, white space, ties, repeated rows, a long text, disguises and shared passages.
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "The cat sat on the mat and then it went home again today", "a"),
    (2, "The  cat sat\ton the mat and then it went home again today", "b"),
    (3, None, "a"),
    (4, "", None),
    (5, " \n ", "a"),
    (6, "one", "b"),
    (7, "start here " + PASSAGE + " end here", "a"),
    (8, "other words " + PASSAGE + " stop there", "c"),
    (8, "other words " + PASSAGE + " stop there", "c"),
    (9, PASSAGE, "a"),
    (None, PASSAGE, "a"),
    (10, "é ü 日本語 <|endoftext|> it's 123 ½ 'll \x1c x y", "b"),
    (11, "a" * 5000, "a"),
    (12, " ".join(f"v{i % 97}" for i in range(20000)), "a"),
    (6, "two different", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    rows = [(i, t, "en", s, len(t or ""), 0.5, "x", 7) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, id long").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def rows():
    return ROWS
