import pytest

from tidemark.llm.common import on_workers


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    """Python workers find the package wherever the tests start from."""
    on_workers(lambda s: None)(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A few awkward documents, with columns that clash with working columns."""
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(words[100:220])
    rows = [
        (1, None, "en", None, 0, "x", 1),
        (2, "", "en", "a", 0, "x", 2),
        (3, " \n\t ", None, "a", 3, "x", None),
        (4, " ".join(words[:60]), "en", "a", 0, "x", 3),
        (4, " ".join(words[:60]), "en", "a", 0, "x", 3),
        (5, "lead " + passage + " tail", "en", "b", 0, "x", 3),
        (6, passage, "en", "b", 0, "x", 3),
        (7, passage, "en", None, 0, None, 3),
        (8, "same " * 3000, "en", "c", 0, "x", 3),
        (9, " ".join(words * 12), "en", "c", 0, "x", 3),
        (None, " ".join(words[300:420]), "en", "c", 0, "x", 3),
        (None, " ".join(words[500:620]), "en", "c", 0, "x", 3),
        (10, "é" * 900, "fr", "é", 900, "x", 3),
        (11, "x" * 700, "fr", "é", 900, "x", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string, th int")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
