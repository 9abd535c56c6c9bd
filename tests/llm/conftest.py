import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, doc string, label string, h1 int"
SF = "/root/testdata/sf0.001"


def rows_of(texts):
    return [(i, t, None if i == 2 else "en", None, None if t is None else len(t), "x", "y", "z", 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names clash."""
    line = "This line is repeated in many documents here."
    base = " ".join(f"word{k % 97} under the mit license" for k in range(60))
    texts = [(0, None), (1, ""), (2, " \n\t"), (3, base), (3, base), (4, base + " tail"), (5, line), (6, line + "\n" + line), (7, f"  {line.upper()}\t\nkept"),
             (8, "one two"), (9, "ÉTÉ à Zürich 中文 🎉 end"), (10, "x" * 5000), (11, "w " * 30000), (None, "a text without an id"), (None, None)]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (8, 1, None), (None, 0, 1), (7, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(0, "a text without an id"), (1, None), (2, ""), (3, "One two"), (None, "end")], "item_id long, text string")


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
