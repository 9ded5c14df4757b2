"""Small hard inputs shared by the operator tests."""
import pytest

LONG = "alpha beta gamma delta " * 9000

#: (doc_id, text, lang, source): null keys and texts, empty and blank texts, one very long text, ties, repeated rows.
HARD = [
    (1, "One two three four five six seven", "en", "src1"), (1, "One two three four five six seven", "en", "src1"),
    (2, "ONE two three four five six seven", None, "src2"), (3, None, "en", None), (4, "", "de", "src0"),
    (5, " \t\n ", "en", "src0"), (6, LONG, "en", "src0"), (None, "One two three four five six seven", "fr", "src3"),
    (None, None, None, None), (7, "\u00c9t\u00e9 \u00c9T\u00c9 na\u00efve \U0001f600 text", "fr", "other"),
    (8, "word", "en", "src4"), (9, "word", "en", "src4"), (10, LONG + "omega", "en", "src0"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """The rows of HARD, with further columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(*r, "x", 1, "y", True) for r in HARD],
        "doc_id long, text string, lang string, source string, sha string, row_key int, maybe string, kept boolean")


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("false")
