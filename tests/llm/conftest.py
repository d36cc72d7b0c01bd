import pytest

from emberline.llm.common import prepare

DATA = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use for their own.
CLASHING = ["r", "n", "v", "key", "sig", "label", "score", "others", "gone", "count", "lo"]


@pytest.fixture(scope="session")
def given(spark):
    """The given documents (200) and labels."""
    prepare(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, equal rows, a null id, and clashing columns."""
    prepare(spark)
    prose = "The quick brown fox jumps over the lazy dog, and it's 12 o'clock. " * 9
    texts = [
        (1, prose + "One end."), (2, prose + "Another end."), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "word"), (8, "a b c d"), (8, "a b c d"),
        (None, prose), (9, "x" * 3000), (10, "été İstanbul ΑΣ 日本語 \x1c \xa0 ok <|endoftext|> fin.\r\nÉTÉ"), (11, "lorem ipsum dolor " * 20_000), (12, prose + "One end."),
    ]
    rows = [(i, t, None if i == 2 else "en", None, None if t is None else len(t), *([7] * len(CLASHING))) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
