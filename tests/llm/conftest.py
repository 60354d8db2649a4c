import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; ids count up from 0 unless given."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if k % 3 else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, odd, long, tied and repeated texts."""
    long = " ".join(f"w{i * i % 977}" for i in range(4000))
    return [None, "", " \n\t ", "a", "a", "four words only here", "Four WORDS only here", "é ñ ß 漢字 \U0001f600 <|endoftext|> don't", "x" * 1000, long, long, long[:-1000] + " changed", "\x00\x01 b", "same " * 300, "  lead and trail  "]


@pytest.fixture(scope="session")
def write_docs(tmp_path_factory):
    def write(df):
        path = str(tmp_path_factory.mktemp("sf"))
        df.write.parquet(f"{path}/documents.parquet")
        return path

    return write
