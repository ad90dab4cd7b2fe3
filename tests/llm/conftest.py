import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, and columns with clashing names."""
    long_text = " ".join(WORDS[k * k % 20] + str(k % 97) for k in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\r\x0b\x0c ", "en", "a", 7), (4, "one", None, "b", 3), (5, "one", "en", None, 3), (5, "one", "en", None, 3),
        (6, long_text, "en", "a", len(long_text)), (7, long_text, "de", "a", len(long_text)), (None, "no id here but some words", "en", "c", None), (8, "Ünïcödé ß 中文 🙂 ́x <|endoftext|> it's", "fr", "c", 30),
        (9, "line one of text\nline two of text\n\nline one of text\nline two of text", "en", "c", 60),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([r + (1.5, "x", 3) for r in rows], schema + ", score double, label string, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    from spidex.llm.queries import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
