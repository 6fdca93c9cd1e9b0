import pytest
import public_tokenizers


@pytest.fixture(scope="session")
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row long, digest string, shard int, pieces string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, with extra columns whose names the operators use themselves."""

    def make(texts, ids=None, sources=None, langs=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        sources = ["s"] * n if sources is None else sources
        langs = [None] * n if langs is None else langs
        rows = [(i, t, g, s, None if t is None else len(t), "x", 1, None, 2, "y") for i, t, s, g in zip(ids, texts, sources, langs, strict=True)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make
