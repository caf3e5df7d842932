import pytest


@pytest.fixture(scope="session")
def word_bpe():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")
