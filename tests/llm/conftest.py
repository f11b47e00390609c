import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vector string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long, repeated and tied rows, null ids and languages, and columns with clashing names."""
    long_text = " ".join(WORDS[(i * i + i // 7) % 24] + str(i % 97) for i in range(60_000))
    prose = " ".join(WORDS[i % 24] for i in range(60))
    rows = [
        (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \t\n ", "en", None, 3), (4, long_text, "en", "s", len(long_text)),
        (5, prose, "en", "s", 9), (6, prose, "en", "s", 9), (6, prose, "en", "s", 9), (7, prose + " more", "en", "s", 9),
        (None, prose, "en", "s", 9), (None, None, None, None, None), (8, "one two", "de", "s", 7), (9, "One\x0btwo", "de", "s", 7),
        (10, "mail a.b@c-d.org, call +1 (555) 555-1234 or 4111 1111 1111 1111 at 10.0.0.255 and 10.0.0.256", "en", "s", 9),
        (11, "éè \U0001f600 x" * 5, "fr", "s", 9), (12, "<|endoftext|> it's 'll\n\n\nend  ", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, "v", "r") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
