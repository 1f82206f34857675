import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, and columns whose names clash."""
    long = "one long word after another " * 3000
    base = "The quick brown fox jumps over the lazy dog while nine wizards juggle bright quartz vases in silence today."
    texts = [
        (1, None), (2, ""), (3, " "), (4, "   \n\n\t"), (5, long), (6, base), (7, base), (8, base + " tail"), (9, "x" * 5000), (10, "a\nb\nc\na\nb\nc\nd"), (11, "a\nb\nc"),
        (12, "don't I'll WE'RE '' 'sx <|endoftext|> Σας İx \x1cq\x85r\xa0s １２3 ＡＢ ́a µß 😀 ▁x a▁b"), (13, "　 mixed   space"), (6, base), (6, base.upper()), (None, base), (None, None), (14, "é" * 300), (15, "a  b   c "),
    ]
    rows = [(d, t, "en", 0, "s", "f", 1.0, 9) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string, fp string, score double, k long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
