import pytest

# Texts with every awkward property the operators define a result for.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 20, "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 20, "en"),  # an exact copy
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\t ", "en"),
    (6, "ein  doppeltes   Leerzeichen \n und ▁ Zeichen 😀 \x00 é", "de"),
    (7, "x" * 200_000 + " " + "word " * 50_000, "en"),  # very long
    (8, "short", "en"),
    (8, "short", "en"),  # a repeated row
    (None, "a row without an id, with some words in it", "fr"),
    (9, "token = \"0123456789abcdef0123456789abcdef01234567\" stands here among words", "en"),
    (10, "</s><|endoftext|> [INST] control & strings # * $", "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty, long and repeated texts, and columns named like the operators' own."""
    rows = [(i, t, lang, "src", len(t or ""), "extra", 1, 2) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "ids string, component int, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
