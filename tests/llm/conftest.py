import pytest

#: Texts with every oddity: null, empty, blank, ties and copies, signs, several scripts, one very long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "The the THE the"), (7, "The the THE the"), (8, "*** !!! 123 \x1c\x85 x"),
    (9, "Größe ΣΑΣ naïve 日本語 🙂 don't we'll"), (10, "word " * 30_000), (11, "a\x00b\x0bc\x0cd"), (None, "a text without an id"), (12, "x" * 5000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i and i % 2 else None, "src", len(t or ""), 0.5, "fp", -1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, block int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts(rows):
    return {i: t for i, t in rows}
