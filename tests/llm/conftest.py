import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, copies, and columns named like internal ones."""
    words = [f"w{k * k % 997}" for k in range(30_000)]
    long_text = " ".join(words)
    shared = "The passage that two documents share is long enough to be found, " + " ".join(f"shared{k}" for k in range(40))
    rows = [
        (1, "Alpha beta gamma delta. " + shared, "en", "a", 1, 5, "r", "s"),
        (2, shared + " Something else entirely, as it happens, comes after it.", "en", "a", 1, 5, "r", "s"),
        (3, "", "en", None, 0, None, None, None),
        (4, None, None, None, None, None, None, None),
        (5, long_text, "en", "b", 1, 5, "r", "s"),
        (6, "Numbers only follow 123 456 in this short text", None, "b", 1, 5, "r", "s"),
        (7, "123 456 !!!", "fr", "b", 1, 5, "r", "s"),
        (8, "Die kleine Überraschung für alle\tmit Straße\r\nund Äpfeln", "de", "b", 1, 5, "r", "s"),
        (9, "Die kleine Überraschung für alle\tmit Straße\r\nund Äpfeln", "de", "b", 1, 5, "r", "s"),
        (9, "Die kleine Überraschung für alle\tmit Straße\r\nund Äpfeln", "de", "b", 1, 5, "r", "s"),
        (None, "a row without an id but with some words in it", "en", "b", 1, 5, "r", "s"),
        (None, None, "en", "b", 1, 5, "r", "s"),
        (10, "one " * 300 + "<|endoftext|>  two  spaces \n\n and <|endoftext|> words ", "en", "b", 1, 5, "r", "s"),
        (11, "aaaa" * 200, "en", "b", 1, 5, "r", "s"),
        (12, " leading and trailing spaces   odd ", "en", "b", 1, 5, "r", "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
