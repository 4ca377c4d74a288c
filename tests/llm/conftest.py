import pytest

ROWS = [
    (1, "The quick brown fox jumps.\nA second line here.", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, "s"),
    (4, "  \n\t \r\n", "de", "s"),
    (5, "The quick brown fox jumps.\nA second line here.", "en", "s"),
    (5, "The quick brown fox jumps.\nA second line here.", "en", "s"),
    (6, "one", None, None),
    (7, "Überall größer x)., foo's... <|endoftext|> 42 é́ a b", "de", "s"),
    (None, "no id here at all", "fr", "s"),
    (8, "long " * 30_000, "en", "s"),
    (9, "\n".join(f"line {i % 7} with some words" for i in range(60)), "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like working ones."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS score", "'x' AS Spans", "doc_id AS id", "cast(null as string) AS runs", "0L AS n_chars")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
