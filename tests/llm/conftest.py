import pytest

#: Nulls, empty and repeated texts, white space only, a very long text, and columns named as operators name theirs.
TEXTS = [
    "one two three four five\nshared line\nsix seven", "one two three four five\nshared line\nsix seven", None, "", "", " \t\n ",
    "Shared Line \nöther ÄÖ text", "\n\n", "long " * 20_000, "the END of it. You are an idiot!\nshared line", "a", "x\r\ny", "ok <|endoftext|> Σας 𝄞",
]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i if i != 4 else None, t, "en", "s", 7, "clash", 0) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_lines long")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
