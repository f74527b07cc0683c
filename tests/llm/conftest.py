import pytest

#: Texts that every operator over documents is tried on: null, empty, blank, very long, repeated, odd.
TEXTS = [
    None, "", " \n\t ", "plain words, plain words; it's 42!", "plain words, plain words; it's 42!",
    "Éa ǅ Σίσυφος ΟΔΟΣ 日本語 😀 ﬁ é İ \x1c\x85  x", "<|endoftext|>mid<|startoftext|> <|end", "a" * 3000,
    "word " * 4000, "\n".join(["one line of text here", "", "one line of text here", " "] * 30), "x\r\ny\x0bz\x0c", "tail",
]


@pytest.fixture()
def odd(spark):
    """Rows ``doc_id, text, lang, source, n_chars`` with nulls in every column, repeated rows and
    columns whose names operators might use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, i) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None), (3, TEXTS[3], "en", "s1", 3), (3, TEXTS[3], "en", "s1", 3)]
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, key string, n_words int")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
