import pytest

#: Texts with nulls, emptiness, ties, repeats, long and odd ones.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnd runs on."),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "a b c"),
    (5, "a b c"),
    (7, "x " * 3000),
    (8, "word" * 5000),
    (9, "one two three four five six seven eight nine ten " * 4),
    (10, "same line\nsame line\n\nother line\nsame line\n \n "),
    (11, "Été à la mer, straße, 中文字符 and 😀 emoji #tags *bold* <b>|x|</b>"),
    (12, "<|endoftext|> in text <|startoftext|>  double  blanks \n mixed \n\n end "),
    (None, "no id at all"),
    (None, "no id at all"),
    (-4, "negative id, one two three four"),
    (2**40, "a far id " + " ".join(f"w{i}" for i in range(300))),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "src", 0 if t is None else len(t), "extra") for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
