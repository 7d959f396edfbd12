import pytest

#: Rows that every text operator must take: nulls, empty, white space, symbols, copies, ties, odd code points.
ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "one",
    "one two",
    "One two three one two three One two",
    "a\nb\na\n\nb\n  a",
    "#tag *x* $5 %% && |<>|\n#tag *x*",
    "one two   three\u0085four",
    "  lead and  double  spaces ",
    "\n\nstart\nend\n",
    "日本語 \U0001f600 é ﬁ",
    "x▁y ▁▁ z",
    "<|endoftext|> it's we'll 1234567",
    "\x00 nul",
    "w " * 3000,
    "q" * 5000,
    " ".join(f"w{i % 700}" for i in range(5000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, ["s1", None, "s2"][i % 3]) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, t, "s3") for i, t in enumerate(ODD_TEXTS[3:8])]  # copies
    rows += [(3, "one", "s1"), (None, "one", "s1"), (None, None, None)]  # a repeated row and null ids
    data = [(d, t, s, "en", 1.5, "clash", 7) for d, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, size double, run string, n_copies int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
