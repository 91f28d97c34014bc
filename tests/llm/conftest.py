import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, `a.b` int"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    dice = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(dice.choice(words) for _ in range(n))
    passage = prose(70)
    long = "\n".join(prose(40) + "." for _ in range(400))
    texts = [
        None, "", " ", "\n\n", "one", "one two", passage, passage, passage + "\n" + prose(30), prose(90) + " " + passage + " " + prose(90), long, long,
        "a  b\t c \n d\n", "x" * 50_000, "naïve ﬁ ſ İ 中文 \U0001f600\x1c\x85\xa0z", "tab\there \r\n next", "\x00\x01 null \x00", "'s it's I'LL <|endoftext|> ▁ ▁▁",
        'password = "hunter2hunter2" AKIA' + "ABCDEFGH12345678" + " " + "0123456789abcdef" * 2, "same line here\nand a second\n" * 30, "same line here\nand a second\n" * 30 + "x",
    ]
    rows = [(i, t, "en", "s", 1, str(i), i, i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (8, "another text under the same id", None, None, None, None, None, None), (None, passage, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
