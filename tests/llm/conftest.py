import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clicktide.llm.common import ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents with columns of clashing names."""

    def make(rows):
        full = [(d, t, "en", "s", None, "x") for d, t in rows]
        df = spark.createDataFrame(full, ODD)
        for name in ("rep", "key", "a", "b", "comp", "sig", "grp", "n", "mean", "part"):
            df = df.withColumn(name, df["source"])
        return df

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
STRANGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "é ß x  y\r\n\nz "), (7, LONG), (8, LONG),
    (9, "a" * 300), (10, "a" * 299), (11, "same words in this line " * 20), (12, "same words in this line " * 20),
    (13, "<|endoftext|> </s>[INST] x"), (None, "no id but enough words to be something"), (14, "Tab\tand  two  blanks\n\n\nlines, x."),
]


@pytest.fixture
def strange(docs):
    return docs(STRANGE)
