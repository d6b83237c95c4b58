"""Small documents with every odd case, and the tables around them."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies."""
    rng = random.Random(7)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [
        *base,
        base[0],
        base[0],
        base[1].replace("w1", "w999", 1),
        " ".join(base[2].split()[:-1]),
        "",
        "   \n\t ",
        None,
        "one",
        "two words",
        "é ünï 漢字 😀 " * 3,
        "same line here again and again\n" * 4,
        base[3][:200] + "\n" + base[4][:200],
        prose(rng, 30_000, 90),
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, base[5], "en", "src1", 1), (5, base[5], "en", "src1", 1), (None, base[6], None, None, None)]
    return rows


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def docs(llm):
    return llm.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCS)


CLASHES = "_key _k _d _t _own w n key at pos line line_key size rank score hits count node label bucket block range row u s shard words pass kept item_id text_key".split()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names the operators might use themselves."""
    return docs.select("*", *(F.lit("mine").alias(c) for c in CLASHES))
