import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers_llm import TEXT  # noqa: E402


def words(rng, n, stems=("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, nulls, empty and long texts, repeated ids."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(30, 200)), "en", "s", 1) for i in range(60)]
    base = words(rng, 300)
    rows += [(100 + i, base, "en", "s", 1) for i in range(5)]
    for i in range(12):  # near copies: one word changed
        w = base.split()
        w[17 * i] = "changed"
        rows.append((120 + i, " ".join(w), "en", "s", 1))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, " \n\t ", None, "s", 4), (203, "one", "en", "s", 3),
             (204, words(rng, 30_000), "en", "s", 1), (None, base, "en", "s", 1), (None, "two words", None, "s", 1),
             (5, rows[5][1], "en", "s", 1), (5, "other text of the same id", "en", "s", 1), (206, "É" * 50 + " 漢字 😀", "fr", "s", 1)]
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, TEXT).repartition(3)


@pytest.fixture()
def clashing(docs):
    """Further columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ("fp", "key", "kind", "block", "class", "bands", "words", "secret_spans", "keep", "threshold", "_key", "held_out", "score", "n", "root")
    return docs.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], TEXT)
