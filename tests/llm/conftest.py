"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def documents(seed=3, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(12)]
    rows = []
    for k in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(("zz", "Ünïcode", "x!"))
        if rng.random() < 0.3:
            words += rng.choice(base).split(" ")
        rows.append((k * 3, rng.choice(("  ", "")) + rng.choice((" ", "\n", "\t")).join(words), rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s10", None)), len(words)))
    rows += [(1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, " \t\n", "de", "s2", 3), (1003, "one", None, "s1", 3), (1004, "ONE", None, "s3", 3),
             (1005, "a b c d", "en", "s3", 7), (1006, "!!! 123 ???", None, None, 11), (1007, prose(rng, 9000), "en", "s1", 1), (1008, "x" * 3000, "de", "s2", 3000),
             (1009, "é" * 900, "fr", "s2", 900), (1010, prose(rng, 300) * 2, "en", "s4", 1), (-5, "negative id", "en", "s4", 11)]
    return rows + [rows[0], rows[0], rows[70], rows[71]]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators use themselves, and a row without an id."""
    return (spark.createDataFrame([*rows, (None, "no id", "en", "s1", 5)], SCHEMA).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("key", F.lit("k"))
            .withColumn("n", F.lit(2)).withColumn("b", F.lit(0)).withColumn("list", F.lit(3)).repartition(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
