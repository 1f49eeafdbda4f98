import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnledger.llm.frames import prepare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an input may have besides its own, named like what the operators return or use.
EXTRA = (
    "size shard score node label target piece n group kept copies keep_id body posterior found row_id own k4 tree "
    "virtual_slot n_points normal text_key entry class_id _size _copies"
).split()


def prose(seed, n):
    words = [f"w{(seed * 7919 + i * i * 31 + i) % 977}" for i in range(n)]
    return " ".join(words)


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, "The quick brown fox. Released under the MIT License.", "en", "a", 10),
    (1, "The quick brown fox. Released under the MIT License.", "en", "a", 10),
    (2, "The quick  brown fox.\nReleased under the MIT License.", "en", "b", 10),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \t\n\r ", "fr", "", 5),
    (None, "La rue est belle et longue.", "fr", "c", 3),
    (None, None, None, None, None),
    (6, BASE, "en", "a", 1),
    (7, NEAR, "en", "a", 1),
    (8, BASE + " tail", "en", None, 1),
    (9, "12 34 !! ??", "en", "c", 1),
    (10, "x" * 70_000, "fr", "c", 1),
    (11, prose(3, 30_000), "en", "b", 1),
    (12, "dé jà vu été <|endoftext|> don't, stop.", "fr", "é", 1),
    (13, "La rue est belle et longue.", "fr", "c", 3),
    (14, "\U0001f600 中文 é K", "zz", "c", 3),
    (100, "under the mit license under the mit license", "en", "a", 3),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return prepare(spark).createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(awkward):
    """The same rows with clashing extra columns."""
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def small(spark):
    return prepare(spark).read.parquet(f"{SF_DIR}/documents.parquet")
