"""Small tables with everything that can be odd about a row."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use or return.
CLASHING = ["_hash", "_source", "_host", "_group", "_ref", "_language", "c0", "score", "lines", "size", "shard", "sequence_id"]


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "and", "stone", "river", "light", "under", "walk", "seven", "green"]
    return " ".join(rng.choice(parts) + rng.choice(["", "s", "ing", "er", "ly"]) + str(rng.randrange(90)) for _ in range(words))


def odd_rows(n: int = 60, seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty, blank, one-word and long texts, copies, near copies, repeated rows and ties."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([1, 2, 4, 5, 30, 80, 200])), "en", f"s{i % 3}", 1) for i in range(n)]
    base = prose(rng, 120)
    words = base.split()
    for i in range(20):
        near = words.copy()
        near[rng.randrange(len(near))] = f"edit{i}"
        rows.append((n + i, " ".join(near), "en", "s0", 2))
    rows += [(n + 20 + i, base, "fr", "s1", 3) for i in range(10)]
    rows += [
        (n + 40, None, None, None, None),
        (n + 41, "", "en", None, 0),
        (n + 42, " \n\t\x0b ", "en", "s1", 5),
        (n + 43, "wört  doppelt \n\n ende ", "de", "s1", 5),
        (n + 44, "x", "en", "s9", 1),
        (n + 45, prose(rng, 9000), "en", "s2", 9),
        (n + 46, "same line\n" * 50, "en", "s2", 9),
        (None, "a text without an id but with enough words to matter", "en", "s1", 4),
        (None, base, "en", "s1", 4),
        (None, None, None, None, None),
    ]
    return rows + [rows[3], rows[3], rows[-1]]


def documents(spark: SparkSession, rows: list[tuple] | None = None, extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCUMENTS)
    for name in CLASHING if extra else ():
        df = df.selectExpr("*", f"'kept' AS `{name}`")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def plain(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
