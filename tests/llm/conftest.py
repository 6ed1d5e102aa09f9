"""Awkward inputs that every operator has to take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, id string, fp string, epoch string, strings int"


def prose(rng: random.Random, words: int, vocabulary: list[str]) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(words)) + "."


EN = "the of and to in that house river stone water light morning table window walking under bright small green over".split()
FR = "le la les des une être très après été où maison rivière pierre lumière matin fenêtre sous verte petite marcher".split()


def row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, len(text) if text is not None else None, "x", 1, "y", "z", "w", 0)


@pytest.fixture(scope="session")
def nasty_rows():
    rng = random.Random(5)
    shared = prose(rng, 60, EN)
    rows = [row(i, prose(rng, rng.randrange(20, 80), EN if i % 3 else FR), "en" if i % 3 else "fr", f"src{i % 3}") for i in range(1, 40)]
    rows += [row(100 + i, prose(rng, 30, EN) + "\n" + shared + "\n" + prose(rng, 20, EN)) for i in range(6)]
    rows += [row(200 + i, rows[0][1]) for i in range(5)]  # exact copies
    rows += [row(300, None, None, None), row(301, ""), row(302, " \n\t "), row(303, "12345 !!"), row(304, "x"), row(305, "\x00\x0b é ß 漢字 😀")]
    rows += [row(400, prose(rng, 40000, EN)), row(401, "ab" * 3000)]  # very long, periodic
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [row(None, prose(rng, 30, EN)), row(None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    return spark.createDataFrame(nasty_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clean(spark, nasty_rows):
    """The awkward rows with unique, non-null ids."""
    seen = {r[0]: r for r in nasty_rows if r[0] is not None}
    return spark.createDataFrame([*seen.values()], SCHEMA).repartition(3).cache()
