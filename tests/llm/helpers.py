"""Small inputs with everything that goes wrong in real ones."""

import random

from pyspark.sql import DataFrame, SparkSession

LONG = "word" * 8000 + " " + " ".join(f"w{i}" for i in range(6000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "ids string, score string, key int, digest string, node string, kept string, slot string, mix_slot string, row string, w string")


def odd_rows() -> list[tuple]:
    base = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "12 34 !!", "en", "b"),
        (5, LONG, "en", "a"), (6, "the same text of six words", "en", "a"), (7, "the same text of six words", None, "b"),
        (7, "the same text of six words", None, "b"), (None, "no id but a text with words", "de", None),
        (None, None, None, None), (8, "é漢字🙂 ▁ mixed\x00 signs", "fr", "c"), (9, "  spaces   in  runs ", "en", "c"),
        (10, "x", "en", "c"), (11, "x", "en", "c"), (12, "the same text of six words", "en", "a"),
    ]
    return [(*r, None, "i", "s", 1, "d", "n", "k", "sl", "ms", "r", "w") for r in base]


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA)


def texts_frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bdfgklmnrst") for _ in range(1 + rng.randrange(words) % 4)) + str(rng.randrange(words) % 7).replace("0", "")
                    for _ in range(n))
