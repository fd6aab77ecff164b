"""Documents that every operator must take: nulls, empty and long texts, repeats, clashes."""

import random

WORDS = "alpha beta gamma delta omega sigma lorem ipsum dolor amet tempor magna".split()
SCHEMA = "doc_id long, text string, score double, kept boolean, rank int, ids string, part int"


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.7) for _ in range(words))


def odd_documents(spark):
    rows = [
        (1, prose(60, 1)),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, prose(30_000, 5)),
        (6, "x" * 60_000),
        (7, prose(60, 1)),
        (7, prose(60, 1)),
        (None, prose(40, 9)),
        (None, None),
        (8, "ÀÉ ñ 日本語 <|endoftext|> it's\r\na_b"),
    ]
    full = [(*r, 0.5, None, i, "x", None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
