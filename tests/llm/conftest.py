import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, block long, n string"
SYLLABLES = "ka lo mi ren tu sha bel dor fi gan hu jo vex wy zo pra qui ster".split()


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join("".join(chance.choice(SYLLABLES) for _ in range(chance.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, a very long text, and columns with clashing names."""
    extra = ("x", 1, 2, "y")
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "12345 !!! ###"), (None, prose(1, 30)), (None, None),
        (5, prose(2, 40)), (5, prose(2, 40)), (6, prose(2, 40)), (7, prose(3, 30000)), (8, "İstanbul ΣΑΣ naïve café 中文字"),
        (9, "a"), (10, "<|endoftext|> [INST] \\ </s>"),
    ]
    return [(i, t, None if k % 3 else "aa", None if k % 2 else "s", len(t or ""), *extra) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
