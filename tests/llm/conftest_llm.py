import random

import pytest

from leadspark.llm.queries import QUERIES  # noqa: F401  (the operators must be importable)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must not get in the way.
CLASHING = ["k", "t", "id", "pack", "data", "row", "keys", "node", "score", "items", "marks", "flag", "w", "n", "key", "good", "bucket"]


def make(spark, texts, first=0):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4), (3, "one", "en", "s", 3), (4, long, "de", "s", len(long)), (5, "x" * 300_000, None, "s", 300_000), (6, "same text here again and again", "en", "s", 1), (6, "same text here again and again", "en", "s", 1), (7, "same text here again and again", "en", None, 1), (None, "no id at all", "en", "s", 12), (8, "Ünïcode 日本語 😀 text", "fr", "s", 3), (9, "a\x00b\x0bc", "es", "s", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"x{c}") for c in CLASHING})


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact copies, near copies, shared passages, and noise."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(900)] + ["é" * 3, "ß", "日本"]
    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(words(rng.randint(1, 120))) for _ in range(60)]
    base = words(150)
    for k in range(25):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        texts.append(" ".join(w))
    passage = " ".join(words(40))
    texts += [" ".join(words(30)) + "\n" + passage + "\n" + " ".join(words(20)) for _ in range(8)]
    texts += texts[:6] + ["ab" * 200, "ab" * 200, "ab" * 190, "", None, "short"]
    rng.shuffle(texts)
    return texts
