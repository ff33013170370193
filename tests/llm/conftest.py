import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon.", "en", "a", 1),
        (2, "alpha BETA gamma delta epsilon.", "en", "a", 2),
        (3, None, "de", None, 3),
        (4, "", None, "b", None),
        (5, "  \n\t ", "de", "b", 5),
        (6, long, "en", "a", 6),
        (7, long + " end", "en", "a", 6),
        (8, "7 8 9 !!", "fr", "c", 8),
        (8, "7 8 9 !!", "fr", "c", 8),
        (None, "no identifier here at all", "en", "a", 9),
        (9, "É é Straße straße ß", "de", "a", 9),
    ]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double, topic string, tokens int, sampled string, digest string, `keep.id` string, component_id int, row int, rank int, n_known int, merge int, ids string"
    return spark.createDataFrame([(*r, "x", 0.5, "t", 1, "s", "d", "k", 0, 0, 0, 0, 0, "i") for r in rows], ddl)
