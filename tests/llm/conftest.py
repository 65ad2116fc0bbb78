import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


EDGE_TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "One, two; three!", "a  b\t c\n\nd ", "don't stop <|endoftext|> now <|startoftext|>", "İstanbul ΣΑΣ ﬁ é", "日本語 テキスト 123abc", "🙂🙂 ok \x00 \x85 z",
    "\x1c!\x1c !", "x" * 30_000, prose(1, 20_000), prose(2, 300), prose(2, 300), prose(2, 300) + " end", "  lead and trail  ", "tab\tand nbsp  \n x",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, null ids, and extra columns whose names clash with the operators'."""
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(EDGE_TEXTS)] + [(None, "null id", None, None, None, None, None), (4, "one", "en", "s", 0, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, fp int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
