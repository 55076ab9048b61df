import random

import pytest

WORDS = "alpha beta gamma delta the of and Straße café naïve 日本 x1 tion ing".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(11)
    long_line = "".join(rng.choice("aeinrst ") for _ in range(60_000))
    texts = [
        None, "", " ", "\n\n", "\t\r\n", "short", sentence(rng, 60), sentence(rng, 60), long_line, "\n".join(sentence(rng, 30) for _ in range(400)),
        "a" * 30_000, "same text that stands twice in this table and is long enough to count as a line of its own",
    ]
    rows = [(i, t, None if i % 3 else "en", "src", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (90, rows[-1][1], "de", None, 1), (None, rows[6][1], "en", "src", 5), (None, None, None, None, None), (6, rows[7][1], "en", "src", 9)]
    extra = ("row", 7, b"1", "h", 1.5, True, "k")
    return [(*r, *extra) for r in rows]


EDGE_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, id long, data binary, h1 string, fp double, kept boolean, flags string"
)


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
