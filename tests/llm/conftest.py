"""A small table of documents with nulls in every column, ties, repeats and columns named like the operators' own."""
import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, _text int, _row string, "
          "kept string, size string, fingerprint double, ids string, score string, _none string")


def words(seed: int, n: int, of: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(2 + r.randrange(5))) + str(r.randrange(of)) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def of(rows):
        """Rows of (doc_id, text[, source[, lang]]); the other columns get a value or null."""
        full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, None if k % 2 else k, "x", k, None,
                 "no", "large", 0.5, None, None, "n") for k, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)
    return of


@pytest.fixture(scope="session")
def edge_rows():
    long_text = words(1, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\f\r", None), (4, "one", "b"), (5, "o n\te", "b"), (5, "o n\te", "b"),
            (None, "one", "b"), (7, long_text, "hot"), (8, long_text, "hot"), (9, long_text + " ", "hot"), (10, "É𝄞 ß", "ü"),
            (11, words(2, 300), "hot"), (12, words(2, 300).upper(), "hot"), (None, None, None), (13, "x" * 5000, "b"),
            (14, words(3, 120) + " " + words(4, 80), "c"), (15, words(5, 60) + " " + words(4, 80), "c")]
