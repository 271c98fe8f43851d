from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, component_id string, row string"
VOCABULARY = [a + b for a in "ba de fi go lu mi no pa re so tu va".split() for b in "n r s t la mo ki".split()]


def prose(seed: int, count: int, marks: bool = True) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(count):
        word = rng.choice(VOCABULARY) + rng.choice(VOCABULARY)
        end = marks and rng.random() < 0.1
        out.append((word.capitalize() if not k or out[-1].endswith(".") else word) + ("." if end else ""))
    return " ".join(out)


def row(doc_id, text):
    """A document with columns whose names clash with those of the operators."""
    return (doc_id, text, "en", "src", None if text is None else len(text), -1, -1.0, "x", "y")


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], DOCS)

    return make


#: Ids and texts with nulls, blanks, copies, equal ids and one long text.
def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\n "), (7, "one"), (8, "one"),
        (9, prose(2, 40)), (9, prose(3, 40)), (None, base), (None, prose(4, 30)), (None, None), (10, prose(5, 30_000)), (11, "a b c d e"),
        (12, "A B C D E"), (13, "Ünïcode Straße x \x00 y"), (14, "<|endoftext|> it's  two  blanks \n x"),
    ]
