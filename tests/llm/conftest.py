import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_helpers import words  # noqa: E402

#: Extra columns whose names are used inside the operators, or hold signs.
EXTRA = {"k": "x", "d": 5, "h": 7, "t": "y", "node": 1, "key": 2, "m": "z", "a.b": "dot", "slot": 9, "piece": 3}


@pytest.fixture(scope="session")
def make(spark):
    """docs(rows) -> DataFrame of (doc_id, text, lang, source, n_chars) and extra columns; rows are (doc_id, text)."""

    def docs(rows, extra=True):
        kinds = "doc_id long, text string, lang string, source string, n_chars long"
        more = EXTRA if extra else {}
        kinds += "".join(f", `{c}` {'long' if isinstance(v, int) else 'string'}" for c, v in more.items())
        full = [(i, t, "en" if i is not None and i % 2 else None, None, None if t is None else len(t), *more.values()) for i, t in rows]
        return spark.createDataFrame(full, kinds).repartition(3)

    return docs


@pytest.fixture(scope="session")
def nasty():
    """Nulls everywhere, empty and blank texts, a very long text, ties, repeated rows, one id with two texts."""
    a = words(80, 1)
    return [
        (None, None), (1, None), (None, a), (2, ""), (3, "  \n\t "), (4, a), (4, a), (5, a), (6, words(90, 2)), (6, words(70, 3)),
        (7, words(60_000, 4)), (8, "x" * 300_000), (9, "é ü 漢字 İstanbul ﬁ"), (10, "one"), (None, words(60, 5)), (None, words(60, 6)),
    ]
