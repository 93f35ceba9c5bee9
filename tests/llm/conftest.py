from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """``[(doc_id, text), …]`` as documents with extra columns whose names clash with added ones."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with nulls, empty, short and long texts, copies, near copies, repeats and runs."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    shared, base = words(30), words(120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (None, "Null id text"), (None, None)]
    for i in range(10, 40):
        rows.append((i, " ".join(words(draw.randint(5, 150)))))
    for i in range(40, 52):
        near = list(base)
        near[draw.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(near)))
    for i in range(60, 70):
        rows.append((i, " ".join(words(20) + shared + words(20))))
    rows += [(70 + i, " ".join(base)) for i in range(4)]
    rows += [(80, "  ".join(["again"] * 60)), (81, " ".join(["again"] * 50 + words(5)))]
    rows += [(82, " ".join(["ab", "cd"] * 40)), (83, " ".join(["cd", "ab"] * 30))]
    rows += [(90, " ".join(words(4000))), (91, "Ünïcode ÄÖ ßtext " * 10), (92, "Ünïcode äÖ ßtext " * 10)]
    rows += [(93, "x" * 3000 + " " + " ".join(shared))]
    rows += [(12, rows[10][1]), (12, rows[10][1]), (12, "another text of an id that repeats " + " ".join(shared))]
    return rows
