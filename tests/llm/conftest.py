from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, sha string, label string, path string"


def make(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "k", "x", "l", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12):  # copies, near copies, passages
        rows.append((100 + i, base[0].upper() if i % 2 else base[0]))
        parts = base[1].split()
        parts[rng.randrange(len(parts))] = "changed%d" % (i % 4)
        rows.append((200 + i, " ".join(parts)))
        rows.append((300 + i, base[2][:60] + " " + base[3 + i]))
    rows += [(400, None), (401, ""), (402, "   \n\t"), (403, "one two"), (404, "one two"), (None, "a lone text of null id"), (405, "line one is here today\nline two is there now\nline one is here today"), (405, "line one is here today\nline two is there now\nline one is here today")]
    rows.append((406, " ".join(rng.choice(words) for _ in range(30_000))))
    return rows
