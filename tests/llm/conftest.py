import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, n_lines string, n_hit string, items string, sequence_id string, offset string, score string"


def _row(key, text):
    return (key, text, "en", "s", len(text or ""), *["taken"] * 8)


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["th", "er", "on", "in", "ed", "re"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies and columns named like results."""
    base = [prose(60, s) for s in range(8)]
    long = "\n".join(prose(400, 100 + s) for s in range(60)) + "\n" + "x" * 70_000
    rows = [(None, base[0]), (None, None), (1, None), (2, ""), (3, " \n\n\t"), (4, long), (5, base[1]), (5, base[1]), (5, base[2]), (6, base[1] + " end"), (7, base[3] + "\n\n" + base[4]), (8, base[4] + "\n" + base[3].replace(" ", "  ", 3)), (9, "one"), (10, "one"), (11, "one two"), (12, "Ünïcödé ß \U0001f600 日本"), (13, "a\x00b\r\nc")]
    words = base[5].split()
    for k in range(20):
        rows.append((20 + k, " ".join([*words[:k], "changed%d" % k, *words[k + 1 :]])))
    return spark.createDataFrame([_row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
