import random

import pytest

SCHEMA = "doc_id long, text string, lang string, k string, h string, kept boolean"


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, empty texts; ids that repeat or are null."""
    rng = random.Random(5)
    shared = [passage(rng, 40) for _ in range(3)]
    out = []
    for i in range(60):
        text = "\n".join([passage(rng, rng.randint(5, 60)), rng.choice(shared), passage(rng, 20)])
        out.append((i, text, rng.choice(["en", "de", None])))
    out += [(100 + i, out[i][1].replace(" ", "  \t", 3), "en") for i in range(10)]  # equal but for white space
    out += [(120 + i, out[i][1].replace("a", "b", 1), "en") for i in range(10)]  # near copies
    out += [(140, None, "en"), (141, "", None), (142, " \n\t ", "de"), (143, "é" * 300, "en"), (144, "ab" * 3000, "en"), (145, "x", None)]
    out += [(7, out[7][1], "en"), (7, "another text of the same id " * 9, "en"), (None, out[3][1], None), (None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "k", "h", False) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark, rows):
    """Unique ids only."""
    seen, out = set(), []
    for i, text, lang in rows:
        if i is not None and i not in seen:
            seen.add(i)
            out.append((i, text, lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
