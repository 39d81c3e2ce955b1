import random

import pytest

WORDS = "the of and river stone cloud paper engine window garden silver morning planet music forest winter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed"]) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, short and very long texts, copies, near copies and shared passages."""
    long_ = prose(1, 3000)
    base = prose(2, 220)
    passage = prose(3, 90)
    near = base.split(" ")
    near[40] = "changed"
    out = [
        (1, base, "en", "b", 1), (2, base, "en", "b", 1), (3, " ".join(near), "en", None, 1), (4, None, None, "a", 0), (5, "", "en", "a", 0), (6, "one", "fr", "a", 3),
        (7, long_, "en", "c", 1), (8, prose(4, 60) + " " + passage + " " + prose(5, 40), "fr", "c", 1), (9, passage + " " + prose(6, 70), "de", "c", 1), (10, "x" * 5000, "de", "d", 5000),
        (11, "ab" * 1200, "de", "d", 2400), (12, prose(7, 4), "en", "b", 1), (13, prose(7, 4), "en", "b", 1), (14, "  \n\t ", "en", "b", 5), (15, "Ünïcödé 日本語 😀 text " + prose(8, 30), None, None, 1),
    ]
    return out + [(20 + i, prose(100 + i, 30 + 9 * i), ["en", "fr", "de"][i % 3], f"s{i % 4}", 1) for i in range(25)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use for themselves."""
    return spark.createDataFrame([(*r, "q", 7, "z") for r in rows], SCHEMA + ", id string, n long, label string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
