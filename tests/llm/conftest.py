import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, lexicon=400):
    return " ".join("".join(rng.choice(["ta", "re", "no", "li", "us", "en", "mo"]) for _ in range(1 + rng.randrange(3))) + str(rng.randrange(lexicon) % 7 or "") for _ in range(n))


def corpus():
    """Rows with nulls, empty and very long texts, ties, copies, near copies, shared passages, secrets and junk."""
    rng = random.Random(5)
    rows = []
    passage = prose(rng, 60)
    for i in range(60):
        t = prose(rng, rng.randrange(20, 160))
        if i % 9 == 0:
            t += "\n" + passage
        if i % 10 == 3:
            t += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" end'
        rows.append((i, t, "en" if i % 3 else "fr", "s%d" % (i % 4) if i % 5 else "s0"))
    base = rows[7][1].split(" ")
    for k in range(6):  # near copies of 7
        w = list(base)
        w[(k * 5) % len(w)] = "changed%d" % k
        rows.append((100 + k, " ".join(w), "en", "s0"))
    for k in range(8):  # copies of 11
        rows.append((200 + k, rows[11][1], "en", "s0"))
    rows.append((300, "", "en", "s1"))
    rows.append((301, None, None, None))
    rows.append((302, " \n\t ", "de", None))
    rows.append((None, "a row without an id", "en", "s1"))
    rows.append((303, "one\n\none\nü 🙂 é" + " x" * 3, "en", "s2"))
    rows.append((304, prose(rng, 6000), "en", "s2"))
    rows.append((305, "$$$ ### *** " * 60, "en", "s0"))
    rows.append((306, "Und " * 300, "de", "s0"))
    rows += [(307, "twice the same row " * 20, "en", "s3")] * 2
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
