import random

import pytest

WORDS = "the and of in to a is it that was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rnd = random.Random(7)
    base = prose(rnd, 120)
    passage = prose(rnd, 30)
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, "one"), (5, "one two"), (6, " \t\n "), (7, base + " end"), (8, base.upper())]
    for i in range(10, 22):
        w = base.split()
        for _ in range(i % 7):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.random())
        rows.append((i, " ".join(w)))
    for i in range(30, 40):
        rows.append((i, prose(rnd, 40) + " " + passage + "\n" + prose(rnd, 40)))
    rows += [(50, prose(rnd, 9000)), (51, "é" * 70 + " ü"), (52, "x" * 30000), (53, "aé" * 40), (54, "bé" * 40), (1, base), (60, "a b c d e f g h i"), (61, "a b c d e f g h i j"), (62, "k a b c d e f g h i j")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "x", -1) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, text_key string, bucket int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < -5")
