import random
import re
from itertools import permutations

from lumenframe.llm import audit


def plain(rows, labels):
    """Applies the filters one after the other, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        bad["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append((lang or "", i, {k for k, v in bad.items() if v}))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[2]]
                left = [f for f in left if x not in f[2]]
                redundant = sum(x in f[2] for f in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f[2] == {x} for f in own), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)]
        for x in "ABCDE":
            total = sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(x) + 1].append(total)
    return out


def rows_of(spark, rows, labels):
    # Extra columns have names that the operator uses inside.
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, mask int, digest string, first boolean")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(audit.masks(docs, known)).collect()}


def test_audit_equals_filters_one_after_the_other(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", " \t\n", long, long + " #", long.upper(), "a " * 300, "A " * 300, "é" * 40, long + "\x0bx", "it cost $5", long + " | " + "same " * 500, "ÀÉ " * 210]
    rows = [(rnd.randrange(60), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)] + [(None, long, "en"), (None, None, None), (None, long, "en")]
    labels = [(rnd.randrange(70), rnd.choice([0, 1, None]), rnd.choice([0, 1])) for _ in range(60)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    got, want = rows_of(spark, rows, labels), plain(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == want


def test_audit_of_clean_documents_is_zero(spark):
    long = " ".join(f"w{i}" for i in range(230))
    got = rows_of(spark, [(1, long, "en"), (2, long + " x", "en")], [(1, 1, 0)])
    assert len(got) == 600 and set(map(tuple, got.values())) == {(2, 0, 0, 0, 0, 0, 0)}


def test_audit_of_copies_across_parts(spark):
    """A copy is one whatever part its original is in, and however many there are."""
    long = " ".join(f"w{i}" for i in range(230))
    rows = [(0, long, "de")] + [(i, long, "en") for i in range(1, 400)]
    got = rows_of(spark, rows, [(i, 1, i % 2) for i in range(400)])
    assert got["en", "EABCD", 1] == [0, 399, 0, 399, 399, 200, 399 * 120]
    assert got["de", "EABCD", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_audit_of_an_empty_table(spark):
    assert rows_of(spark, [], []) == {}


def test_polynomial_of_two_filters():
    p = audit.Removal({0: 5, 1: 3, 2: 4, 3: 2}, 2)
    assert p.c == {1: 5, 2: 6, 3: -2}
    assert [p.at(s) for s in range(4)] == [0, 5, 6, 9]
    assert p.shapley(0) == 4 and p.shapley(1) == 5
