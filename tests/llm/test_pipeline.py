import random

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import langid, quality
from lumenframe.llm.common import written
from tests.llm.test_langid_bytes import grams_of, py_bits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_stages_keep_clean_documents_and_columns(spark, docs):
    now = docs.select("doc_id", "text", "lang", "source", (docs["n"] + 0).alias("n_chars"))
    ids = {}
    for name, f in corpus_pipeline.STAGES:
        before = now
        now = written(f(spark, now, ""), "test")
        if name != "packing":
            assert now.columns == before.columns
            ids[name] = [r.doc_id for r in now.select("doc_id").collect()]
    assert 30 in ids["suffix_dedup"] and 2 not in ids["quality_rules"] and 1 not in ids["ngram_jaccard"]
    assert ids["suffix_dedup"].count(0) == 1
    assert sorted({r.doc_id for r in now.select("doc_id").collect()}) == sorted(set(ids["suffix_dedup"]))


def test_empty_documents(spark, docs):
    now = docs.limit(0).select("doc_id", "text", "lang", "source", docs["n"].alias("n_chars"))
    for _, f in corpus_pipeline.STAGES:
        now = written(f(spark, now, ""), "test")
    assert now.count() == 0


@pytest.fixture(scope="module")
def rows():
    """Two languages with copies, near copies, shared passages, symbols, gibberish, nulls and rows that repeat."""
    rnd = random.Random(21)
    words = {"aa": ["".join(rnd.choice("abdeilmnoprst") for _ in range(rnd.randrange(2, 9))) for _ in range(400)], "bb": ["".join(rnd.choice("čdéfğhïkłöšü") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]}
    text = lambda lang, n: "\n".join(" ".join(rnd.choice(words[lang]) for _ in range(10)) for _ in range(n))
    out = [[i, text(lang := rnd.choice(["aa", "bb"]), rnd.randrange(3, 9)), lang, f"s{i % 3}", 0] for i in range(60)]
    shared = " ".join(rnd.choice(words["aa"]) for _ in range(55))
    for i in range(60, 68):
        out.append([i, text("aa", 3) + " " + shared + " " + text("aa", 3), "aa", "s0", 0])
    for i in range(70, 76):  # copies and near copies
        other = out[i - 70][1].split(" ")
        if i % 2:
            other[len(other) // 2] = "changed"
        out.append([i, " ".join(other), out[i - 70][2], "s1", 0])
    out.append([80, text("aa", 4).replace(" ", "### "), "aa", "s2", 0])
    out.append([81, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(50)), None, "s2", 0])
    out += [[82, None, "aa", "s0", 0], [83, "", None, None, 0], [84, "short text", "aa", "s1", 0], [85, text("bb", 5), None, None, 0], list(out[5]), [None, text("aa", 5), "aa", "s0", 0]]
    return [tuple([*r[:4], len(r[1] or "")]) for r in out]


def py_bin(v):
    top = max(v.bit_length() - 5, 0)
    return v if v < 16 else top * 16 + (v >> top)


def py_floor(b):
    return b if b < 32 else (b % 16 + 16) << (b // 16 - 1)


def py_quality(rows):
    n, chars, symbols, dups, repeats, lines = (x.tolist() for x in quality.counted([r[1] or "" for r in rows]))
    feats = [(1000 * max(s - 1, 0) // max(w, 1), 1000 * c // max(w, 1), 100 * max(d - 1, 0) // max(k, 1), 1000 * max(p - 16, 0) // max(w, 1)) for w, c, s, d, p, k in zip(n, chars, symbols, dups, repeats, lines, strict=True)]

    def fence(values, spread):
        b = sorted(map(py_bin, values))
        size = len(b)
        q1, q3 = b[-(-size // 4) - 1], b[-(-3 * size // 4) - 1]
        if spread:
            room = 6 * max(py_floor(q3) - py_floor(q1), py_floor(q3 + 1) - py_floor(q3))
            return py_floor(q1) - room, py_floor(q3) + room
        gap = lambda x: 16 * (1 + (sum(y > x for y in b) * 100 < size))
        own = sorted(set(b))
        last = next((x for x, y in zip(own, own[1:]) if x >= q3 and y - x > gap(x)), None)
        return -1, float("inf") if last is None else py_floor(last + 1) - 1

    kept = []
    for i, r in enumerate(rows):
        ok = n[i] >= 20 and 100 * repeats[i] <= 30 * n[i]
        for f in range(4):
            groups = [[x[f] for x, o in zip(feats, rows, strict=True) if o[2] == r[2] and o[3] == r[3]], [x[f] for x, o in zip(feats, rows, strict=True) if o[2] == r[2]]]
            ok = ok and any(lo <= feats[i][f] <= hi for lo, hi in (fence(g, f == 1) for g in groups))
        if ok:
            kept.append(r)
    return kept


def py_language(rows):
    learn = {}
    for r in rows:
        if r[2] is not None:
            learn.setdefault(r[2], []).append((r[1] or "").encode())
    grams = {k: grams_of(v) for k, v in learn.items()}
    bits = [{k: py_bits(g, (r[1] or "").encode()) for k, g in grams.items()} for r in rows]
    best = [min(sorted(b), key=b.get) for b in bits]
    rate = [b[k] / max(len((r[1] or "").encode()), 1) for b, k, r in zip(bits, best, rows, strict=True)]
    limit = {}
    for k in grams:
        own = sorted(x for x, b, r in zip(rate, best, rows, strict=True) if b == k == r[2])
        q = lambda p: own[max(int(np.ceil(p * len(own))) - 1, 0)]  # noqa: B023, E731
        limit[k] = q(0.75) + 6 * max(q(0.99) - q(0.5), langid.LEAST_SPREAD)
    return [r for r, b, x in zip(rows, best, rate, strict=True) if x <= limit[b]]


def py_copies(rows):
    sets = []
    for r in rows:
        w = r[1].encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        best[root(i)] = min(best.get(root(i), i), i, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    return [rows[i] for i in sorted(best.values())]


def py_passages(rows, width):
    first = {}
    order = lambda d: float("inf") if d is None else d
    for d, t, *_ in rows:
        x = t.encode()
        for p in range(len(x) - width + 1):
            first[x[p : p + width]] = min(first.get(x[p : p + width], float("inf")), order(d))
    out = []
    for d, t, lang, source, _ in rows:
        x = t.encode()
        gone = bytearray(len(x))
        for p in range(len(x) - width + 1):
            if first[x[p : p + width]] < order(d):
                gone[p : p + width] = b"\1" * width
        left = bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((d, left, lang, source, len(left)))
    return out


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    """Each stage, and run() as a whole, keeps the rows and texts of a plain version; pieces hold the ids of every document."""
    P = pytest.importorskip("public_tokenizers")
    from tests.llm.test_tokens import library

    order = lambda rs: sorted((tuple(r) for r in rs), key=str)
    now, stages = spark.createDataFrame(rows, SCHEMA), dict(corpus_pipeline.STAGES)
    now.write.parquet(f"{tmp_path}/documents.parquet")
    want = rows
    for name, plain in (("quality_rules", py_quality), ("language_id", py_language), ("ngram_jaccard", py_copies), ("suffix_dedup", lambda r: py_passages(r, corpus_pipeline.PASSAGE))):
        before, want = len(want), plain(want)
        now = written(stages[name](spark, now, ""), "test")
        assert order(now.collect()) == order(want), name
        assert name == "suffix_dedup" or len(want) < before
    assert any(len(r[1]) < n for r, n in zip(want, (len(dict((x[0], x[1]) for x in rows)[r[0]]) for r in want), strict=True))
    lib, own = library("byte_bpe_50k.json"), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own.setdefault(r.doc_id, []).append(r)
    assert P and set(own) == {r[0] for r in want}
    for d, text, *_ in want:
        pieces = sorted(own[d], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u2") for p in pieces]).tolist() == lib.encode(text, add_special_tokens=False).ids + [0]
