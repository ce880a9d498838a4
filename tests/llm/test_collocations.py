import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import collocations as c


def plain(rows, least=10, longest=3, share=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = Counter()
    for (lang, w), a in f.items():
        if a >= least:
            for s in range(2, len(w)):
                for i in range(len(w) - s + 1):
                    held[lang, w[i : i + s]] = max(held[lang, w[i : i + s]], a)
    out = {}
    for (lang, w), a in f.items():
        if a >= least and len(w) > 1 and 100 * held[lang, w] < share * a:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most], 1))


def table(spark, rows, parts=3):
    # Extra columns have names that the operator uses inside.
    return spark.createDataFrame([(x, t, 1, "p", 0) for x, t in rows], "lang string, text string, f long, phrase string, bucket int").repartition(parts)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "NEW", "times", "é", "a=b", "the", "of", "x\x0by", "Ünder", "<|z|>", " ", "aa"]
    seps = [" ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "! ", "\r\n"]
    rows = [(rnd.choice(["en", "en", "en", "de", None, "und", ""]), "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randrange(0, 40)))) for _ in range(n)]
    return rows + [("en", None), (None, None), ("fr", None), ("en", ""), ("en", " \t. ,"), ("en", "same line here. " * 40), ("de", "z " * 300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_plain_counts(spark, seed):
    rows = rows_of(seed)
    assert got(c.collocations(table(spark, rows), least=5)) == plain(rows, least=5)


def test_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With a few cells all phrases look heavy, or nearly; the second pass is exact."""
    monkeypatch.setattr(c, "SEGMENT_BITS", 4)
    monkeypatch.setattr(c, "LEAST_BITS", 6)
    monkeypatch.setattr(c, "MOST_BITS", 6)
    rows = rows_of(3)
    assert got(c.collocations(table(spark, rows, 7))) == plain(rows)


def test_longer_phrases_small_groups_and_batches(spark, monkeypatch):
    """Four words, long texts cut at separators, ranks by levels."""
    rnd = random.Random(4)
    text = ". ".join(" ".join(rnd.choice("a b c d e f g h".split()) for _ in range(9)) for _ in range(900))
    rows = [("en", text), ("en", text.upper()), (None, "a b c d " * 50)]
    monkeypatch.setattr(c, "BATCH", 700)
    monkeypatch.setattr(c, "GROUP", 100)
    monkeypatch.setattr(c, "HELD_ROWS", 50)
    monkeypatch.setattr(c, "HELD", 60)
    assert got(c.collocations(table(spark, rows, 2), least=10, longest=4, most=40)) == plain(rows, longest=4, most=40)


def test_counts_beyond_a_byte(spark):
    rows = [("en", "one two. " * k) for k in (200, 100, 1)] + [("en", "rare pair")] * 299
    assert got(c.collocations(table(spark, rows, 5), least=300)) == plain(rows, least=300)


def test_empty_table(spark):
    assert got(c.collocations(table(spark, [("en", "a b")]).where("lang = 'none'"))) == []
    assert got(c.collocations(table(spark, [("en", None), (None, " ")]))) == []


def test_long_text_is_cut_at_separators():
    t = b"aa bb. " * 50 + b"c" * 400
    parts = c.cut_long(t, 64)
    assert b"".join(parts) == t and len(parts) > 5 and all(p[:1] == b"." for p in parts[1:])


def test_phrases_are_told_apart_where_keys_do_not_fit(monkeypatch):
    w = c.Words(["en", "de"], [b"a b c a b c", b"a b c"])
    at, _ = w.phrases(3)
    key, steps = w.packed(at, 3)
    assert len(np.unique(key)) == 4 and steps == [3, 3, 3]
    w.words = type("Many", (), {"__len__": lambda self: 1 << 40, "take": w.words.take})()
    key, steps = w.packed(at, 3)
    assert len(np.unique(key)) == 4 and len(steps) > 3
    assert sorted(zip(*(x.to_pylist() for x in w.counted(at, 3).columns), strict=True)) == [("de", "a b c", 1), ("en", "a b c", 2), ("en", "b c a", 1), ("en", "c a b", 1)]
