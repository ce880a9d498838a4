import random
from collections import Counter
from math import log2

import numpy as np
import pytest

from lumenframe.llm import langid


def grams_of(texts):
    """Each text by itself: the four bytes up to each of its bytes."""
    c = Counter(int.from_bytes((langid.PAD + t)[i : i + 4], "big") for t in texts for i in range(len(t)))
    return np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)


def py_bits(grams, text):
    counts = [Counter() for _ in range(4)]
    for g, n in zip(*map(np.ndarray.tolist, grams), strict=True):
        for order in range(4):
            counts[order][g.to_bytes(4, "big")[3 - order :]] += n
    by = [{} for _ in range(4)]
    for order in range(4):
        for g, n in counts[order].items():
            by[order].setdefault(g[:-1], {})[g[-1]] = n
    raw, total = langid.PAD + text, 0.0
    for i in range(3, len(raw)):
        for order in (3, 2, 1, 0):
            own = by[order].get(raw[i - order : i])
            if own is None:
                continue
            seen = sum(own.values()) + len(own)
            if raw[i] in own:
                total -= log2(own[raw[i]] / seen)
                break
            total -= log2(len(own) / seen)
        else:
            total += 8
    return total


@pytest.fixture(scope="module")
def samples():
    """Texts of four languages of Latin letters, and of two that share the lead bytes of Cyrillic letters but not the words."""
    rnd = random.Random(5)
    latin = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,"
    one, two = "абвгдежзик", "лмнопабвгд"
    text = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(n))
    out = {f"l{k}": [text(latin[16 * k : 16 * k + 16], 60).encode() for _ in range(60)] for k in range(4)}
    return out | {"x1": [text(one, 40).encode() for _ in range(20)], "x2": [text(two, 40).encode() for _ in range(20)]}


def test_two_languages_of_one_script_are_told_apart(samples):
    model = langid.Model({k: grams_of(v[:-8]) for k, v in samples.items()})
    for lang in ("x1", "x2"):
        short = [t[:24] for t in samples[lang][-8:]]
        assert [model.langs[k] for k in model.bits(short).argmin(1)] == [lang] * 8


def test_code_lengths_are_those_of_the_trees(samples):
    grams = {k: grams_of(v[:-8]) for k, v in samples.items()}
    model = langid.Model(grams)
    texts = [samples["x1"][-1][:90], samples["l2"][-1][:90], b"", bytes(range(256)), "ü€ абв Abc".encode()]
    want = [[py_bits(grams[k], t) for k in model.langs] for t in texts]
    assert model.bits(texts) == pytest.approx(np.array(want), abs=1e-6)


def test_counts_do_not_depend_on_the_layout_of_rows(spark, samples):
    rows = [(lang, t.decode()) for lang, v in samples.items() for t in v] + [("l0", ""), ("l0", None), ("l1", "x")]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = {(lang, g): n for lang, v in samples.items() for g, n in zip(*grams_of(v + [b"x"] * (lang == "l1")), strict=True)}
    for parts in (1, 40):
        got = {(r.lang, r.gram): r.n for r in langid.gram_counts(df.repartition(parts)).collect()}
        assert got == want


def test_query_equals_plain_version(spark, samples, tmp_path):
    """From rows to languages and scores; ties of two languages with the same texts go to the first."""
    import zlib

    texts = [(lang, t.decode()[:80]) for lang, v in samples.items() for t in v[:12]]
    texts += [("l3b", t) for lang, t in texts if lang == "l3"]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(900, None, "l0"), (901, "123 .", "l1"), (902, "", None), (903, texts[0][1], None), (None, texts[1][1], "l0"), (904, "абв", None)]
    # Both copies of a language learn from the same ids' texts.
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    twin = {t for i, t, lang in rows if lang in ("l3", "l3b") and held(i)}
    rows = [r for r in rows if not (r[2] in ("l3", "l3b") and r[1] in twin and not held(r[0]))]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    learn = {}
    for i, t, lang in rows:
        if lang is not None and not held(i):
            learn.setdefault(lang, []).append((t or "").encode())
    grams = {k: grams_of(v) for k, v in learn.items()}
    want = {}
    for i, t, _ in rows:
        bits = {k: py_bits(grams[k], (t or "").encode()) for k in sorted(learn)}
        best = min(bits, key=lambda k: (round(bits[k], 6), k))
        letter = any(c.isalpha() for c in t or "")
        want[i] = (held(i), best if letter else "und", 1 / sum(2 ** (bits[best] - x) for x in bits.values()) if letter else 0.0)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.op7_language_id(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == pytest.approx(want[k][2], abs=1e-9) for k in want)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    df = spark.createDataFrame([(i, str(i), "abc") for i in range(3)], "key long, lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(df)
