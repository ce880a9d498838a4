import random
import zlib

import numpy as np
import pytest

from lumenframe.llm import toxicity as t
from tests.llm.conftest import prose


def corpus(n, seed=5):
    """(id, text, lang, toxic): in one language a word is toxic, in the other a beginning of words."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang, bad = ("en", "x"), i % 6 == 0
        words = prose(rnd, rnd.randrange(5, 90)).split()
        lang = "de" if i % 3 == 1 else "en"
        if lang == "de":
            words = [w[::-1] + "ung" for w in words]
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = "idiot" if lang == "en" else "schwach" + rnd.choice("abcdefgh") * 3
        out.append((i, " ".join(words), lang, int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    return t.train(corpus(1200))


def plain_logit(net, text):
    """The network word by word."""
    words = [w.lower().encode() for w in text.split()]
    vectors = []
    for w in words:
        h = t.block_of([w]).hashed[0]
        vectors.append(np.mean([net.emb[i] for i in h], axis=0))
    vectors = vectors or [np.zeros(t.DIMS)]
    n = len(vectors)
    vectors += [np.zeros(t.DIMS)] * t.GAP
    z = float(net.bias)
    for k, (kernel, bias) in enumerate(zip(net.kernels, net.biases, strict=True)):
        for f in range(t.FILTERS):
            top = max(sum(float(vectors[p + o] @ kernel[o, :, f]) for o in range(kernel.shape[0])) + float(bias[f]) for p in range(n))
            z += max(top, 0.0) * float(net.dense[k * t.FILTERS + f])
    return z


def test_network_equals_plain_version(model):
    texts = ["", "idiot", "one two", "a b c d idiot e", " \n ", "Idiot IDIOT x", *(r[1] for r in corpus(20, 9))]
    got = model.net.logits(t.block_of([x.encode() for x in texts]))
    assert got == pytest.approx([plain_logit(model.net, x) for x in texts], abs=1e-4)
    whole = model.scores([x.encode() for x in texts])
    assert whole == pytest.approx([model.scores([x.encode()])[0] for x in texts], abs=1e-6)


def test_gradient_is_that_of_the_loss():
    """A step's gradients, taken from the step sizes, equal differences of the loss."""
    rows = corpus(8, 3)
    docs, y = [t.block_of([r[1].encode()]) for r in rows], np.array([r[3] for r in rows])
    net = t.Net()
    net.emb *= 30
    loss = lambda: t.log_loss(net.logits(t.merged(docs)), y)
    spots = [("kernel1", net.kernels[1], (1, 2, 3)), ("bias0", net.biases[0], (2,)), ("dense", net.dense, (7,))]
    want = []
    for _, value, at in spots:
        kept = value[at]
        value[at] = kept + 1e-2
        up = loss()
        value[at] = kept - 1e-2
        want.append((up - loss()) / 2e-2)
        value[at] = kept
    steps = t.Steps(0.0)
    t.learn(net, docs, y, steps)
    for (name, _, at), g in zip(spots, want, strict=True):
        assert np.sqrt(steps.seen[name][at]) == pytest.approx(abs(g), abs=2e-3)
    assert steps.seen["emb"].any()


def test_new_documents_are_told(model):
    rows = corpus(600, 77)
    s = model.scores([r[1].encode() for r in rows])
    y = np.array([r[3] for r in rows])
    assert s[y == 1].min() > 0 and s.max() < 1
    for lang in ("en", "de"):
        own = np.array([r[2] == lang for r in rows])
        assert ((s >= 0.3) & (y == 1) & own).sum() >= 0.9 * ((y == 1) & own).sum()
        assert ((s >= 0.3) & (y == 0) & own).sum() <= 0.03 * ((y == 0) & own).sum()
    told = model.language(t.block_of([r[1].encode() for r in rows]))
    assert np.mean([model.langs[k] == r[2] for k, r in zip(told, rows, strict=True)]) > 0.98


def test_thresholds_differ_by_language():
    z = np.concatenate([np.linspace(-4, 4, 200), np.linspace(-4, 4, 200)])
    lang = np.repeat([0, 1], 200)
    y = np.where(lang == 0, z > 1, z > -1).astype(int)
    slope, offset = t.calibrated(z, y, lang, 3)
    cut = (np.log(0.3 / 0.7) - offset) / slope
    assert cut[0] - cut[1] > 1 and cut[1] < cut[2] < cut[0]  # a language without rows gets what is common


def test_order_of_rows_does_not_matter():
    rows = corpus(150)
    a, b = t.train(rows, 2), t.train(rows[::-1], 2)
    x = [r[1].encode() for r in corpus(30, 8)]
    assert (a.scores(x) == b.scores(x)).all()


def test_nothing_to_learn_from():
    assert 0 <= t.train([]).scores([b"a", b""])[0] < 0.3
    assert t.train([(1, "a", None, 1), (2, None, "en", 1)]).scores([b"a"])[0] > 0.9


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (200 if i == 3 else 5), "en", 1) for i in range(2000)] + [(None, "y", "en", 1)], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    every = t.labelled_sample(docs, labels, 10**6, 100)
    assert {r[0]: r[3] for r in every} == {i: int(i % 2 or i == 4) for i in range(2000) if i != 3}
    assert 50 < len(t.labelled_sample(docs, labels, 100)) < 170


def test_query_scores_all_texts_by_text_alone(spark, tmp_path):
    rows = corpus(900)
    rows[1] = (1, None, "en", 0)
    rows[2] = (2, "", None, 0)
    rows += [(None, "idiot", "en", 1), (3, rows[3][1], "de", 1)]
    # Extra columns have names that the operator uses inside.
    docs = spark.createDataFrame([(i, x, lang, "s", 1, 0.5) for i, x, lang, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = t.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = {}
    for i, _, _, y in rows:
        known[i] = max(y, known.get(i, 0))
    model = t.train([(i, x, lang, known[i]) for i, x, lang, _ in rows if i is not None and not held(i)])
    want = sorted(((str(i), round(s, 6)) for (i, *_), s in zip(rows, model.scores([(r[1] or "").encode() for r in rows]), strict=True)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in out) == want
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in out)
    toxic = [r for r in out if r.held_out and known[r.doc_id]]
    assert np.mean([r.predicted for r in toxic]) > 0.85


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert t.score(docs, ["doc_id"], t.train([])).count() == 0
