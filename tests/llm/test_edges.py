"""Names that operators use inside, missing and repeated ids, ties, and the plans for large groups."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import bpe, chat, embeddings, jaccard, langid, packing, quality, repeats, urls, warc
from lumenframe.llm.common import scratch_path
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute

# Names that operators use for columns of their own.
NAMES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines kept base_failed lang0 source0 lang1 symbol_rate high_symbol_rate0 bin feature level"
    " score lang_pred bits_per_byte key gram n own_id mark key_a key_b rep component component_id n_shingles first f texts copies shared"
    " text_key ids n_bytes n_removed n_spans kept_sha256 bucket kind block curve_key part place ids_crc32 path bytes digest revisit refers_to"
    " twins host rule verdict cell home node size vec links formatted es blocks turns b"
).split()


@pytest.fixture(scope="module")
def wide(spark, corpus):
    """The corpus with a column of every such name."""
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({c: F.lit("x") for c in NAMES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_bear_any_column_names(spark, wide, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, wide, "")
    rows = out.collect()
    assert rows
    if name != "packing":
        assert out.columns == wide.columns and {tuple(r[c] for c in NAMES) for r in rows} == {("x",) * len(NAMES)}


def test_operators_bear_any_column_names(spark, wide):
    import public_tokenizers as P

    x = wide.where("doc_id < 20")
    assert quality.judge(x, x.columns).count() == langid.predict(x, x.columns, langid.train(x.select(F.col("doc_id").alias("key"), "lang", "text"))).count() == x.count()
    assert jaccard.linked(x).count() == repeats.remove_repeats(x).count() == bpe.encode(x, P.path("word_bpe_49k.json")).count() == x.count()
    assert packing.pack(x, P.path("byte_bpe_50k.json")).count() >= x.count()
    pages = x.withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://a.org/fr/"), "payload": F.encode("text", "UTF-8")})
    assert warc.read_archives(warc.write_archives(warc.classified(pages), scratch_path(spark, "warc"))).count() == x.count()
    assert urls.judge_urls(pages, pages.columns, urls.RULES, urls.train(urls.labelled_urls())).count() == x.count()
    v = wide.drop("doc_id").withColumns({"vec_id": F.monotonically_increasing_id(), "embedding": F.array(F.lit(1.0), F.lit(2.0))})
    assert embeddings.near_duplicates(v).count() == v.count()
    turns = wide.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(1), "role": F.lit("user")})
    assert chat.read_back(chat.format_chats(turns)).count() == wide.select("doc_id").distinct().count()


# N-gram Jaccard join


def test_classes_without_ids_link(spark):
    rnd = random.Random(3)
    w = prose(rnd, 80).split()
    text = lambda k: " ".join(w + [f"more{i}" for i in range(k)])
    rows = [(3, text(0)), (None, text(1)), (9, text(2)), (None, prose(rnd, 50)), (None, prose(rnd, 50)), (None, ""), (4, "a b c d"), (4, "e f g h"), (5, "E F G H")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 97).collect())
    # 3 and 9 share 78 of 80 shingles and link only by the row without an id; the texts under id 4 stay apart.
    assert got == sorted([(3, 78, 3), (-1, 79, 3), (9, 80, 3), (-1, 48, -1), (-1, 48, -1), (-1, 0, -1), (4, 2, 4), (4, 2, 4), (5, 2, 4)])


@pytest.mark.parametrize(("short", "block", "small"), [(0, 3, 0), (2, 7, 500_000), (10**6, 1024, 0)])
def test_long_and_short_lists_give_the_same(docs, corpus, monkeypatch, short, block, small):
    for name, v in (("SHORT", short), ("BLOCK", block), ("SMALL", small)):
        monkeypatch.setattr(jaccard, name, v)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(docs, 3, 90).collect())
    assert got == brute(corpus, 3, 90)


def test_one_of_each_group_stays(spark):
    rnd = random.Random(5)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(2, a, 0), (1, a.upper(), 1), (1, b, 2), (1, b, 2), (None, c, 3), (None, c + " end", 4), (None, None, 5), (None, "", 6), (7, None, 7)]
    got = sorted(r.n_chars for r in jaccard.without_copies(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect())
    assert got[:2] == [1, 2] and got[2] in (3, 4) and got[3:] == [5, 6, 7]


# Embeddings


def pair_vectors(rng, dims, gap0, total):
    """Two unit vectors at squared distance total whose rotated first blocks of eight are gap0 apart, in steps far along the first coordinate."""
    u = rng.standard_normal(dims)
    u /= np.linalg.norm(u)
    d = np.zeros(dims)
    d[:8] = rng.standard_normal(8) * [1, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01, 0.01]
    d[:8] *= np.sqrt(gap0) / np.linalg.norm(d[:8])
    r = rng.standard_normal(dims - 8)
    d[8:] = r * np.sqrt(total - gap0) / np.linalg.norm(r)
    # The chord of a unit sphere: make the middle orthogonal to it.
    m = u - d * (u @ d) / (d @ d)
    m *= np.sqrt(1 - (d @ d) / 4) / np.linalg.norm(m)
    return m + d / 2, m - d / 2


@pytest.mark.parametrize("single", [False, True])
def test_no_link_is_lost_at_the_bounds_of_a_block(spark, single):
    """Pairs whose distance in the first block is within rounding of its share, and in other blocks anywhere."""
    rng = np.random.default_rng(3)
    share = 0.1 * 8 / 64
    vecs = []
    for off in [*np.linspace(-5e-6, 1.5e-5, 41), 0.0, 1e-9, -1e-9, 2e-5, 2.1e-5]:
        for total in (0.018, 0.05, 0.0999):
            vecs += pair_vectors(rng, 64, share + off, total)
    x = np.array(vecs) @ embeddings.rotation(64).T
    x = x.astype(np.float32).astype(float) if single else x
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(u @ u.T, 1) >= 0.95).sum())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{'float' if single else 'double'}>")
    assert want >= 120
    assert embeddings.near_duplicates(df).agg(F.sum("n_links")).first()[0] == 2 * want


def test_dense_and_sparse_cells(spark, monkeypatch):
    """A group of near copies among strangers, with the finer grid and in parts."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    x = np.concatenate([rng.standard_normal((300, 64)), centre + 0.12 * rng.standard_normal((300, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for fine, whole in ((32, 100_000), (10**9, 100_000), (64, 200)):
        monkeypatch.setattr(embeddings, "FINE", fine)
        monkeypatch.setattr(embeddings, "WHOLE", whole)
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(x))] == links.tolist()


def test_vectors_without_ids_link(spark):
    rows = [(None, [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.1]), (5, [1.0, 2.0, 3.01]), (None, [3.0, -1.0, 0.0])]
    got = [(r.vec_id, r.n_links, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(n for _, n, _ in got) == [0, 2, 2, 2]


# Chats


def test_a_long_conversation(spark):
    n = 16_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|"), F.col("id"), F.repeat(F.lit(" text"), 20)).alias("text"))
    chat.read_back(chat.format_chats(rows.limit(10))).collect()
    began = time.time()
    r = chat.read_back(chat.format_chats(rows)).collect()[0]
    assert time.time() - began < 8
    want = [("user" if i % 3 == 0 else "assistant", f"é<|{i}" + " text" * 20) for i in range(n)]
    assert [(t.role, t.text) for t in r.turns] == want
    assert r.loss_text == "".join(t for role, t in want if role == "assistant")


# Encoding


def test_bits_of_the_map(spark, docs, monkeypatch):
    """False hits of a map too small for its chunks cost nothing but work."""
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    want = sorted((r.doc_id, r.ids) for r in bpe.encode(docs, path).select("doc_id", "ids").collect())
    monkeypatch.setattr(bpe, "LEAST_BITS", 1 << 3)
    monkeypatch.setattr(bpe, "MOST_BITS", 1 << 3)
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(docs, path).select("doc_id", "ids").collect()) == want


def test_bpe_digests(spark, corpus):
    """ids_sha256 and decoded_sha256 of every text agree with the library, long texts and marks included."""
    import hashlib

    import public_tokenizers as P
    from tests.llm.test_tokens import HARD, library

    lib, path = library("word_bpe_49k.json"), P.path("word_bpe_49k.json")
    texts = [*HARD, *(t for _, t in corpus), "w" * 20_000, "no " * 9000 + "<|endoftext|>" + " yes" * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id")] * 3, "doc_id long, text string")
    texts = dict(enumerate(texts)) | {None: "null id"}
    out = bpe.encode(df, path, bpe.digests, "ids_sha256 string, decoded_sha256 string").collect()
    assert len(out) == len(texts) + 2
    for r in out:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
