import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lumenframe.llm import bpe, packing  # noqa: E402
from lumenframe.llm.tokens import ByteLevelEncoder  # noqa: E402
from tests.llm.conftest import WORDS  # noqa: E402

HARD = [
    "", " ", "  a  b\n\nc \t d\n", "don't we'LL I'M it's ''s 'S", "<|endoftext|>", "x <|endoftext|> y", "a  <|startoftext|>b", "\x1c\x1d a\x1fb", "É é ﬁ ½ Ⅷ ² ٣",
    "İstanbul ΣΑΣ Ǆ ß straße", "a\u0301 \u0301a e\u0301,", "日本語 テスト。한국어", "🙂👍🏽 ok", "\u2028\u00a0\u3000x\u200by", "word,word;word… (a)[b]{c}", "A" * 5000, "ab " * 3000, "é" * 3000 + " " + "ü," * 2000,
    "a\r\nb\x0bc\x0cd\x85e", "x***y$$$ 12345 1,000.50 #tag |bar|",
]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_byte_level_pieces_are_exact(corpus):
    enc, lib = ByteLevelEncoder(P.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for t in [*HARD, *(t or "" for _, t in corpus)]:
        assert np.frombuffer(enc.packed(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:40]


def test_chunks_and_joins_are_exact(corpus):
    enc, lib = bpe.WordEncoder(P.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    assert enc.plain and enc.by_word
    for t in [*HARD, *(t or "" for _, t in corpus)]:
        if not t or not enc.sure(t):
            continue
        want = lib.encode(t, add_special_tokens=False).ids
        raw = t.encode()
        for chunks in (bpe.cut([raw])[0], [raw[i : i + 1] for i in range(len(raw))] if raw.isascii() and len(raw) < 400 else bpe.cut([raw])[0]):
            assert b"".join(chunks) == raw
            strs = [c.decode() for c in chunks]
            ids = bpe.assemble(strs, [bpe.encode_chunk(c, enc) for c in strs], enc)
            assert np.frombuffer(ids, enc.dtype).tolist() == want, t[:40]


def test_bpe_round_trip(spark, docs, corpus):
    hard = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)] + [(None, "null id")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(hard)
    path, lib = P.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = bpe.encode(both, path)
    assert got.agg({"n_reused": "sum"}).first()[0] > 0
    want = sorted((str(d), len(e := lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()) for d, t in [*corpus, *((1000 + i, t) for i, t in enumerate(HARD)), (None, "null id")])
    rows = [(str(r.doc_id), r.n_tokens, hashlib.sha256(bpe.wide(r.ids, r.width)).hexdigest()) for r in got.collect()]
    assert sorted(rows) == want
    back = bpe.decode(got, path, ["doc_id", "n_tokens"]).where("doc_id = 4").first()
    assert back.decoded == lib.decode(lib.encode("one", add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_empty_table(none):
    assert bpe.encode(none, P.path("word_bpe_49k.json")).count() == 0


def test_packing_is_gapless_and_whole(docs, corpus):
    lib = library("byte_bpe_50k.json")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), 64).collect()
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [0] for d, t in corpus}
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d, _ in corpus)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and np.frombuffer(r.ids, "<u2").tolist() == piece
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for s in sorted(by):
        at = 0
        for o, n in sorted(by[s]):
            assert o == at
            at += n
        ends.append(at)
    assert all(e == 64 for e in ends[:-1]) and sorted(by) == list(range(len(by)))


def test_packing_with_more_ranges_than_the_sample_can_cut(spark, monkeypatch):
    """Ranges are cut in two levels, also where a third of all rows are copies and one has no id; none holds more than thrice the mean."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(12))) for i in range(2400)] + [(i, "the same text " * 3) for i in range(2400, 3600)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tables = {}
    keep = packing.written
    monkeypatch.setattr(packing, "written", lambda t, name, *a: tables.setdefault(name, keep(t, name, *a)))
    monkeypatch.setattr(packing, "SAMPLE", 2000)
    monkeypatch.setattr(packing, "RANGE", sum(len(t) for _, t in rows) // 50)
    out = packing.pack(df, P.path("byte_bpe_50k.json"), 64).collect()
    sizes = [r["count"] for r in tables["packing-ranges"].groupBy("range_no").count().collect()]
    assert len(sizes) > 120 and max(sizes) <= 3 * len(rows) / len(sizes)
    ordered = tables["packing-ranges"].groupBy("range_no").agg(F.min("sort_key").alias("a"), F.max("sort_key").alias("b")).orderBy("range_no").collect()
    assert all(x.b <= y.a for x, y in zip(ordered, ordered[1:], strict=False))
    place = 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 64 + r.offset == place
        place += r.length
    lib = library("byte_bpe_50k.json")
    assert place == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_packing_empty_table(none):
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_hilbert_neighbours():
    """The curve visits each cell once and moves one step at a time."""
    n = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << n)] * 2, indexing="ij"), -1).reshape(-1, 2)
    key = packing.hilbert(cells, n)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
