import hashlib
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chat, embeddings, langid, quality, registry, urls, warc
from lumenframe.llm.common import scratch_path
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    check(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])


# Chat formatting


def test_chat_reads_back(spark):
    texts = ["<|im_end|>", "<|im_sep|>&lt;|", "&amp;&", "", None, "a\nb", "<", "|>", "<|im_start|>assistant\nx"]
    rnd = random.Random(1)
    rows = [(c, i, rnd.choice(["user", "assistant", "system", None, "odd\nrole<|", "a&#10;b", "&amp;#10;", "&lt;|", "<|im_end|>"]), rnd.choice(texts), "x") for c in range(20) for i in range(rnd.randrange(1, 9))]
    rows += [(97, 0, "user", ";x", "x"), (97, 0, "user", "<|x", "x"), (97, 0, "user", "&x", "x")]
    rows += [(99, 0, "assistant", "same", "x")] * 2 + [(None, 0, "assistant", "no id", "x"), (98, None, "assistant", "no turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in own]
        assert got[c].loss_text == "".join(t for _, r, t in own if r == "assistant")


def test_chat_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Quality rules


def test_quality_counts():
    texts = ["a b\na b\n\n \nc", "", "x" * 10 + " ###", " ".join("abcdefgh") + " " + " ".join("abcdefgh") + " z", "é ü\x0bñ"]
    got = list(zip(*(x.tolist() for x in quality.counted(texts)), strict=True))
    assert got == [(5, 5, 0, 1, 0, 3), (0, 0, 0, 0, 0, 0), (2, 13, 3, 0, 0, 1), (17, 17, 0, 0, 16, 1), (3, 3, 0, 0, 0, 1)]


def test_quality_bins_are_monotone(spark):
    df = spark.range(0, 5000).select("id", F.expr(quality.binned("id")).alias("bin")).withColumn("low", F.expr(quality.bin_floor("bin")))
    rows = df.orderBy("id").collect()
    for r in rows:
        assert r.low <= r.id < r.low * 1.0626 + 1
    assert all(a.bin <= b.bin for a, b in zip(rows, rows[1:]))


def test_quality_judges(docs, none):
    out = {r.own_row.doc_id: r for r in quality.judge(docs, ["doc_id"]).collect()}
    assert not out[2].kept and out[2].base_failed and out[2].n_words == 0
    assert out[0].kept and out[30].kept
    assert quality.judge(none, ["doc_id"]).count() == 0


def test_quality_rejects_symbols(spark):
    rnd = random.Random(2)
    good = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(60)), "en", "s") for i in range(100)]
    bad = [(1000 + i, " ".join(f"w{rnd.randrange(500)}###" for _ in range(60)), "en", "s") for i in range(8)]
    out = {r.own_row.doc_id: r.kept for r in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(out[i] for i, *_ in good) and not any(out[i] for i, *_ in bad)


# WARC


def split_read(raw, split):
    """Ids of the records that the ranges of a file own."""
    f = io.BytesIO(raw)
    ranges = [(s, warc.chains_in(f, len(raw), s, s + split)) for s in range(0, len(raw), split)]
    return [h["warc-record-id"][len("<urn:page:") : -1] for first, at in warc.true_chains(ranges, split, len(raw)) for h, _ in warc.records_from(f, len(raw), at, first + split)]


def stored(data):
    """A gzip member that holds its data as they are."""
    z = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_warc_round_trip_and_splits(spark):
    rnd = random.Random(4)
    inner = b"".join(warc.gzip_member(warc.record(900 + i, "http://in/", b"inner" * 50, "d")) for i in range(3))
    blobs = [b"", b"short", rnd.randbytes(5000), inner * 2, b"WARC/1.1\r\n\r\n" * 30, b"\x1f\x8b\x08" * 100, None]
    rows = [(i, f"http://h/{i}?q=ü %20", bytearray(b) if (b := blobs[i % len(blobs)]) is not None else None, "x") for i in range(60)]
    same = bytearray(b"z" * 200)
    rows += [(90, " odd\r\nurl %20\u2028 ", bytearray(b"odd"), "x"), (500, "u", same, "x"), (500, "u", same, "x"), (501, "u", same, "x"), (None, "u", same, "x"), (None, "v", bytearray(b"w" * 300), "x"), (None, "v", bytearray(b"w" * 300), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary, first string").repartition(2)
    first, count = {}, {}
    for i, u, b, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(bytes(b or b""), (i, u))
    want = {}
    for i, u, b, _ in rows:
        b = bytes(b or b"")
        count[i, u, b] = count.get((i, u, b), 0) + 1
        revisit = len(b) >= 100 and ((i, u) != first[b] or count[i, u, b] > 1)
        key = (None if i is None else str(i), u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", (None if first[b][0] is None else str(first[b][0])) if revisit else None, None if revisit else b)
        want[key] = want.get(key, 0) + 1
    for small in (warc.SMALL, 0):
        old, warc.SMALL = warc.SMALL, small
        try:
            files = warc.write_archives(warc.classified(df), scratch_path(spark, "warc"))
        finally:
            warc.SMALL = old
        for split in (700, 1 << 20):
            got = {}
            for r in warc.read_archives(files, split).collect():
                key = (r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
                got[key] = got.get(key, 0) + 1
            assert got == want


@pytest.mark.parametrize("inside", [1, 2, 3, 7])
def test_warc_ignores_members_inside_members(inside):
    """Archives of one and more members, stored as they are in a payload, at every split."""
    inner = b"".join(warc.gzip_member(warc.record(700 + i, "http://in/", b"x" * 90, "d")) for i in range(inside))
    one = warc.gzip_member(warc.record(2, "http://out/", b"y", "d"))
    deep = stored(warc.record(3, "http://out/", stored(warc.record(800, "http://in/", inner, "d")) + inner, "d"))
    raw = stored(warc.record(1, "http://out/", inner, "d")) + one + deep + one
    for split in [*range(20, len(raw) + 40, 13), 10 * len(raw)]:
        assert split_read(raw, split) == ["1", "2", "3", "2"], split


def test_warc_members_over_ranges_and_damage():
    rnd = random.Random(9)
    long = warc.gzip_member(warc.record(5, "u", rnd.randbytes(30_000), "d"))
    one = warc.gzip_member(warc.record(6, "u", b"y" * 50, "d"))
    other = warc.gzip_member(b"no record")
    bad = bytearray(one)
    bad[-3] ^= 255
    for split in (64, 100, 1000, 7777, 1 << 20):
        assert split_read(long + one + long, split) == ["5", "6", "5"]
        assert split_read(one + other + long, split)[-1] == "5"
        assert split_read(long + bytes(bad) + one, split) == ["5", "6"]
        assert split_read(b"", split) == [] == split_read(b"no archive at all" * 40, split)


def test_warc_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, payload binary")
    assert warc.read_archives(warc.write_archives(warc.classified(df), scratch_path(spark, "warc"))).count() == 0


# URLs


def test_url_parts_and_rules():
    assert urls.host_path("HTTP://WWW.Ex.Org/A?b#c") == ("www.ex.org", "/A")
    assert urls.host_path("x://h#f/") == ("h", "") and urls.host_path(None) == ("", "") and urls.host_path("no") == ("", "")
    book = urls.RuleBook(urls.RULES)
    assert book.find("a.example.org", "/es/1") == ("example.org/es/", "block")
    assert book.find("example.org", "/en/12") == ("example.org/en/1", "block")
    assert book.find("example.org", "/en/2") == ("org/", "allow")
    assert book.find("notexample.org", "/es/1") == ("org/", "allow")
    assert book.find("org", "") == (None, None) and book.find("", "/fr/") == (None, None)


def test_url_held_out():
    """New hosts of known stems, and hosts of stems left out of training: what an n-gram can't know is allowed."""
    w = urls.train(urls.labelled_urls())
    new = lambda stems: [urls.host_path(f"http://{h}/en/1") for h in urls.made_hosts(stems, 4321)]
    assert np.mean(urls.logits(new(urls.BAD_STEMS), w) > 0) > 0.9
    assert np.mean(urls.logits(new(urls.GOOD_STEMS), w) <= 0) > 0.97
    assert np.mean(urls.logits([urls.host_path(f"http://{h}/") for h in urls.made_names(500, 99)], w) <= 0) > 0.97
    block, allow = urls.held_out()
    assert block > 0.05 and allow > 0.85


def py_parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[2]), m[3]) if m else ("", "")


def py_rule(host, path):
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if re.search(rf"(^|\.){re.escape(h)}$", host) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def test_url_query_against_another_parser(spark, tmp_path):
    rnd = random.Random(8)
    pick = lambda *x: rnd.choice(x)
    made = [pick("http", "HTTPS", "", "a://b") + pick("://", "://", ":/", "") + pick("", "www.", "A.b.", "ü.", "x") + pick("example", "Example", "my-shop", "") + pick(".org", ".com", ".net", "org", ".") + pick("", ":80") + pick("", "/", "/es/", "/en/1", "/fr/9", "/de/x", "/é") + pick("", "?q=/fr/", "#/de/", "//") for _ in range(3000)]
    made += [None, "", "://", "http://example.org/es/" + "x" * 100_000, "http://" + "a." * 5000 + "example.org/en/12"]
    spark.createDataFrame(list(enumerate(made)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = urls.op6_url_filters(spark, str(tmp_path)).collect()
    w = urls.train(urls.labelled_urls())
    assert len(rows) == len(made)
    for r in rows:
        host, path = py_parts(made[r.page_id])
        rule, verdict = py_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if urls.logits([(host, path)], w)[0] > 0 else "allow"))


def test_url_model(spark):
    w = urls.train(urls.labelled_urls())
    seen = urls.labelled_urls()
    z = urls.logits([urls.host_path(u) for u, _ in seen], w)
    assert np.mean((z > 0) == [y == 1 for _, y in seen]) > 0.98
    df = spark.createDataFrame([(1, None), (2, "http://best-casino.example.net/en/1"), (3, "http://weather-news.example.net/en/1"), (3, "http://weather-news.example.net/en/1")], "page_id long, url string")
    out = [(r.own_row.page_id, r.host, r.verdict) for r in urls.judge_urls(df, ["page_id"], urls.RULES, w).orderBy("own_row.page_id").collect()]
    assert out[1][2] == "block" and out[2] == out[3] and out[2][2] == "allow" and out[0][1] == ""
    assert urls.judge_urls(df.limit(0), ["page_id"], urls.RULES, w).count() == 0


# Languages


def test_code_lengths_are_those_of_escape_method_c():
    text = b"abracadabra abracadabra"
    raw = langid.PAD + text
    grams = [int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)]
    g, n = np.unique(np.array(grams), return_counts=True)
    m = langid.Model({"x": (g, n)})
    counts = {}
    for i in range(3, len(raw)):
        for k in range(4):
            c = counts.setdefault(raw[i - k : i], {})
            c[raw[i]] = c.get(raw[i], 0) + 1

    def bits(context, b):
        c = counts.get(context, {})
        if b in c:
            return -math.log2(c[b] / (sum(c.values()) + len(c)))
        esc = -math.log2(len(c) / (sum(c.values()) + len(c))) if c else 0
        return esc + (bits(context[1:], b) if context else 8)

    probe = b"abcab dab rac"
    padded = langid.PAD + probe
    want = sum(bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
    assert m.bits([probe])[0, 0] == pytest.approx(want, rel=2e-3)


def test_languages(spark, docs, none):
    rnd = random.Random(5)
    words = {"aa": ["bana", "lona", "mira"], "bb": ["krst", "zwlk", "prch"]}
    rows = [(i, lang, " ".join(rnd.choice(words[lang]) for _ in range(20))) for i in range(60) for lang in words]
    model = langid.train(spark.createDataFrame(rows, "key long, lang string, text string"))
    df = spark.createDataFrame([(1, "mira bana lona"), (2, "prch krst"), (3, None), (4, "12 345 ²"), (5, "krst " * 40000)], "doc_id long, text string")
    out = {r.own_row.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, ["doc_id"], model).collect()}
    assert out[1][0] == "aa" and out[2][0] == "bb" and out[3] == ("und", 0.0) and out[4] == ("und", 0.0) and out[5][0] == "bb"
    assert all(0 <= s <= 1 for _, s in out.values())
    empty = langid.train(none.select(F.col("doc_id").alias("key"), "lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, ["doc_id"], empty).collect()} == {"und"}


def test_texts_that_no_model_fits_go(spark):
    rnd = random.Random(6)
    words = {"aa": ["bana", "lona", "mira", "tolu"], "bb": ["krst", "zwlk", "prch", "vlkn"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(20, 90))), lang, "x") for i in range(120) for lang in words]
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [(1000, " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(60)), None, "x"), (1001, "αβγδε ζηθικ " * 30, None, "x"), (1002, None, "aa", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    kept = [r.doc_id for r in langid.told(df).collect()]
    assert sorted(kept) == sorted(r[0] for r in rows)


def test_held_out_accuracy(spark, sf_dir):
    out = langid.op7_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.95


# Embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 64))
    near = base[:60] + 0.2 * rng.standard_normal((60, 64))
    x = np.concatenate([base, near, base[:5] * 3, base[:20] + 0.3 * rng.standard_normal((20, 64))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, x[0].tolist(), 0), (901, None, 0), (902, [0.0] * 64, 0), (903, [float("nan")] * 64, 0), (904, [None] + [1.0] * 63, 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0), (3, x[3].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    ok = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    n = len(ok)
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = np.zeros(n, dtype=int)
    for a in range(n):
        for b in range(a):
            u, v = ok[a][1], ok[b][1]
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.95:
                links[[a, b]] += 1
                up[root(a)] = root(b)
    least = {}
    for a in range(n):
        least[root(a)] = min(least.get(root(a), 10**9), ok[a][0])
    want = sorted([(ok[a][0], int(links[a]), least[root(a)]) for a in range(n)] + [(i, 0, i) for i in (901, 902, 903, 904, 907)])
    assert links.sum() > 100
    got = embeddings.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    old, embeddings.WHOLE = embeddings.WHOLE, 60
    try:
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()) == want
    finally:
        embeddings.WHOLE = old
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_url_rules_of_equal_length_and_plain_training():
    """Of rules of one length the first in order wins; the model is that of a plain gradient descent, row by row."""
    book = urls.RuleBook([("block", "b.org/x"), ("allow", "b.org/x"), ("allow", "a.b.org/"), ("block", "org/")])
    assert book.find("b.org", "/xy") == ("b.org/x", "block") and book.find("c.a.b.org", "/") == ("a.b.org/", "allow") and book.find("b.orga", "/x") == (None, None)
    rows = [("http://casino-top.com/win", 1), ("http://poker.net/", 1), ("http://library.org/books", 0), ("http://museum.fr/about", 0), ("http://city.de/", 0), ("nothing", 0)]
    got = urls.train(rows, steps=30, rate=2.0, decay=0.01)
    grams = [urls.gram_indices([urls.host_path(u)])[1].tolist() for u, _ in rows]
    w, b = np.zeros(urls.DIMS), 0.0
    for _ in range(30):
        step, db = 0.01 * w, 0.0
        for g, (_, y) in zip(grams, rows, strict=True):
            n = math.sqrt(max(len(g), 1))
            p = 1 / (1 + math.exp(-(sum(w[i] for i in g) / n + b)))
            share = 0.2 / 2 if y else 0.8 / 4
            for i in g:
                step[i] += (p - y) * share / n
            db += (p - y) * share
        w, b = w - 2.0 * step, b - 2.0 * db
    assert got[:-1] == pytest.approx(w, abs=1e-9) and got[-1] == pytest.approx(b, abs=1e-9)


def test_url_words_held_out_by_stem():
    """Hosts of stems that training never saw: a model of n-grams knows some by their parts, and allows what it does not know."""
    blocked, allowed = urls.held_out()
    assert blocked > 0.15 and allowed > 0.9
