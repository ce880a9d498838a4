import hashlib

import pytest

from lumenframe.llm.repeats import remove_repeats


def brute(rows, width):
    first = {}
    for d, t in rows:
        x = (t or "").encode()
        for p in range(len(x) - width + 1):
            first[x[p : p + width]] = min(first.get(x[p : p + width], d), d)
    out = []
    for d, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - width + 1):
            if first[x[p : p + width]] < d:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [50, 37])
def test_agrees_with_all_windows(docs, corpus, width):
    got = sorted(tuple(r) for r in remove_repeats(docs, width).collect())
    assert got == brute(corpus, width)


def test_parts_of_buckets_change_nothing(docs, corpus):
    got = sorted(tuple(r) for r in remove_repeats(docs, 50, fan=3).collect())
    assert got == brute(corpus, 50)


def test_null_ids_come_last(spark, corpus):
    passage = "p" * 20 + " passage of more than fifty bytes that several rows hold " + "q" * 20
    rows = [(None, passage + " first"), (7, "x " + passage), (None, passage + " second"), (9, None)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed > 0) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, False), (9, False), (99, True), (99, True)]


def test_kept_text_and_columns(docs, corpus):
    out = remove_repeats(docs, with_text=True, keep=("lang", "source")).collect()
    assert len(out) == len(corpus)
    for r in out:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.own_row.lang == ("en" if r.doc_id % 2 else None) and r.own_row.source == "s"


def test_tables_of_long_texts_are_not_kept():
    from lumenframe.llm import kernels

    kernels.shingle_sets([b"word " * 1_000_000], 3)
    assert all(len(t) <= kernels.BLOCK + 4096 for t in kernels._tables.values())


def test_empty_table(none):
    assert remove_repeats(none).count() == 0
