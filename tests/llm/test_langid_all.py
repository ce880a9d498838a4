"""The pipeline's models of languages and their limits come from all texts."""

import random

from lumenframe.llm import langid


def test_told_learns_from_all_texts(spark, monkeypatch):
    """More text of a language than a sample holds: words that only one text has are still known, and limits count every text."""
    rnd = random.Random(8)
    words = ["bana", "lona", "mira", "tolu"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(6000)), "aa") for i in range(90)] + [(200 + i, "krst zwlk prch vlkn " * 40, "bb") for i in range(20)]
    assert sum(len(t) for _, t, lang in rows if lang == "aa") > 2_000_000
    seen = []
    keep = langid.gram_counts
    monkeypatch.setattr(langid, "gram_counts", lambda df: (seen.append(df.count()), keep(df))[1])
    df = spark.createDataFrame([*rows, (500, "αβγ " * 50, None), (501, None, "aa")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.told(df).select("doc_id").collect()) == [i for i, _, _ in rows]
    assert seen == [len(rows) + 1]  # the row without a text has a label
    assert langid.told(df.limit(0)).count() == 0
