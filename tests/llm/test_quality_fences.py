import random

from lumenframe.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rnd, n, letters=5):
    return [f"{'w' * rnd.randrange(letters - 1, letters + 2)}{rnd.randrange(10**6)}" for _ in range(n)]


def judged(spark, rows):
    return {r.own_row.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}


def symbols(words, share):
    return " ".join(w + "#" if i % 100 < share else w for i, w in enumerate(words))


def test_languages_need_their_own_fences(spark):
    """Symbols at 30 of 100 words are common in one language and stand out in the other, as do long words: no constant does for both."""
    rnd = random.Random(1)
    code = [(i, symbols(prose(rnd, 100), rnd.randrange(10, 60)), "code", "s") for i in range(400)]
    text = [(1000 + i, symbols(prose(rnd, 100), 0), "text", "s") for i in range(400)]
    long = [(2000 + i, " ".join(prose(rnd, 100, 40)), "long", "s") for i in range(400)]
    probe = [(5000, symbols(prose(rnd, 100), 30), "code", "s"), (5001, symbols(prose(rnd, 100), 30), "text", "s"), (5002, " ".join(prose(rnd, 100, 40)), "long", "s"), (5003, " ".join(prose(rnd, 100, 40)), "text", "s"), (5004, " ".join(prose(rnd, 100)), "long", "s"), (5005, " ".join("#" * 40 + w for w in prose(rnd, 100)), "code", "s")]
    out = judged(spark, code + text + long + probe)
    assert all(out[i].kept for i, *_ in code + text + long)
    assert [out[i].kept for i in range(5000, 5006)] == [True, False, True, False, False, False]
    assert not any(out[i].base_failed for i in range(5000, 5006))


def test_a_source_of_its_own_kind_is_no_fault(spark):
    rnd = random.Random(2)
    rows = [(i, symbols(prose(rnd, 100), 0), "en", "news") for i in range(2000)] + [(10_000 + i, symbols(prose(rnd, 100), rnd.randrange(20, 50)), "en", "forum") for i in range(60)]
    out = judged(spark, [*rows, (20_000, symbols(prose(rnd, 100), 40), "en", "news")])
    assert all(out[i].kept for i, *_ in rows) and not out[20_000].kept


def test_each_rate_can_reject_a_text_that_passes_the_base_rule(spark):
    rnd = random.Random(3)
    good = [(i, "\n".join(" ".join(prose(rnd, 10)) for _ in range(10)), "en", f"s{i % 3}") for i in range(1500)]
    phrase = prose(rnd, 9)
    bad = [
        (9000, symbols(prose(rnd, 100), 90), "en", "s0"),
        (9001, " ".join(prose(rnd, 100, 60)), "en", "s1"),
        (9002, "\n".join(x for w in prose(rnd, 60) for x in (w, "same")), "en", "s2"),
        (9003, " ".join([*phrase, *prose(rnd, 40), *phrase, *prose(rnd, 60), *phrase]), "en", "s0"),
    ]
    out = judged(spark, good + bad)
    assert all(out[i].kept for i, *_ in good)
    assert not any(out[i].base_failed or out[i].kept for i, *_ in bad)
    assert out[9003].n_repeat_words == 27


def test_groups_of_few_texts_and_nulls(spark):
    """A single text, one of a pair, and groups without lang or source are judged by themselves and kept; a value at a fence is inside."""
    rnd = random.Random(4)
    rows = [(1, symbols(prose(rnd, 50), 50), "xx", "a"), (2, symbols(prose(rnd, 50), 0), "yy", "b"), (3, symbols(prose(rnd, 50), 40), "yy", "b"), (4, " ".join(prose(rnd, 50)), None, None), (5, None, None, "a"), (6, "", "xx", None)]
    rows += [(7, symbols(prose(rnd, 50), 30), "zz", "c")] * 3
    out = judged(spark, rows)
    assert [out[i].kept for i in (1, 2, 3, 4, 7)] == [True] * 5 and not out[5].kept and not out[6].kept


def test_no_verdict_depends_on_the_number_of_rows(spark):
    """Every row twice, or eight times: the same verdicts; only shares of texts count."""
    rnd = random.Random(6)
    rows = [(i, symbols(prose(rnd, 60), rnd.choice([0, 0, 0, 0, 2, 5, 30]) if i % 9 else 95), rnd.choice(["en", "de"]), f"s{i % 4}") for i in range(150)]
    once = {i: r.kept for i, r in judged(spark, rows).items()}
    assert 5 < sum(not k for k in once.values()) < 60
    for times in (2, 8):
        more = [(i + 1000 * k, *r) for i, *r in rows for k in range(times)]
        assert {i: r.kept for i, r in judged(spark, more).items()} == {i + 1000 * k: v for i, v in once.items() for k in range(times)}
