import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import boxes as B
from lumenframe.functions import text as T
from lumenframe.operators import cluster, filters, matching, ordering, ranking, signatures
from lumenframe.operators.nms import nms, spatial_peaks
from lumenframe.sources import documents, lists

BOX = "image_id long, label_id int, ord long, score double, x1 int, y1 int, x2 int, y2 int"


def py_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    if w <= 0 or h <= 0:
        return 0.0
    s = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (s(a) + s(b) - w * h)


def test_nms_chain_and_ties(spark):
    rows = [(1, 0, 1, 0.9, 0, 0, 10, 10), (1, 0, 2, 0.8, 5, 0, 15, 10), (1, 0, 3, 0.7, 11, 0, 21, 10), (2, 0, 2, 0.5, 0, 0, 9, 9), (2, 0, 1, 0.5, 0, 0, 9, 9)]
    got = {(r.image_id, r.ord) for r in nms(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(1, 1), (1, 3), (2, 1)}


def test_nms_against_python(spark):
    rnd = random.Random(3)
    rows = [(i % 3, i % 2, i, rnd.randrange(8) / 8, x := rnd.randrange(60), y := rnd.randrange(60), x + rnd.randrange(5, 40), y + rnd.randrange(5, 40)) for i in range(200)]
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (-r[3], r[2])):
            if all(py_iou(k[4:], r[4:]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert {r.ord for r in nms(spark.createDataFrame(rows, BOX)).collect()} == want


@pytest.mark.parametrize(("mode", "touch", "flat"), [("augment", True, True), ("eval", True, False), ("nms", True, False), ("exact", False, True)])
def test_iou_modes(spark, mode, touch, flat):
    """Boxes that touch at a pixel overlap where a pixel is added; an empty box has no area where it is not."""
    df = spark.createDataFrame([(0, 0, 10, 10, 10, 10, 20, 20), (0, 0, 10, 10, 5, 5, 5, 5), (0, 0, 9, 9, 0, 0, 9, 9)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    v = [r[0] for r in df.select(B.iou("a_", "b_", mode)).collect()]
    assert (v[0] > 0) == touch
    assert (v[1] == 0) == flat
    assert v[2] > 0.99


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20])
def test_splits(spark, n):
    df = ordering.row_numbers(spark.range(n), ["id"])
    assert sorted(r.n for r in df.collect()) == list(range(1, n + 1))
    tests = ordering.every_tenth(df).where("split = 'test'").count()
    assert tests == n // 10
    sizes = {r.split: r["count"] for r in ordering.prefix_split(df).groupBy("split").count().collect()}
    k = int(n * 0.1 + 0.5)
    assert (sizes.get("val", 0), sizes.get("test", 0), sizes.get("train", 0)) == (k, k, n - 2 * k)


def test_runs(spark):
    values = ["a", "a", None, None, "b", "a", "a", "c"] * 40
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    want = [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
    assert sorted(r.i for r in ordering.first_of_runs(df, ["i"], "v").collect()) == want


def test_quota_drops_only_rows_that_are_full_throughout(spark):
    rows = [(1, ["a"], [0.9]), (2, ["a", "b"], [0.9, 0.9]), (3, ["a"], [0.9]), (4, ["b", "a"], [0.1, 0.9]), (5, ["c"], [0.5])]
    df = spark.createDataFrame(rows, "i long, l array<string>, s array<double>")
    assert sorted(r.i for r in ordering.quota_sample(df, ["i"], "l", "s", 1).collect()) == [1, 2, 5]


def test_group_rejection_and_default_rows(spark):
    rows = [(1, 1, 1, 0.9, 0, 0, 50, 50), (1, 2, 2, 0.9, 0, 0, 50, 50), (2, 9, 1, 0.9, 0, 0, 50, 50), (2, 0, 2, 0.1, 0, 0, 50, 50), (3, 0, 1, 0.5, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, BOX)
    left = filters.reject_groups(df, "image_id", F.col("label_id") == 1, F.col("label_id") == 9)
    assert {r.image_id for r in left.collect()} == {3}
    some = df.where("image_id = 1").select("image_id", F.lit("x").alias("label"), "score", "x1", "y1", "x2", "y2")
    out = {(r.image_id, r.label, r.x2) for r in ranking.with_default(some, df.select("image_id").distinct(), 640, 480).collect()}
    assert out == {(1, "x", 50), (2, "other.other", 639), (3, "other.other", 639)}


def test_support_ignores_the_box_itself(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9, 0, 0, 10, 10), (1, 0, 2, 0.9, 0, 0, 10, 11), (1, 0, 3, 0.9, 100, 100, 120, 120)], BOX)
    assert {r.ord for r in matching.with_support(df, df, 0.3).collect()} == {1, 2}
    assert matching.with_support(df, df, 0.3, 2).count() == 0


def test_signature_limits(spark):
    base = [40] * 36
    rows = [(1, base), (2, [43, *base[1:]]), (3, [41] * 9 + base[9:]), (4, [41] * 8 + base[8:]), (5, base)]
    df = spark.createDataFrame(rows, "id long, feat array<int>")
    got = {r.id: r.duplicate_of for r in signatures.near_duplicates(df).collect()}
    assert got == plain_scan([(0, i, f) for i, f in rows], 2, 8)


def plain_scan(rows, partial, total):
    """id -> first kept row that it resembles, of (bucket, id, feat) in order of id."""
    kept, out = [], {}
    for b, i, f in sorted(rows, key=lambda r: r[1]):
        near = [j for c, j, g in kept if c == b and max(abs(x - y) for x, y in zip(f, g, strict=True)) <= partial and sum(abs(x - y) for x, y in zip(f, g, strict=True)) <= total]
        if near:
            out[i] = near[0]
        else:
            kept.append((b, i, f))
    return out


@pytest.mark.parametrize("fold", [500, 0])
def test_signature_chains_are_scanned_in_order(spark, monkeypatch, fold):
    """A chain 0, 2, 4, ...: every other row is kept; batch and scan agree on random rows too."""
    monkeypatch.setattr(signatures, "FOLD", fold)
    chain = [(i, [2 * i] * 4) for i in range(1, 14)]
    df = spark.createDataFrame(chain, "id long, feat array<int>")
    got = {r.id: r.duplicate_of for r in signatures.near_duplicates(df, 2, 8, 0).collect()}
    assert got == {i: i - 1 for i in range(2, 14, 2)}
    rnd = random.Random(8)
    rows = [(i, [rnd.randrange(-3, 9) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, feat array<int>")
    got = {r.id: r.duplicate_of for r in signatures.near_duplicates(df, 2, 5, 0).collect()}
    assert got == plain_scan([(0, i, f) for i, f in rows], 2, 5)


def test_peaks(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0, 0), (1, 2, 0.8, 3, 3), (1, 3, 0.7, 50, 0)], "image_id long, ord long, score double, x int, y int")
    assert {r.ord for r in spatial_peaks(df, 5, 10).collect()} == {1, 3}
    assert {r.ord for r in spatial_peaks(df, 5, 1).collect()} == {1}


@pytest.mark.parametrize("method", cluster.LINKS)
def test_agglomerative_heights(method):
    pts = np.array([[0.0, 0], [0, 1], [5, 0], [5, 1.5]])
    steps = cluster.merge_steps(pts, method)
    assert steps[0] == (0, 1, 1.0, 2)
    assert steps[1][:2] == (2, 3) and steps[1][2] == pytest.approx(1.5)
    assert steps[-1][3] == 4
    last = {"single": 5.0, "complete": max(np.hypot(5, 1.5), np.hypot(5, 1)), "average": np.mean([5, np.hypot(5, 1.5), np.hypot(5, 1), np.hypot(5, 0.5)])}
    if method in last:
        assert steps[-1][2] == pytest.approx(last[method])


def test_nfa_against_sums():
    from math import comb, log10

    for n, k, p in ((10, 3, 0.2), (50, 40, 0.5), (7, 7, 0.1), (200, 5, 0.9)):
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert cluster.log_nfa(n, k, p) == pytest.approx(log10(tail), abs=1e-6)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in cluster.components(e).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100, 200: 200}


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord int, value string").withColumn("file", F.lit("f"))


def test_list_readers(spark):
    assert [(r.id, r.url) for r in lists.id_url(lines(spark, "1,u", "2,x,v", "3", "1,2,3,4")).collect()] == [("1", "u"), ("2", "v")]
    assert [(r.url, r.score) for r in lists.url_label_score(lines(spark, "u,l,0.5", "9,u,l,1", "u,l,-1", "u,l")).collect()] == [("u", 0.5), ("u", 1.0)]
    assert [tuple(r) for r in lists.id_url_score(lines(spark, "7,u,0.5", "8,0.25,v,m"), "c").collect()] == [(7, "u", "c", 0.5), (8, "v", "m", 0.25)]
    assert [(r.sub, r.path) for r in lists.path_list(lines(spark, " a  b ")).collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r)[-2:] for r in lists.labelled_list(lines(spark, "p 3", "q x", "z")).collect()] == [("p", 3), ("q", 0)]
    got = lists.detection_log(lines(spark, "a b c d e 5 6 u 2 cat 0.5 1 2 3 4 dog 1 5 6 7 8", "a b c d e 7 8 v 0")).collect()
    assert [(r.image_id, r.k, r.label, r.x2) for r in got] == [(5, 0, "cat", 3), (5, 1, "dog", 7)]
    got = lists.counted_boxes(lines(spark, "i 2 0 0 30 30 0 0 5 5", "j 1 0 0 30 30")).collect()
    assert [(r.id, r.k) for r in got] == [("i", 0)]
    face = " ".join(["9", "2", "1", "8", "0.5", *["0"] * 215])
    assert [tuple(r) for r in lists.vendor_faces(lines(spark, f"p 1 {face}")).collect()] == [("p", 0, 1, 2, 8, 9, 0.5)]
    assert [r.id for r in lists.id_range(spark, 5, 2).collect()] == [6, 7]


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b/c_12.jpg", " 3.5x", "Yes")], "p string, n string, y string")
    r = df.select(*(v.alias(k) for k, v in T.path_parts("p").items()), T.id_in_name("p").alias("id"), T.prefix_number(F.col("n")).alias("n"), T.is_yes("y").alias("y"), T.url_of_path("p", "http://h/").alias("u")).first()
    assert tuple(r) == ("c_12.jpg", "c_12", "a/b", "b", "12", 3.5, True, "http://h/b/c_12.jpg")


def test_voc_and_coco(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><object><name>cat</name><bndbox><xmin>0</xmin><ymin>-5</ymin><xmax>9</xmax><ymax>8</ymax></bndbox></object></annotation>")
    r = documents.read_voc(spark, str(tmp_path / "a.xml")).first()
    assert (r.image, r.has_size, r.label, r.x1, r.y1, r.x2, r.y2) == ("a", False, "cat", 1, -4, 9, 8)
    (tmp_path / "c.json").write_text('{"categories":[{"supercategory":"s","id":1,"name":"cat"}],"images":[{"file_name":"f","id":7}],"annotations":[{"image_id":7,"category_id":1,"bbox":[1.5,2.4,3,4]}]}')
    assert tuple(documents.read_coco(spark, str(tmp_path / "c.json")).first()) == ("f", 0, "cat", 2, 2, 5, 6)


def test_poll_and_config(spark):
    df = spark.createDataFrame([('{"succ":"true","data":[{"id":"1","url":"u"}]}',), ('{"succ":"false","data":[{"id":"2","url":"u"}]}',), ("{",)], "value string")
    assert [tuple(r) for r in documents.poll_rows(df).collect()] == [("1", "u")]
    got = documents.read_config("a = 1 # c\nb = %a%/%H%\ng (\n c = %b%x\n)\n", {"H": "h"})
    assert got == {"a": "1", "b": "1/h", "g": {"c": "1/hx"}}
    with pytest.raises(ValueError):
        documents.read_config("g (\n")


def test_coupled_probabilities_and_cut():
    from lumenframe.operators.learners import coupled, two_way_cut

    want = np.array([0.5, 0.3, 0.2])
    r = want[:, None] / (want[:, None] + want[None])
    assert np.allclose(coupled(r), want, atol=0.02)
    w = np.kron(np.eye(2), np.ones((3, 3))) + 0.01
    side = two_way_cut(w)
    assert len(set(side[:3])) == 1 and len(set(side[3:])) == 1 and side[0] != side[3]


def test_segments(spark):
    from lumenframe.operators.learners import segments

    rows = [(1, x, y, 0.0 if x < 3 else 100.0) for x in range(6) for y in range(4)]
    got = {(r.x, r.y): r.segment for r in segments(spark.createDataFrame(rows, "k long, x int, y int, v double"), "k", 10.0, 2).collect()}
    assert len(set(got.values())) == 2 and len({v for (x, _), v in got.items() if x < 3}) == 1


def test_linear_learner(spark):
    from lumenframe.operators.learners import linear_classifier, vectorised

    rows = [([float(i % 7), float(i % 5)], int(i % 7 > 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "f array<double>, y int")
    model = linear_classifier(df, "f", "y")
    out = model.transform(vectorised(df, "f"))
    assert out.where("prediction = y").count() >= 95
