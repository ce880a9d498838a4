"""Sources, stores, streams and learners that SQL can't express, held against brute force or an exact round trip."""

import http.server
import json
import logging
import math
import random
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import cluster, learners, ordering, regions
from lumenframe.sources import http as H
from lumenframe.sources import models, stores
from lumenframe.streaming import service


@pytest.fixture(scope="module")
def server():
    """Answers /page/N, ranges of /file, polls that give three items twice, and keeps what is posted."""
    posted, polls, data = [], [], bytes(random.Random(1).randbytes(10_007))

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, status, body):
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path.startswith("/page/"):
                self.answer(200, f"page {self.path[6:]}".encode()) if self.path != "/page/3" else self.answer(404, b"")
            elif self.path == "/file":
                a, z = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                self.answer(206, data[a : z + 1])
            elif self.path == "/whole":
                self.answer(200, data)
            else:
                polls.append(self.path)
                k = len(polls)
                body = {"succ": "true", "data": [{"id": k * 10 + i, "url": f"u{k}{i}"} for i in range(3)]} if k in (1, 3) else {"succ": "false"}
                self.answer(500 if k == 2 else 200, json.dumps(body).encode())

        def do_POST(self):
            posted.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.answer(200, b"")

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", posted, polls, data
    s.shutdown()


def test_fetching(spark, server):
    at = server[0]
    df = spark.createDataFrame([(i, f"{at}/page/{i}" if i < 5 else None if i == 5 else "http://127.0.0.1:1/x") for i in range(7)], "id long, url string")
    got = {r.id: (r.status, bytes(r.body), r.error is None) for r in H.fetched(df, timeout=5).collect()}
    assert got == {i: (200, f"page {i}".encode(), True) for i in (0, 1, 2, 4)} | {3: (404, b"", False), 5: (0, b"", False), 6: (0, b"", False)}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fetching_in_ranges(spark, server, parts):
    at, _, _, data = server
    df = spark.createDataFrame([(1, f"{at}/file", len(data)), (2, f"{at}/whole", len(data))], "id long, url string, size long")
    got = {r.id: r.body for r in H.fetched_in_ranges(df, parts).collect()}
    assert bytes(got[1]) == data and got[2] is None


def test_polling_and_posting(spark, server, tmp_path):
    at, posted, polls, _ = server
    spark.dataSource.register(H.PollSource)
    s = spark.readStream.format("lumenframe_poll").option("url", f"{at}/poll").option("limit", "100").option("wait", "0.1").load()
    q = s.writeStream.foreachBatch(H.post_rows(f"{at}/post", ["id", "url"])).option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    for _ in range(100):
        if sum(len(p.split("\\n")) for p in posted) >= 6:
            break
        q.awaitTermination(0.3)
    q.stop()
    assert sorted(x for p in posted for x in p.split("\\n")) == sorted(f"{k * 10 + i},u{k}{i}" for k in (1, 3) for i in range(3))
    assert all(p.endswith("limit=100") for p in polls)


def test_key_value_store(spark, tmp_path):
    s = stores.KeyValueStore(spark, f"file://{tmp_path}/kv")
    rnd, want = random.Random(2), {}
    for _ in range(4):
        batch = {f"k{rnd.randrange(40)}": rnd.choice(["a", "b", None]) for _ in range(25)}
        s.put(spark.createDataFrame(list(batch.items()), "key string, value string"))
        want |= batch
    want = {k: v for k, v in want.items() if v is not None}
    assert {r.key: r.value for r in s.scan().collect()} == want
    assert {r.key: r.value for r in s.scan("k1", "k3").collect()} == {k: v for k, v in want.items() if "k1" <= k <= "k3"}
    assert [r.value for r in s.get("k7").collect()] == ([want["k7"]] if "k7" in want else [])


def test_model_files(spark):
    header = {"svm_type": ["c_svc"], "nr_class": ["3"], "rho": ["0.5", "-1"]}
    vectors = [([0.25, -1.0], {1: 0.5, 7: -2.0}), ([3.0, 0.0], {2: 1.5})]
    text = models.svm_text(header, vectors)
    assert models.svm_header(text) == header
    got = models.svm_vectors(spark.createDataFrame([("m", text)], "model string, value string")).orderBy("ord").collect()
    assert [(r.coef, r.features) for r in got] == vectors
    rows = models.linear_weights(spark.createDataFrame([("m", "solver_type L2R_LR\nnr_feature 2\nw\n0.5 1 \n-2 3e-1 \n")], "model string, value string")).orderBy("ord").collect()
    assert [r.weights for r in rows] == [[0.5, 1.0], [-2.0, 0.3]]


def test_image_records():
    rnd = random.Random(3)
    for _ in range(200):
        want = {"channels": rnd.randrange(1 << 10), "height": rnd.randrange(1 << 20), "width": 0, "data": rnd.randbytes(rnd.randrange(300)), "label": rnd.randrange(-5, 1 << 31)}
        raw = models.record_bytes(*want.values())
        assert models.record_fields(raw) == want
        # Unknown fields of all kinds are skipped.
        assert models.record_fields(b"\x30\x05" + b"\x3d" + b"1234" + b"\x41" + b"12345678" + b"\x4a\x02ab" + raw) == want


def test_rolling_log(tmp_path):
    log = models.rolling_log("lumenframe.test", f"{tmp_path}/a.csv", 2000, 2)
    for i in range(100):
        log.info('line %d; "quoted"', i)
    for h in log.handlers:
        h.close()
    logging.getLogger("lumenframe.test").handlers.clear()
    files = sorted(p.name for p in tmp_path.iterdir())
    assert files == ["a.csv", "a.csv.1", "a.csv.2"]
    assert '"line 99; ""quoted"""' in (tmp_path / "a.csv").read_text()


def py_near(a, b):
    d = [abs(x - y) for x, y in zip(a, b, strict=True)]
    return max(d) <= 2 and sum(d) <= 8


def test_stream_of_signatures(spark, tmp_path):
    """Across batches, a row is new unless a new row of its bucket came before it."""
    rnd = random.Random(4)
    base = [[rnd.randrange(1, 60) for _ in range(6)] for _ in range(8)]
    rows = [(i % 3, i, [x + rnd.randrange(-1, 2) for x in rnd.choice(base)]) for i in range(150)]
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], "code long, id long, feat array<int>").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = service.poll_stream(spark, f"file://{tmp_path}/in", "code long, id long, feat array<int>", 1)
    got = {r.id: (r.is_new, r.duplicate_of) for r in service.run_to_end(service.new_in_stream(s), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()}
    assert len(got) == 150 and Counter(v[0] for v in got.values())[True] >= 8
    feats = {i: (c, f) for c, i, f in rows}
    for i, (new, of) in got.items():
        if not new:
            assert got[of][0] and feats[of][0] == feats[i][0] and py_near(feats[i][1], feats[of][1])
    kept = [i for i, v in got.items() if v[0]]
    assert not any(feats[a][0] == feats[b][0] and py_near(feats[a][1], feats[b][1]) for a in kept for b in kept if a < b)


def test_signature_store(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i % 2, 0, i, [rnd.randrange(1, 6) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "class_id int, code long, id long, feat array<int>")
    path = f"file://{tmp_path}/store"
    stores.append_signatures(df.where("id < 20"), path)
    got = {r.id for r in stores.new_signatures(df.where("id >= 20"), stores.read_by(spark, path)).collect()}
    kept = [(c, i, f) for c, _, i, f in rows if i < 20]
    for c, _, i, f in rows[20:]:
        if not any(c == c2 and py_near(f, g) for c2, _, g in kept):
            kept.append((c, i, f))
    assert got == {i for _, i, _ in kept if i >= 20}
    # A chain: the second resembles the first, the third only the second, which is not inserted.
    chain = spark.createDataFrame([(1, 0, i, [2 * i] * 4) for i in range(1, 6)], "class_id int, code long, id long, feat array<int>")
    assert {r.id for r in stores.new_signatures(chain, None).collect()} == {1, 3, 5}


def test_quota_scan(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice("abcd") for _ in range(rnd.randrange(1, 4))]) for i in range(120)]
    rows = [(i, x, [rnd.choice([0.5, 0.8, 0.9]) for _ in x]) for i, x in rows]
    df = spark.createDataFrame(rows, "id long, labels array<string>, scores array<double>")
    for most, n_labels in ((5, None), (5, 3), (12, 4), (1, 1), (500, 2)):
        seen, want = Counter(), []
        for i, own, sc in rows:
            if n_labels and sum(v >= most for v in seen.values()) >= n_labels:
                break
            if any(seen[x] < most for x in own):
                want.append(i)
                seen.update(x for x, s in zip(own, sc, strict=True) if s >= 0.8)
        assert sorted(r.id for r in ordering.quota_sample(df, ["id"], "labels", "scores", most, 0.8, n_labels).collect()) == want


def test_single_label_cap(spark):
    rnd = random.Random(7)
    rows = [(i, x) for i in range(90) for x in [rnd.choice("abc")] * rnd.randrange(1, 4) + ([rnd.choice("abc")] if rnd.random() < 0.3 else [])]
    df = spark.createDataFrame(rows, "image long, label string")
    for most, n_labels in ((10, None), (10, 3), (0, 2)):
        by, count, want = {}, Counter(), []
        for i, x in rows:
            by.setdefault(i, []).append(x)
        for i in sorted(by):
            if n_labels and sum(v > most for v in count.values()) >= n_labels:
                break
            if len(set(by[i])) == 1 and count[by[i][0]] > most:
                continue
            want.append(i)
            count.update(by[i])
        assert sorted(r.image for r in ordering.capped_single(df, "image", "label", most, n_labels).collect()) == want


@pytest.mark.parametrize("diagonal", [True, False])
def test_blobs(spark, diagonal):
    rnd = random.Random(8)
    cells = {(x, y) for x in range(12) for y in range(12) if rnd.random() < 0.45}
    near = lambda p: {(p[0] + dx, p[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))} & cells
    want, left = [], set(cells)
    while left:
        todo, own = [left.pop()], set()
        while todo:
            p = todo.pop()
            own.add(p)
            todo += near(p) & left
            left -= near(p)
        if len(own) > 1:
            want.append(frozenset(own))
    df = spark.createDataFrame([(1, x, y) for x, y in cells], "img int, x int, y int")
    blobs = regions.labelled_blobs(df, "img", diagonal)
    got = {}
    for r in blobs.collect():
        got.setdefault(r.blob, set()).add((r.x, r.y))
    assert {frozenset(v) for v in got.values()} == set(want)
    for r in regions.solidity(blobs, ["img", "blob"]).collect():
        p = sorted(got[r.blob])
        # The hull's area by its support in many directions: no point lies outside the half planes of its edges.
        edges = [(a, b) for a in p for b in p if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in p)]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in edges if not any(c not in (a, b) and (b[0] - a[0]) * (c[1] - a[1]) == (b[1] - a[1]) * (c[0] - a[0]) and not (min(a, b) < c < max(a, b)) for c in p)) / 2
        assert r.area == len(p) and (r.solidity is None if area == 0 else r.solidity == pytest.approx(len(p) / area))


def test_principal_components(spark):
    x = np.random.default_rng(9).standard_normal((200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 2
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    mean, vectors = cluster.learned_components(df, "x", 2)
    assert mean == pytest.approx(x.mean(0))
    w = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2].T
    assert np.abs(np.abs(w @ np.array(vectors).T) - np.eye(2)).max() < 1e-6
    back = cluster.pca_decoded(cluster.pca_encoded(df, "x", mean, vectors), mean, vectors).select("decoded").collect()
    assert np.allclose([r[0] for r in back], (x - x.mean(0)) @ w.T @ w + x.mean(0))


def test_meaningful_clusters():
    """Two tight groups in a wide field are each a cluster; the strangers are in none."""
    rnd = np.random.default_rng(10)
    p = np.concatenate([0.2 + 0.01 * rnd.random((12, 2)), 0.8 + 0.01 * rnd.random((10, 2)), rnd.random((4, 2))])
    steps = cluster.merge_steps(p, "single")
    found = [set(c) for c in cluster.meaningful(p, steps)]
    assert any(set(range(12)) <= c and len(c) < 17 for c in found) and any(set(range(12, 22)) <= c and len(c) < 15 for c in found)
    assert sum(map(len, found)) == len(set().union(*found))


def test_boosted_stumps(spark):
    rnd = random.Random(11)
    rows = [(x := rnd.random(), y := rnd.random(), 1 if (x > 0.5) != (y > 0.5) and x > 0.2 else -1) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, s int").cache()
    stumps = learners.boosted_stumps(df, ["x", "y"], "s", 6)
    q = {c: df.agg(F.percentile_approx(c, [i / 17 for i in range(1, 17)], 10_000)).first()[0] for c in ("x", "y")}
    f = np.zeros(len(rows))
    data = {"x": np.array([r[0] for r in rows]), "y": np.array([r[1] for r in rows])}
    s = np.array([r[2] for r in rows])
    for c, cut, a, b in stumps:
        w = np.exp(-s * f)
        gains = {(k, v): sum((w * s)[m].sum() ** 2 / w[m].sum() for m in (data[k] <= v, data[k] > v) if m.any()) for k in q for v in q[k]}
        assert gains[c, cut] == pytest.approx(max(gains.values()))
        low = data[c] <= cut
        assert (a, b) == pytest.approx(((w * s)[low].sum() / w[low].sum(), (w * s)[~low].sum() / w[~low].sum()))
        f += np.where(low, a, b)


@pytest.mark.parametrize("rule", sorted(learners.RULES))
def test_solvers_lower_the_loss(spark, rule):
    rnd = random.Random(12)
    rows = [(x := rnd.gauss(0, 1), y := rnd.gauss(0, 1), 1.0 if 2 * x - y + 0.3 * rnd.gauss(0, 1) > 0 else 0.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, t double").coalesce(1).cache()
    loss = lambda w: sum(math.log1p(math.exp(-(2 * t - 1) * (w[0] * x + w[1] * y + w[2]))) for x, y, t in rows) / len(rows)
    start, end = loss([0, 0, 0]), loss(learners.solved(df, ["x", "y"], "t", rule, 8))
    assert end < start * (0.999 if rule == "adadelta" else 0.9)


def test_normalised_cuts(spark):
    """Two groups of close nodes with one weak tie come apart."""
    rnd = random.Random(13)
    rows = [(1, i, j, 1.0 if (i < 5) == (j < 5) else 0.02 * rnd.random()) for i in range(10) for j in range(i)]
    got = {r.node: r.part for r in learners.normalised_cuts(spark.createDataFrame(rows, "img long, i long, j long, w double"), "img", 0.3).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def test_image_source(spark, tmp_path):
    """Bitmaps of 40 x 36 and 8 x 40 pixels, and a file that is none, through Spark's image source."""
    import struct

    from lumenframe.operators import filters

    for name, w, h in (("a", 40, 36), ("b", 8, 40)):
        row = (w * 3 + 3) // 4 * 4
        body = bytes(row * h)
        (tmp_path / f"{name}.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    (tmp_path / "c.bmp").write_bytes(b"no image")
    i = filters.decoded_images(spark.read.format("image").option("dropInvalid", False).load(f"file://{tmp_path}"))
    assert sorted((r.width, r.height, r.channels, r.depth) for r in i.collect()) == [(8, 40, 3, 8), (40, 36, 3, 8)]
    assert [r.width for r in filters.valid_images(i, 32).collect()] == [40]


def test_lines_of_split_files(spark, tmp_path):
    want = {}
    for name in ("a", "b"):
        lines = [f"{name} line {i}" * (i % 5) for i in range(3000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want |= {(name, i): v for i, v in enumerate(lines) if v}
    from lumenframe.sources import lists

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {(r.file[-5], r.ord): r.value for r in lists.read_lines(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


@pytest.mark.parametrize("method", cluster.LINKS)
def test_merges_against_all_pairs(method):
    """The merge of least distance at each step, by the recurrence over a full matrix."""
    p = np.random.default_rng(14).random((30, 2))
    p[7] = p[3]
    squared = method in ("ward", "centroid", "median")
    d = {(i, j): float(((p[i] - p[j]) ** 2).sum()) ** (1.0 if squared else 0.5) for i in range(30) for j in range(i)}
    size, want = dict.fromkeys(range(30), 1), []
    far = lambda x, y: d[max(x, y), min(x, y)]
    for step in range(29):
        h, i, j = min((v, b, a) for (a, b), v in d.items())
        a, b, new = size.pop(i), size.pop(j), 30 + step
        want.append((h**0.5 if squared else h, a + b))
        fresh = {}
        for k, s in size.items():
            x, y = far(i, k), far(j, k)
            fresh[new, k] = {"single": min(x, y), "complete": max(x, y), "average": (a * x + b * y) / (a + b), "weighted": (x + y) / 2, "ward": ((a + s) * x + (b + s) * y - s * h) / (a + b + s), "centroid": (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2, "median": (x + y) / 2 - h / 4}[method]
        d = {k: v for k, v in d.items() if not {i, j} & set(k)} | fresh
        size[new] = a + b
    got = cluster.merge_steps(p, method)
    assert [(s[2], s[3]) for s in got] == [(pytest.approx(h), n) for h, n in want]


def test_coupled_probabilities(spark):
    """Pairwise probabilities that come from class probabilities give these back."""
    p = np.array([0.1, 0.2, 0.3, 0.4])
    r = [float(p[i] / (p[i] + p[j])) for i in range(4) for j in range(i + 1, 4)]
    got = learners.coupled_probabilities(spark.createDataFrame([(1, r)], "id long, r array<double>"), "id", 4).first().p
    assert got == pytest.approx(p.tolist(), abs=0.01)


def test_polls_are_kept_until_committed(monkeypatch, tmp_path):
    """A reader that starts anew gives the items of polls that were not committed, or fails where it has not kept them."""
    answer = json.dumps({"succ": "true", "data": [{"id": 7, "url": "u"}, {"id": 8, "url": "w"}]}).encode()
    monkeypatch.setattr(H, "get", lambda url, timeout: (200, answer, {}))
    at = {"url": "http://x/poll", "wait": "0", "keep": str(tmp_path / "polls")}
    one, start = H._Poll(at), {"polls": 0}
    rows, end = one.read(start)
    assert list(H._Poll(at).readBetweenOffsets(start, end)) == list(rows) == [("7", "u"), ("8", "w")]
    one.commit(end)
    for again in (H._Poll(at), H._Poll(at | {"keep": ""})):
        with pytest.raises(RuntimeError, match="keep"):
            list(again.readBetweenOffsets(start, end))


def test_boxes_in_another_form_are_an_error(spark):
    from lumenframe.sources import lists

    files = spark.createDataFrame([("a", "- {bndbox: [1, 2, 3, 4], name: c}\n- bndbox:\n    xmin: 1")], "name string, value string")
    names, classes = spark.createDataFrame([("train", 0, "a")], "part string, ord int, name string"), spark.createDataFrame([(0, "c")], "ord int, label string")
    with pytest.raises(Exception, match="unread box"):
        lists.box_files(names, files, classes).collect()
