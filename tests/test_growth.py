"""What a task gets doesn't grow with the table, and verdicts don't depend on the order in which rows arrive."""

import random

import pytest

from lumenframe import queries, session
from lumenframe.operators import cluster, filters
from lumenframe.sources import stores


def test_steady_groups_at_the_limit(spark):
    """Deviations that are half the mean but for rounding, added in the order of the rows."""
    groups = {1: ([212, 80, 108, 44, 116], False), 2: ([196, 24, 204, 212, 116, 24, 172, 128, 100, 216], True), 3: ([140, 28, 48, 136, 128, 64, 164, 60], True), 4: ([7], True), 5: ([24, 72], True), 6: ([24, 76], False)}
    rows = [(k, i, x) for k, (v, _) in groups.items() for i, x in enumerate(v)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k long, i long, x int").repartition(3)
        assert {r.k: r.n for r in filters.steady_groups(df, "k", "x", "i").collect()} == {k: len(v) for k, (v, ok) in groups.items() if ok}


def test_steady_groups_of_whole_numbers_are_exact(spark, tmp_path):
    """Widths with a deviation of exactly half the mean are in, whatever the order; the next ones beyond are out."""
    groups = {1: ([212, 80, 108, 44, 116], True), 2: ([196, 24, 204, 212, 116, 24, 172, 128, 100, 216], True), 3: ([140, 28, 48, 136, 128, 64, 164, 60], True), 4: ([24], True), 5: ([24, 72], True), 6: ([24, 76], False), 7: ([212, 80, 108, 40, 116], False)}
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    for seed in range(4):
        rows = [(k, x) for k, (v, _) in groups.items() for x in v]
        random.Random(seed).shuffle(rows)
        data = [(i, k, 1, 1, (x - 20) / 4, 1.0, 0.0, 0.0, "A", "F", None) for i, (k, x) in enumerate(rows)]
        spark.createDataFrame(data, names).write.parquet(f"{tmp_path}/{seed}/lineitem.parquet")
        got = {r.image_id: r.n for r in queries.QUERIES["steady_groups"](spark, f"{tmp_path}/{seed}").collect()}
        assert got == {k: len(v) for k, (v, ok) in groups.items() if ok}
    odd = spark.createDataFrame([(1, None), (1, None), (2, -4.0), (2, -4.0), (3, 0.0), (4, 2.0), (4, None)], "k long, x double")
    assert {(r.k, r.mean, r.sd, r.n) for r in filters.steady_groups(odd, "k", "x").collect()} == {(3, 0.0, 0.0, 1), (4, 2.0, 0.0, 2)}


def test_components_of_long_chains(spark, monkeypatch):
    """A chain in random order and a star: the tables of all rounds together hold little more than the edges."""
    rnd, seen = random.Random(2), []
    names = rnd.sample(range(10_000), 600)
    edges = [*zip(names[:400], names[1:400], strict=False), *((names[400], n) for n in names[401:])]
    keep = cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, name: (seen.append((out := keep(df, name)).count()), out)[1])
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame([*edges, (7_000_000, 7_000_000)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(names[:400], min(names[:400])), **dict.fromkeys(names[400:], min(names[400:])), 7_000_000: 7_000_000}
    assert sum(seen) < 5 * len(edges)


def test_rows_of_one_folder_are_shared_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FOLDER_ROWS", 100, raising=False)
    rows, name = [(i % 2, i) for i in range(1000)], "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        stores.write_by(spark.createDataFrame(rows, "k int, v long"), f"file://{tmp_path}/f", "k")
    finally:
        spark.conf.unset(name)
    back = stores.read_by(spark, f"file://{tmp_path}/f")
    assert sorted((r.k, r.v) for r in back.collect()) == sorted(rows)
    assert all(len([*(tmp_path / "f" / f"k={k}").glob("*.parquet")]) > 1 for k in (0, 1))


@pytest.mark.parametrize("most", [10, 50])
def test_partitions_follow_the_rows(spark, monkeypatch, most):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(session, "PART_ROWS", most)
    try:
        session.spread(spark.range(1000))
        assert spark.conf.get(name) == str(1000 // most)
        session.spread(spark.range(10))
        assert spark.conf.get(name) == str(1000 // most)
    finally:
        spark.conf.set(name, before)


def test_records_move_in_small_batches(spark):
    """Wide rows reach Python a few at a time, whatever the session allows."""
    from pyspark.sql import functions as F

    from lumenframe.sources import models

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(256 << 20))
    try:
        p = spark.range(20).select("id", *(F.lit(1).alias(c) for c in ("channels", "height", "width", "label")), F.encode(F.repeat(F.lit("x"), 100_000), "UTF-8").alias("data"))
        assert models.records_read(models.records_written(p, "id"), "id").where("length(data) = 100000").count() == 20
        assert int(spark.conf.get(name)) <= 2 << 20
    finally:
        spark.conf.set(name, before)


def test_distances_are_worked_out_before_the_sides_multiply_the_rows(spark):
    from lumenframe.operators import augment

    b = spark.createDataFrame([(1, 1, 100, 100, 180, 160)], "image_id long, ord long, x1 int, y1 int, x2 int, y2 int")
    j = augment.jittered(b, 640, 480)
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FLOOR") > plan.index("Generate") and plan.count("Generate") == 2
    assert j.count() == 48 and j.where("k = 12 AND side = 3").first()[4:] == (100, 100, 180, 178)


@pytest.mark.parametrize("now, then", [("64m", "16777216b"), ("67108864b", "16777216b"), ("1GB", "16777216b"), ("8mb", "8mb"), ("1000", "1000")])
def test_joined_partitions_stay_small(spark, monkeypatch, now, then):
    """Adaptive execution doesn't join the partitions of a large table beyond a size, and a smaller size of the session stays."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    monkeypatch.setattr(session, "PART_ROWS", 500)
    try:
        spark.conf.set(names[0], now)
        session.spread(spark.range(10))
        assert spark.conf.get(names[0]) == now
        session.spread(spark.range(1000))
        assert spark.conf.get(names[0]) == then
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_boxes_of_files_are_not_dealt_by_label(spark):
    from lumenframe.sources import lists

    names = spark.createDataFrame([("train", 0, "a")], "part string, ord int, name string")
    files = spark.createDataFrame([("a", "annotation:\n  - {bndbox: [1, 2, 3, 4], name: c1}")], "name string, value string")
    got = lists.box_files(names, files, spark.createDataFrame([(0, "c2"), (1, "c1")], "ord int, label string"))
    assert "hashpartitioning(label" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("train", "a", 0, 1, 1, 2, 3, 4)]
