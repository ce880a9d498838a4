"""Near pairs of blocks, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import signatures


@pytest.mark.parametrize("top", [60, 100_000])
def test_near_pairs_of_blocks(spark, monkeypatch, top):
    """A bucket of many blocks, small ones, one of lone rows, and signatures of another length: every near pair comes once."""
    monkeypatch.setattr(signatures, "BLOCK", 7, raising=False)
    rnd = random.Random(top)
    rows = [(c, 1000 - i, [top - rnd.randrange(4) for _ in range(36 if i % 9 else 5)]) for c, n in ((1, 60), (2, 5), (3, 1)) for i in range(n)]
    rows += [(2, 5000 + i, rows[0][2]) for i in range(3)] + [(4, 7000, []), (4, 7001, [])]
    near = lambda a, b: len(a) == len(b) > 0 and max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 3 and sum(abs(x - y) for x, y in zip(a, b, strict=True)) <= 40
    want = sorted((c, i, j) for c, i, f in rows for k, j, g in rows if c == k and j < i and near(f, g))
    df = spark.createDataFrame(rows, "code long, id long, feat array<int>")
    got = sorted(tuple(r) for r in signatures.near_pairs(df, None, ["code"], 3, 40).collect())
    assert got == want and len(want) > 50
    even, odd = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = sorted(tuple(r) for r in signatures.near_pairs(odd, even, ["code"], 3, 40).collect())
    assert got == sorted((c, i, j) for c, i, f in rows for k, j, g in rows if c == k and i % 2 and not j % 2 and near(f, g))
    assert signatures.near_pairs(df.where(F.lit(False)), None, ["code"], 3, 40).count() == 0


def test_pairs_are_compared_component_by_component():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 4, (50, 12)), rnd.integers(0, 4, (700, 12))
    i, j = signatures.within(signatures.matrix(a.ravel(), 50), signatures.matrix(b.ravel(), 700), 3, 11)
    gap = np.abs(a[:, None] - b[None])
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero((gap.max(2) <= 3) & (gap.sum(2) <= 11))), strict=True)} and len(i) > 10
