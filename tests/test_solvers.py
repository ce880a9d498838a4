import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import queries, queries_regions  # noqa: F401  it adds its queries
from lumenframe.operators import learners, solvers


def rows_of(seed, n=300, d=5, noise=0.5):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d))
    y = np.where(x @ np.arange(1, d + 1) / d + noise * rnd.normal(size=n) > 0.2, 1.0, -1.0)
    return x, y


def table(spark, x, y):
    rows = [(a.tolist(), float(b), 7) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 7), ([1.0] * x.shape[1], None, 7)]
    return spark.createDataFrame(rows, "e array<double>, s double, f int").repartition(4)


def plain_newton(x, y, kind, cost):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    value = lambda w: 0.5 * w @ w + cost * solvers.losses(kind, x @ w, y)[0].sum()
    for _ in range(60):
        _, s, c = solvers.losses(kind, x @ w, y)
        step = np.linalg.solve(np.eye(len(w)) + cost * (x.T * c) @ x, w + cost * x.T @ s)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w, value(w)


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge", "squared_margin"])
def test_trust_region_reaches_the_optimum(spark, kind):
    x, y = rows_of(1)
    if kind == "squared_margin":
        y = x[:, 0] - 2 * x[:, 1] + 0.3 * np.random.default_rng(2).normal(size=len(x))
    w, f = solvers.trust_region(table(spark, x, y), "e", "s", kind, 0.7, tolerance=1e-6)
    want, best = plain_newton(x, y, kind, 0.7)
    assert f == pytest.approx(best, rel=1e-6) and w == pytest.approx(want, abs=1e-3)


def test_losses_have_the_stated_derivatives():
    z, y = np.linspace(-3, 3, 25), np.where(np.arange(25) % 2, 1.0, -1.0)
    for kind in ("logistic", "squared_hinge", "squared_margin"):
        up, down = (solvers.losses(kind, z + s, y)[0] for s in (1e-5, -1e-5))
        assert solvers.losses(kind, z, y)[1] == pytest.approx((up - down) / 2e-5, abs=1e-4)


@pytest.mark.parametrize("squared", [False, True])
def test_dual_descent_closes_the_gap(spark, squared):
    """In blocks that share the work the dual reaches the primal; the squared hinge has the optimum of the trust region."""
    x, y = rows_of(3)
    w, primal, dual = solvers.dual_descent(table(spark, x, y), "e", "s", squared, 0.2, block=100)
    assert dual <= primal <= dual + 2e-3 * max(1, primal)
    if squared:
        assert primal == pytest.approx(plain_newton(x, y, "squared_hinge", 0.2)[1], rel=2e-3)
    else:
        one = solvers.dual_descent(table(spark, x, y), "e", "s", squared, 0.2, block=10_000, gap=1e-6)
        assert one[1] == pytest.approx(one[2], rel=1e-5) and one[1] <= primal + 1e-6 and primal == pytest.approx(one[1], rel=2e-3)


def plain_dual(x, y, cost, **how):
    k = solvers.kernel_matrix(x, x, **how)
    a, rho = solvers.working_set(k, y, cost, 1e-5)
    return a.sum() - 0.5 * (a * y) @ k @ (a * y), k @ (a * y) - rho


def test_working_set_meets_the_conditions():
    x, y = rows_of(5, 120, 3)
    k = solvers.kernel_matrix(x, x, "rbf", 0.5, 0, 3)
    a, rho = solvers.working_set(k, y, 2.0, 1e-6)
    m = y * (k @ (a * y) - rho)
    assert abs(a @ y) < 1e-9 and (a >= 0).all() and (a <= 2).all()
    assert (m[a < 1e-9] > 1 - 1e-4).all() and (m[a > 2 - 1e-9] < 1 + 1e-4).all() and m[(a > 1e-6) & (a < 2 - 1e-6)] == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_groups_of_rows_give_the_machine_of_all(spark, kind):
    x, y = rows_of(6, 400, 3, 0.3)
    how = dict(kind=kind, gamma=0.5, coef0=1.0, degree=2)
    vectors, rho = solvers.kernel_machine(table(spark, x, y), "e", "s", 1.0, group=90, tolerance=1e-4, **how)
    best, want = plain_dual(x, y, 1.0, **how)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id int, e array<double>")
    got = {r.id: r.value for r in learners.decision_values(df, "id", "e", vectors, rho, **how).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, abs=2e-2)
    c = vectors.collect()
    v, coef = np.array([r.vector for r in c]), np.array([r.coef for r in c])
    assert np.abs(coef).sum() - 0.5 * coef @ solvers.kernel_matrix(v, v, **how) @ coef == pytest.approx(best, rel=1e-3)


def test_too_many_support_vectors_are_refused(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([([rnd.random(), rnd.random()], rnd.choice([-1.0, 1.0])) for _ in range(120)], "e array<double>, s double")
    with pytest.raises(ValueError, match="support vectors"):
        solvers.kernel_machine(df, "e", "s", group=30, most=20)
    with pytest.raises(ValueError, match="support vectors"):
        learners.decision_values(df, "s", "e", df.select(F.col("s").alias("coef"), F.col("e").alias("vector")), 0.0, most=5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "e array<double>, s double")
    assert solvers.trust_region(none, "e", "s")[1] == 0 and solvers.dual_descent(none, "e", "s")[1] == 0
    vectors, rho = solvers.kernel_machine(none, "e", "s")
    assert vectors.count() == 0 and rho == 0


def test_many_support_vectors_are_solved_in_groups(spark, monkeypatch):
    """Random labels: nearly all rows are support vectors, many times a group; values are those of one machine over all rows."""
    monkeypatch.setattr(solvers, "ROW_BLOCK", 70, raising=False)
    monkeypatch.setattr(solvers, "VECTOR_BLOCK", 90, raising=False)
    monkeypatch.setattr(solvers, "HELD", 2, raising=False)
    rnd = np.random.default_rng(8)
    x, y = rnd.normal(size=(500, 4)), rnd.choice([-1.0, 1.0], 500)
    how = dict(kind="rbf", gamma=0.5, coef0=0.0, degree=3)
    vectors, rho = solvers.kernel_machine(table(spark, x, y), "e", "s", 1.0, group=80, **how)
    best, want = plain_dual(x, y, 1.0, **how)
    df = spark.createDataFrame([*((i, a.tolist()) for i, a in enumerate(x)), (500, None)], "id int, e array<double>")
    got = {r.id: r.value for r in solvers.kernel_values(df, "id", "e", vectors, rho, **how).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(want, abs=3e-2) and len(got) == 501 and got[500] is None
    c = vectors.collect()
    v, coef = np.array([r.vector for r in c]), np.array([r.coef for r in c])
    assert len(c) > 400 and np.abs(coef).sum() - 0.5 * coef @ solvers.kernel_matrix(v, v, **how) @ coef == pytest.approx(best, rel=1e-4)


def test_one_label_and_copies(spark):
    one = spark.createDataFrame([([1.0, 2.0], 1.0), ([2.0, 1.0], 1.0), ([2.0, 1.0], 1.0)], "e array<double>, s double")
    vectors, rho = solvers.kernel_machine(one, "e", "s")
    assert vectors.count() == 0 and [r.value for r in solvers.kernel_values(one.withColumn("id", F.lit(7)), "id", "e", vectors, rho, kind="rbf").collect()] == [1.0, 1.0, 1.0]


def test_groups_agree_within_few_rounds(spark):
    """Many small groups that all move the same way: their changes add up within some rounds, where they overshot and went on for long."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 0] + rnd.normal(size=1200) > 0, 1.0, -1.0)
    how = dict(kind="rbf", gamma=0.5, coef0=0.0, degree=3)
    vectors, _ = solvers.kernel_machine(table(spark, x, y), "e", "s", 1.0, group=60, rounds=16, **how)
    best, _ = plain_dual(x, y, 1.0, **how)
    c = vectors.collect()
    v, coef = np.array([r.vector for r in c]), np.array([r.coef for r in c])
    assert np.abs(coef).sum() - 0.5 * coef @ solvers.kernel_matrix(v, v, **how) @ coef == pytest.approx(best, rel=1e-4)


def test_the_dual_is_solved_to_the_end(spark, monkeypatch):
    """The query's machine closes the gap, whatever rounds that takes; rounds that are too few are an error."""
    got, keep = [], solvers.dual_descent

    def told(*a, **how):
        got.append(keep(*a, **how))
        raise InterruptedError

    monkeypatch.setattr(solvers, "dual_descent", told)
    with pytest.raises(InterruptedError):
        queries.QUERIES["solver_objectives"](spark, "/root/testdata/sf0.1")
    [(_, primal, dual)] = got
    assert dual <= primal <= dual + 2e-3 * primal
    x, y = rows_of(12)
    for squared in (False, True):
        with pytest.raises(RuntimeError, match="apart"):
            keep(table(spark, x, y), "e", "s", squared, 5.0, rounds=1, gap=1e-6)
