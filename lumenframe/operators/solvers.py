"""Solvers of linear and kernel machines whose passes over the rows are Spark jobs.

* ``trust_region``: Newton steps within a trust region. Loss, gradient and each product of the Hessian with a vector are sums over
  rows, added up within a task before they meet; the driver holds a few vectors as long as the features.
* ``dual_descent``: for the hinge, the best mix of multipliers that the margins of all rows at earlier weights give; the driver holds their
  sums, each as long as the features. For the squared hinge, coordinate descent on the dual in blocks of rows: each block improves its own
  multipliers against the common weights; of the sum of all changes the best share is taken, by an exact search along it.
* ``kernel_machine``: working-set descent in groups of bounded size, each against the slopes of all rows; of the sum of all changes
  the best share is taken. Slopes move by sums of kernels over blocks of rows that meet block by block.

Rows are (features: array, label: -1 or 1, or a number for regression). Rows with null features or label are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import small_batches, written


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def losses(kind: str, z: np.ndarray, y: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row at the value z, and its first and second derivative: logistic, squared hinge, or squared distance beyond a margin."""
    if kind == "logistic":
        p = _sigmoid(y * z)
        return np.logaddexp(0, -y * z), (p - 1) * y, p * (1 - p)
    if kind == "squared_hinge":
        m = np.maximum(0, 1 - y * z)
        return m * m, -2 * y * m, 2.0 * (m > 0)
    if kind == "squared_margin":
        m = np.maximum(0, np.abs(z - y) - margin)
        return m * m, 2 * np.sign(z - y) * m, 2.0 * (m > 0)
    raise ValueError(f"no loss {kind!r}")


def _matrix(column) -> np.ndarray:
    """A batch's arrays of features as a matrix with a last column of ones."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
    return np.hstack([x, np.ones((n, 1))])


def clean(rows: DataFrame, features: str, label: str) -> DataFrame:
    return rows.select(F.col(features).cast("array<double>").alias("f"), F.col(label).cast("double").alias("y")).where("f IS NOT NULL AND y IS NOT NULL AND NOT exists(f, x -> x IS NULL)")


def row_sums(rows: DataFrame, per_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over batches of a vector of a size, of rows (f, y)."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += per_batch(_matrix(b.column("f")), b.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def trust_region(rows: DataFrame, features: str, label: str, kind: str = "logistic", cost: float = 1.0, tolerance: float = 1e-3, most: int = 50) -> tuple[np.ndarray, float]:
    """Weights (the last is the intercept, regularised like the rest) with the least half squared length plus cost times the loss, and that value."""
    data = clean(rows, features, label).cache()
    first = data.select(F.size("f").alias("n")).first()
    if first is None:
        data.unpersist()
        return np.zeros(1), 0.0
    d = first.n + 1

    def value_slope(w):
        def part(x, y):
            loss, slope, _ = losses(kind, x @ w, y)
            return np.concatenate([[loss.sum()], x.T @ slope])

        s = row_sums(data, part, d + 1)
        return 0.5 * w @ w + cost * s[0], w + cost * s[1:]

    def curved(w, v):
        return v + cost * row_sums(data, lambda x, y: x.T @ (losses(kind, x @ w, y)[2] * (x @ v)), d)

    w = np.zeros(d)
    f, g = value_slope(w)
    start = radius = np.linalg.norm(g)
    for _ in range(most):
        if np.linalg.norm(g) <= tolerance * start:
            break
        step, left = steps_within(lambda v, w=w: curved(w, v), g, radius)
        gain = -0.5 * (g @ step - step @ left)
        new_f, new_g = value_slope(w + step)
        ratio = (f - new_f) / gain if gain > 0 else 0.0
        size = np.linalg.norm(step)
        radius = min(radius, size) * 0.25 if ratio < 0.25 else max(radius, 2 * size) if ratio > 0.75 else radius
        if ratio > 1e-4:
            w, f, g = w + step, new_f, new_g
    data.unpersist()
    return w, float(f)


def steps_within(curved: Callable[[np.ndarray], np.ndarray], g: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A step towards the least of the quadratic model by conjugate gradients, at most radius long, and what is left of the slope."""
    s, r = np.zeros_like(g), -g
    p, rr = r.copy(), r @ r
    while np.sqrt(rr) > 0.1 * np.linalg.norm(g):
        hp = curved(p)
        a = rr / (p @ hp)
        if np.linalg.norm(s + a * p) > radius:
            b, c, e = p @ p, 2 * (s @ p), s @ s - radius * radius
            a = (-c + np.sqrt(c * c - 4 * b * e)) / (2 * b)
            return s + a * p, r - a * hp
        s, r = s + a * p, r - a * hp
        new = r @ r
        p, rr = r + new / rr * p, new
    return s, r


def dual_descent(rows: DataFrame, features: str, label: str, squared: bool = False, cost: float = 1.0, rounds: int = 1000, sweeps: int = 20, block: int = 4096, gap: float = 2e-3) -> tuple[np.ndarray, float, float]:
    """Weights of the hinge (or squared hinge) machine by its dual, with the primal and dual values; ends where they are within ``gap`` of each other.

    That ``rounds`` don't lead there is an error. ``sweeps`` and ``block`` are those of the squared hinge.
    """
    data = clean(rows, features, label)
    if not squared:
        return hinge_mix(data, cost, rounds, gap)
    n = data.count()
    parts = max(1, -(-n // block))
    if not n:
        return np.zeros(1), 0.0, 0.0
    # Rows are dealt by a hash, so blocks are alike; a block is one row of the table.
    dealt = data.withColumn("k", F.pmod(F.xxhash64("f", "y"), F.lit(parts)))
    blocks = written(dealt.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("y", "f"))).alias("rows")).select("k", F.expr("transform(rows, r -> r.f)").alias("f"), F.expr("transform(rows, r -> r.y)").alias("y")), "dual-blocks")
    upper, diagonal = np.inf, 0.5 / cost
    d = len(blocks.selectExpr("f[0] AS f").first().f) + 1
    zero = F.expr("transform(y, v -> 0D)")
    state = written(blocks.select("k", zero.alias("alpha"), zero.alias("new")), "dual-alphas")
    w, share, total, squares = np.zeros(d), 0.0, 0.0, 0.0
    for r in range(rounds):

        def run(batches, w=w.copy(), share=share, seed=r):
            for b in batches:
                for i in range(b.num_rows):
                    k, old, new = (b.column(c)[i].as_py() for c in ("k", "alpha", "new"))
                    y, x = np.array(b.column("y")[i].as_py()), _matrix(b.column("f")[i].values)
                    alpha = np.array(old) + share * (np.array(new) - np.array(old))
                    own = local_descent(x, y, alpha, w, upper, diagonal, sweeps, seed + k)
                    gone = own - alpha
                    sums = [gone.sum(), alpha @ gone, gone @ gone, *((gone * y) @ x)]
                    many = pa.list_(pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([v], many) for v in (alpha.tolist(), own.tolist(), sums))], names=["k", "alpha", "new", "sums"])

        state = written(blocks.join(state.select("k", "alpha", "new"), "k").mapInArrow(run, "k long, alpha array<double>, new array<double>, sums array<double>"), "dual-alphas")
        sums = np.zeros(d + 3)
        for i, v in state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[i] = v
        step = sums[3:]
        # The dual along the sum of all changes is a parabola; multipliers stay within bounds for shares up to one.
        curve = step @ step + diagonal * sums[2]
        share = min(1.0, (sums[0] - w @ step - diagonal * sums[1]) / curve) if curve > 0 else 0.0
        w, total, squares = w + share * step, total + share * sums[0], squares + 2 * share * sums[1] + share * share * sums[2]
        primal = primal_value(data, w, squared, cost)
        dual = total - 0.5 * w @ w - 0.5 * diagonal * squares
        if primal - dual <= gap * max(1.0, abs(primal)):
            return w, float(primal), float(dual)
    raise RuntimeError(f"primal and dual are still {primal - dual} apart after {rounds} rounds")


#: Places on the way from the best weights so far to those of the mix at which a round looks.
PLACES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0])


def hinge_mix(data: DataFrame, cost: float, rounds: int, gap: float) -> tuple[np.ndarray, float, float]:
    """Weights, primal and dual of the hinge machine of rows (f, y).

    At any weights, multipliers at their bound for the rows within the margin, and none for others, fit the dual, and so does each mix of
    such ones. A round, one pass over the rows, takes the loss and these multipliers' sums at some places; the driver then finds the best mix.
    """
    data = data.cache()
    first = data.select(F.size("f").alias("n")).first()
    if first is None:
        data.unpersist()
        return np.zeros(1), 0.0, 0.0
    d, m = first.n + 1, len(PLACES)
    best, w, least = np.zeros(d), np.zeros(d), np.inf
    points, totals, mix = np.zeros((1, d)), np.zeros(1), np.ones(1)
    for _ in range(rounds):
        line = best + PLACES[:, None] * (w - best)

        def part(x, y, line=line):
            z = 1 - y[:, None] * (x @ line.T)
            inside = (z > 0).astype(float)
            return np.concatenate([np.maximum(0, z).sum(0), inside.sum(0), (inside.T @ (x * y[:, None])).ravel()])

        s = cost * row_sums(data, part, m * (d + 2))
        primal, dual = 0.5 * (line * line).sum(1) + s[:m], float(totals @ mix - 0.5 * w @ w)
        i = int(np.argmin(primal))
        if primal[i] < least:
            best, least = line[i], float(primal[i])
        near = gap * max(1.0, abs(least))
        if least - dual <= near:
            data.unpersist()
            return best, least, dual
        # Points that the mix does without go; the search starts from the mix, so the dual never falls.
        used = mix > 0
        points, totals = np.vstack([points[used], s[2 * m :].reshape(m, d)]), np.concatenate([totals[used], s[m : 2 * m]])
        mix = np.concatenate([mix[used] / mix[used].sum(), np.zeros(m)])
        k = points @ points.T
        mix, _ = improved(k, np.ones(len(mix)), mix, k @ mix - totals, 1.0, 0.01 * near, 20_000)
        w = mix @ points
    data.unpersist()
    raise RuntimeError(f"primal and dual are still {least - dual} apart after {rounds} rounds")


def primal_value(data: DataFrame, w: np.ndarray, squared: bool, cost: float) -> float:
    def part(x, y):
        m = np.maximum(0, 1 - y * (x @ w))
        return np.array([(m * m if squared else m).sum()])

    return float(0.5 * w @ w + cost * row_sums(data, part, 1)[0])


def local_descent(x, y, alpha, w, upper, diagonal, sweeps, seed):
    """New multipliers of a block of rows whose changes only it sees."""
    rnd, v, alpha = np.random.default_rng(seed), w.copy(), alpha.copy()
    size = (x * x).sum(1) + diagonal
    for _ in range(sweeps):
        for i in rnd.permutation(len(y)):
            slope = y[i] * (x[i] @ v) - 1 + diagonal * alpha[i]
            new = min(max(alpha[i] - slope / size[i], 0.0), upper)
            if new != alpha[i]:
                v += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return alpha


def kernel_matrix(a: np.ndarray, b: np.ndarray, kind: str, gamma: float, coef0: float, degree: int) -> np.ndarray:
    z = a @ b.T
    if kind == "rbf":
        z *= 2 * gamma
        z -= gamma * (a * a).sum(1)[:, None]
        z -= gamma * (b * b).sum(1)[None]
        return np.exp(np.minimum(z, 0, out=z), out=z)
    return {"linear": lambda: z, "poly": lambda: (gamma * z + coef0) ** degree, "sigmoid": lambda: np.tanh(gamma * z + coef0)}[kind]()


def improved(k: np.ndarray, y: np.ndarray, a: np.ndarray, g: np.ndarray, cost: float, tolerance: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and slopes of the dual of these rows, from given ones on: in each step the pair that violates the conditions most is solved exactly."""
    a, g, q, own = a.copy(), g.copy(), k * y[:, None] * y[None], np.diag(k)
    for _ in range(most):
        up, low = np.where(y > 0, a < cost, a > 0), np.where(y > 0, a > 0, a < cost)
        score = -y * g
        i = int(np.argmax(np.where(up, score, -np.inf)))
        b = np.where(low, score[i] - score, -np.inf)
        if not up[i] or b.max() <= tolerance:
            break
        curve = np.maximum(k[i, i] + own - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (b > 0), b * b / curve, -np.inf)))
        step = b[j] / curve[j]
        step = min(step, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += q[:, i] * (y[i] * step) - q[:, j] * (y[j] * step)
    return a, g


def working_set(k: np.ndarray, y: np.ndarray, cost: float, tolerance: float = 1e-3, most: int = 200_000) -> tuple[np.ndarray, float]:
    """Multipliers of the dual with a bias, and the bias rho."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    if (y == y[0]).all():
        return a, -float(y[0])
    a, g = improved(k, y, a, g, cost, tolerance, most)
    free = (a > 1e-9 * cost) & (a < cost * (1 - 1e-9))
    score = -y * g
    if free.any():
        return a, float(-score[free].mean())
    up, low = np.where(y > 0, a < cost, a > 0), np.where(y > 0, a > 0, a < cost)
    return a, float(-(score[up].max() + score[low].min()) / 2)


#: Rows of a block on the side of the rows and of the vectors, and blocks of vectors that a task of a sum of kernels holds.
ROW_BLOCK, VECTOR_BLOCK, HELD = 500, 2000, 16


def in_blocks(rows: DataFrame, key: str, size: int, held: int) -> DataFrame:
    """k, rows: blocks of about ``size`` rows, dealt by a hash of the key, about ``held`` blocks in a partition."""
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("k", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return dealt.repartition(-(-blocks // held), "k").groupBy("k").agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))


def packed(blocks: DataFrame, name: str) -> DataFrame:
    """k, the rows' id or coef as an array, and their f as the bytes of a matrix of doubles: a written table of blocks that are read many times."""
    kind = {f.name: f.dataType for f in blocks.schema["rows"].dataType.elementType}
    small_batches(blocks.sparkSession)
    one = next(c for c in ("id", "coef") if c in kind)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.column("rows")[i].values
                own = r.field(one)
                x = r.field("f").flatten().to_numpy().astype(float)
                yield pa.RecordBatch.from_arrays([b.column("k").slice(i, 1).cast(pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x.tobytes()], pa.binary())], names=["k", one, "x"])

    return written(blocks.mapInArrow(run, f"k long, {one} array<{kind[one].simpleString()}>, x binary"), name)


def kernel_sums(blocks: DataFrame, vectors: DataFrame, kind: str, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> DataFrame:
    """id, value: the sum of coefficients times kernels over all vectors (coef, f), for each row (id, f) of a table of blocks.

    Each block of rows meets each block of vectors; a task adds up what its blocks get, so neither side is held whole anywhere.
    """
    id_type = blocks.schema["id"].dataType.elementType

    def run(batches):
        own = {}
        for b in batches:
            for i in range(b.num_rows):
                ids, coef = b.column("id")[i].values, b.column("coef")[i].values.to_numpy()
                x, z = (np.frombuffer(b.column(c)[i].as_buffer()).reshape(len(v), -1) for c, v in (("x", ids), ("z", coef)))
                s = kernel_matrix(x, z, kind, gamma, coef0, degree) @ coef
                k = b.column("k")[i].as_py()
                if k in own:
                    own[k][1] += s
                else:
                    # The ids are taken out of the batch, which is not held.
                    own[k] = [pa.array(ids.to_pylist(), ids.type), s]
        for k, (ids, s) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), ids, pa.array(s)], names=["k", "i", "id", "s"])

    # Vectors are packed once; a task of the pairs would else collect them anew for each of its partitions of rows.
    dealt = packed(in_blocks(vectors.select("coef", F.col("f").cast("array<double>").alias("f"), F.xxhash64("f", "coef").alias("h")), "h", VECTOR_BLOCK, HELD), "kernel-vectors")
    dealt = dealt.repartition(-(-dealt.count() // HELD), "k").select("coef", F.col("x").alias("z"))
    pairs = blocks.join(dealt.hint("shuffle_replicate_nl"))
    parts = pairs.mapInArrow(run, f"k long, i int, id {id_type.simpleString()}, s double")
    return parts.groupBy("k", "i").agg(F.first("id").alias("id"), F.sum("s").alias("value")).select("id", "value")


def kernel_values(rows: DataFrame, key: str, features: str, vectors: DataFrame, rho: float, **how) -> DataFrame:
    """key, value as learners.decision_values has them, for any number of support vectors; null for rows without features."""
    data = rows.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("f"))
    bad = F.col("f").isNull() | F.exists("f", lambda x: x.isNull())
    if vectors.isEmpty():
        return data.select(F.col("id").alias(key), F.when(~bad, F.lit(-float(rho))).alias("value"))
    blocks = packed(in_blocks(data.where(~bad), "id", ROW_BLOCK, 1), "kernel-blocks")
    value = kernel_sums(dealt_evenly(blocks), vectors.select("coef", F.col("vector").alias("f")), **how)
    return value.select(F.col("id").alias(key), (F.col("value") - rho).alias("value")).unionByName(data.where(bad).select(F.col("id").alias(key), F.lit(None).cast("double").alias("value")))


def dealt_evenly(blocks: DataFrame, most: int = 200) -> DataFrame:
    """Blocks of a written table in as many partitions as there are, up to a number."""
    n = blocks.count()
    return blocks.repartition(max(1, min(n, most)), "k")


def kernel_machine(rows: DataFrame, features: str, label: str, cost: float = 1.0, kind: str = "rbf", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3, group: int = 2000, most: int | None = None, rounds: int = 200, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """Support vectors (coef, vector) and rho of a machine with a kernel, for kernel_values and learners.decision_values.

    Each round deals the rows that may move (first all, then those between the bounds or outside the margin conditions) anew to groups of about
    ``group`` rows. A group improves its multipliers against the slopes of all rows; of the sum of all changes the best share is taken, by
    an exact search along it. What kernels share, all but their least eigenvalue, moves all groups alike; a group counts it ``scale`` times,
    at most as often as there are groups: more where the best share fell below one, less where it went beyond. So changes add up without a
    share that leaves rows between the bounds that belong at them. Once the moving rows fit two groups, a round solves them as one. It ends where no pair violates the conditions by
    more than ten times ``tolerance``; if ``rounds`` don't lead there, or a caller's bound ``most`` on support vectors is passed, that is an error.
    """
    data = written(clean(rows, features, label).distinct().withColumn("id", F.xxhash64("f", "y")), "machine-rows")
    if data.isEmpty():
        return data.select(F.lit(0.0).alias("coef"), F.col("f").alias("vector")), 0.0
    how = dict(kind=kind, gamma=gamma, coef0=coef0, degree=degree)
    blocks = dealt_evenly(packed(in_blocks(data.select("id", "f"), "id", ROW_BLOCK, 1), "machine-blocks"))
    near = 1e-12 * cost

    def solve(pdf, *, scale):
        x, y, a = np.array(pdf["f"].tolist()), pdf["y"].to_numpy(), pdf["a"].to_numpy()
        k = kernel_matrix(x, x, **how)
        if scale > 1:
            own = max(0.0, float(np.linalg.eigvalsh(k)[0]))
            k *= scale
            k[np.diag_indices(len(k))] -= (scale - 1) * own
        new, _ = improved(k, y, a, pdf["g"].to_numpy(), cost, tolerance)
        new = np.where(new < near, 0.0, np.where(new > cost - near, cost, new))
        return pdf[["id", "f", "y"]].assign(d=new - a)[new != a]

    state = written(data.select("id", "y", F.lit(0.0).alias("a"), F.lit(-1.0).alias("g")), "machine-state")
    score = -F.col("y") * F.col("g")
    up, low = F.expr(f"IF(y > 0, a < {cost!r}D, a > 0)"), F.expr(f"IF(y > 0, a > 0, a < {cost!r}D)")
    free = F.expr(f"a > 0 AND a < {cost!r}D")
    scale = 1.0
    for r in range(rounds + 1):
        at = state.agg(F.max(F.when(up, score)).alias("hi"), F.min(F.when(low, score)).alias("lo"), F.avg(F.when(free, score)).alias("mid"), F.first("y").alias("y")).first()
        if at.hi is None or at.lo is None:
            # All rows have one label.
            rho = -float(at.y)
            break
        mid = (at.hi + at.lo) / 2 if at.mid is None else at.mid
        rho = -mid
        if not at.hi - at.lo > 10 * tolerance:
            break
        if r == rounds:
            raise RuntimeError(f"conditions are still violated by {at.hi - at.lo} after {rounds} rounds")
        moving = state.where(free | (up & (score > mid + 2 * tolerance)) | (low & (score < mid - 2 * tolerance))) if r else state
        many = moving.count()
        groups = 1 if many <= 2 * group else -(-many // group)
        scale = min(scale, groups)
        dealt = moving.join(data.select("id", "f"), "id").withColumn("k", F.pmod(F.xxhash64("id", F.lit(r)), F.lit(groups)))
        steps = written(dealt.repartition(min(groups, 2000), "k").groupBy("k").applyInPandas(partial(solve, scale=scale), "id long, f array<double>, y double, d double"), "machine-steps")
        if steps.isEmpty():
            continue
        change = kernel_sums(blocks, steps.select((F.col("d") * F.col("y")).alias("coef"), "f"), **how)
        told = written(state.join(change, "id").join(steps.select("id", "d"), "id", "left").select("id", "y", "a", "g", F.coalesce("d", F.lit(0.0)).alias("d"), (F.col("y") * F.col("value")).alias("q")), "machine-changes")
        s = told.agg(F.sum(F.col("g") * F.col("d")).alias("slope"), F.sum(F.col("d") * F.col("q")).alias("curve")).first()
        # The dual along the sum of all changes is a parabola; multipliers stay within bounds for shares up to one.
        best = -s.slope / s.curve if s.curve > 0 else 1.0
        share = min(1.0, max(0.0, best))
        scale = max(1.0, scale * min(8.0, 1 / best if 0 < best < 1 else best**-0.5 if best > 0 else 8.0))
        a = F.col("a") + share * F.col("d")
        a = F.when(a < near, 0.0).when(a > cost - near, float(cost)).otherwise(a)
        state = written(told.select("id", "y", a.alias("a"), (F.col("g") + share * F.col("q")).alias("g")), "machine-state")
    top = state.where(F.col("a") > 1e-9 * cost)
    if most is not None and top.count() > most:
        raise ValueError(f"more than {most} support vectors")
    return written(top.join(data.select("id", "f"), "id").select((F.col("a") * F.col("y")).alias("coef"), F.col("f").alias("vector")), "machine-vectors"), rho
