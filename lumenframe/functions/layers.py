"""Element-wise layers, normalisations, losses and shape operations on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot, total


def each(a: Column, f) -> Column:
    return F.transform(a, f)


def activations(a: Column, slope: float = 0.1, alpha: float = 1.0, cut: float = 0.0, power: tuple[float, float, float] = (2.0, 1.0, 0.5)) -> dict[str, Column]:
    """The element-wise layers; power is (exponent, shift, scale) of (shift + scale x) ** exponent."""
    exponent, shift, scale = power
    return {
        "absval": each(a, F.abs),
        "relu": each(a, lambda x: F.greatest(x, F.lit(0.0))),
        "prelu": each(a, lambda x: F.greatest(x, F.lit(0.0)) + slope * F.least(x, F.lit(0.0))),
        "elu": each(a, lambda x: F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))),
        "bnll": each(a, lambda x: F.greatest(x, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(x)))),
        "sigmoid": each(a, lambda x: 1 / (1 + F.exp(-x))),
        "tanh": each(a, F.tanh),
        "exp": each(a, F.exp),
        "log": each(a, lambda x: F.log(F.abs(x) + 1e-9)),
        "power": each(a, lambda x: F.pow(shift + scale * x, F.lit(exponent))),
        "threshold": each(a, lambda x: F.when(x > cut, 1.0).otherwise(0.0)),
    }


def mean_variance_normalised(a: Column, eps: float = 1e-9) -> Column:
    """(x - mean) / (deviation + eps) over the entries of one vector."""
    n = F.size(a)
    mean = total(a) / n
    # An array of one, transformed, names what is computed once.
    centred = F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x - m))[0]
    return F.transform(F.array(F.sqrt(dot(centred, centred) / n) + eps), lambda s: F.transform(centred, lambda x: x / s))[0]


def response_normalised(a: Column, size: int = 5, alpha: float = 1e-4, beta: float = 0.75, k: float = 1.0) -> Column:
    """Each entry over (k + alpha / size times the sum of squares around it) ** beta."""
    half = size // 2
    around = lambda i: F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(a) - 1) - F.greatest(i - half, F.lit(0)) + 1)
    return F.transform(a, lambda x, i: x / F.pow(k + alpha / size * F.aggregate(around(i), F.lit(0.0), lambda s, y: s + y * y), F.lit(beta)))


def pixel_normalised(a: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / (sd + 1e-8), by channel."""
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), sd, lambda x, s: x / (s + 1e-8))


def inner_product(a: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return F.array(*(dot(a, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias, strict=True)))


def eltwise(a: Column, b: Column, kind: str = "sum") -> Column:
    """Sum, product or maximum, entry by entry."""
    return F.zip_with(a, b, {"sum": lambda x, y: x + y, "prod": lambda x, y: x * y, "max": lambda x, y: F.greatest(x, y)}[kind])


def tiled(a: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(a, times))


def cropped(a: Column, offset: int, size: int) -> Column:
    return F.slice(a, offset + 1, size)


def reductions(a: Column) -> dict[str, Column]:
    """Sum, sum of absolute values, sum of squares and mean."""
    return {"sum": total(a), "asum": total(F.transform(a, F.abs)), "sumsq": dot(a, a), "mean": total(a) / F.size(a)}


def losses(a: Column, b: Column, target: Column, margin: float = 1.0) -> dict[str, Column]:
    """Losses of scores a against scores b, or against the class target (from 0)."""
    from lumenframe.functions.vectors import softmax

    gap = F.zip_with(a, b, lambda x, y: x - y)
    p = softmax(a)
    own = F.element_at(p, (target + 1).cast("int"))
    hinge = F.transform(a, lambda x, i: F.greatest(F.lit(0.0), 1 - F.when(i == target, x).otherwise(-x)))
    distance = F.sqrt(dot(gap, gap))
    return {
        "euclidean": dot(gap, gap) / 2,
        "smooth_l1": total(F.transform(gap, lambda d: F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5))),
        "softmax": -F.log(F.greatest(own, F.lit(1e-30))),
        "hinge_l1": total(hinge),
        "hinge_l2": dot(hinge, hinge),
        "sigmoid_cross_entropy": total(F.transform(a, lambda x, i: F.greatest(x, F.lit(0.0)) - x * F.when(i == target, 1.0).otherwise(0.0) + F.log(1 + F.exp(-F.abs(x))))),
        "contrastive_same": dot(gap, gap) / 2,
        "contrastive_other": F.pow(F.greatest(margin - distance, F.lit(0.0)), F.lit(2.0)) / 2,
    }
