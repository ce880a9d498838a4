"""Vector arithmetic on array columns with higher-order functions; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column | str) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(a: Column, by: Column) -> Column:
    """a / by, zeros where by is zero."""
    return F.transform(a, lambda x: F.coalesce(x / F.nullif(by, F.lit(0.0)), F.lit(0.0)))


def l2_normalised(a: Column) -> Column:
    return scaled(a, F.sqrt(dot(a, a)))


def l1_normalised(a: Column) -> Column:
    return scaled(a, total(F.transform(a, F.abs)))


def min_max_normalised(a: Column) -> Column:
    low = F.array_min(a)
    return scaled(F.transform(a, lambda x: x - low), F.array_max(a) - low)


def entropy(a: Column) -> Column:
    """-sum p log2 p over the positive entries of a normalised vector."""
    return -total(F.transform(a, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return scaled(e, total(e))


def distances(a: Column, b: Column) -> dict[str, Column]:
    """Common dissimilarities of two vectors."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    none = F.lit(0.0)

    def part(f) -> Column:
        return total(F.zip_with(a, b, f))

    return {
        "euclidean": F.sqrt(total(F.transform(gap, lambda x: x * x))),
        "sqeuclidean": total(F.transform(gap, lambda x: x * x)),
        "cityblock": total(gap),
        "chebyshev": F.array_max(gap),
        "cosine": 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), none),
        "canberra": part(lambda x, y: F.coalesce(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), none), none)),
        "braycurtis": total(gap) / F.nullif(part(lambda x, y: F.abs(x + y)), none),
        "hamming": part(lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / F.size(a),
        "jaccard": F.coalesce(part(lambda x, y: F.when((x != y) & ((x != 0) | (y != 0)), 1.0).otherwise(0.0)) / F.nullif(part(lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)), none), none),
    }


def ranked(a: Column, k: int) -> Column:
    """The k largest entries as (value, index), ties by index."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("value"), p["idx"].alias("idx")))


def axpy(alpha: float, a: Column, b: Column) -> Column:
    """alpha a + b."""
    return F.zip_with(a, b, lambda x, y: alpha * x + y)


def powx(a: Column, exponent: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(exponent)))


def sign(a: Column) -> Column:
    return F.transform(a, lambda x: F.signum(x))


def intersection_distance(a: Column, b: Column) -> Column:
    """1 - sum of minima over the lesser sum of two histograms."""
    return 1 - total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / (F.least(total(a), total(b)) + 1e-6)


def weighted_distances(a: Column, b: Column, variances: Column, inverse: list[list[float]], p: float = 3.0) -> dict[str, Column]:
    """Dissimilarities with a parameter: Minkowski (without the root), standardised Euclidean (squared) and Mahalanobis (squared)."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    rows = F.array(*(F.array(*map(F.lit, r)) for r in inverse))
    return {
        "minkowski": total(F.transform(gap, lambda x: F.pow(F.abs(x), F.lit(p)))),
        "seuclidean": total(F.zip_with(gap, variances, lambda x, v: x * x / v)),
        "mahalanobis": total(F.zip_with(gap, F.transform(rows, lambda r: dot(r, gap)), lambda x, y: x * y)),
    }


def bool_distances(a: Column, b: Column) -> dict[str, Column]:
    """Dissimilarities of two arrays of truth values; those of equal arrays are 0 where a denominator vanishes."""
    count = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(f(x, y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n, both, differ, first = F.size(a), count(lambda x, y: x & y), count(lambda x, y: x != y), count(lambda x, y: x & ~y)
    none = n - both - differ
    over = lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.nullif(y, F.lit(0)))
    crossed = first * (differ - first)
    return {
        "yule": over(2 * crossed, crossed + both * none),
        "matching": differ.cast("double"),
        "dice": over(differ, differ + 2 * both),
        "rogerstanimoto": over(2 * differ, differ + n),
        "russellrao": (n - both).cast("double"),
        "sokalsneath": over(2 * differ, both + 2 * differ),
        "kulsinski": 1 - (over(both, both + first) + over(both, both + differ - first)) / 2,
        "jaccard_bool": over(differ, differ + both),
    }
