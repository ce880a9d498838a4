"""Clustering within groups, and learners."""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot, doubles, ranked
from lumenframe.session import written

LINKS = ("single", "complete", "average", "weighted", "ward", "centroid", "median")


def merge_steps(points: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Agglomerative clustering by the Lance-Williams recurrence: (cluster, cluster, height, size) for each merge, clusters numbered from n up."""
    n = len(points)
    squared = method in ("ward", "centroid", "median")
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    recur = {
        "single": lambda x, y, a, b, s, h: np.minimum(x, y),
        "complete": lambda x, y, a, b, s, h: np.maximum(x, y),
        "average": lambda x, y, a, b, s, h: (a * x + b * y) / (a + b),
        "weighted": lambda x, y, a, b, s, h: (x + y) / 2,
        "ward": lambda x, y, a, b, s, h: ((a + s) * x + (b + s) * y - s * h) / (a + b + s),
        "centroid": lambda x, y, a, b, s, h: (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2,
        "median": lambda x, y, a, b, s, h: (x + y) / 2 - h / 4,
    }[method]
    # The nearest of each cluster is kept, so that a merge looks at a few rows and not at all pairs; gone clusters are infinitely far.
    ids, size, out = list(range(n)), np.ones(n), []
    near = d.argmin(1) if n else np.empty(0, dtype=int)
    best = d[np.arange(n), near]
    for step in range(n - 1):
        i = int(best.argmin())
        j = int(near[i])
        h, a, b = d[i, j], size[i], size[j]
        new = recur(d[i], d[j], a, b, size, h)
        new[[i, j]] = np.inf
        d[i] = d[:, i] = new
        d[j] = d[:, j] = np.inf
        size[i] = a + b
        best[j] = np.inf
        stale = (near == i) | (near == j)
        stale[i] = True
        closer = ~stale & ((new < best) | ((new == best) & (i < near)))
        best[closer], near[closer] = new[closer], i
        rows = np.flatnonzero(stale)
        near[rows] = d[rows].argmin(1)
        best[rows] = d[rows, near[rows]]
        p, q = sorted((ids[i], ids[j]))
        out.append((p, q, float(np.sqrt(h) if squared else h), int(a + b)))
        ids[i] = n + step
    return out


def agglomerative(rows: DataFrame, key: str, order: str, features: list[str], method: str = "single") -> DataFrame:
    """key, step, left, right, height, size: the dendrogram of each group; groups are images, of bounded size."""
    kind = rows.schema[key].dataType.simpleString()
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.array(*(F.col(c).cast("double") for c in features)).alias("x")))).alias("r"))
    g = g.select(key, F.transform("r", lambda e: e["x"]).alias("x"))

    def run(frames):
        for pdf in frames:
            out = []
            for k, x in zip(pdf[key], pdf["x"], strict=True):
                out += [(k, i, *s) for i, s in enumerate(merge_steps(np.stack(x), method))]
            yield pd.DataFrame(out, columns=[key, "step", "left", "right", "height", "size"])

    return g.mapInPandas(run, f"{key} {kind}, step int, left int, right int, height double, size int")


def log_nfa(n: int, k: int, p: float, tests: float = 1.0) -> float:
    """log10 of tests times the probability of at least k successes out of n; terms are added until they no longer count."""
    if n <= 0 or k <= 0 or p >= 1:
        return log(tests) / log(10)
    if p <= 0:
        return -np.inf
    term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    top, total, ratio = term, 1.0, p / (1 - p)
    part = 1.0
    for i in range(k + 1, n + 1):
        part *= (n - i + 1) / i * ratio
        total += part
        if part < 1e-12 * total and (n - i) / (i + 1) * ratio < 1:
            break
    return (top + log(total) + log(tests)) / log(10)


def false_alarms(rows: DataFrame, n: str, k: str, p: str) -> DataFrame:
    """Adds log_nfa of the columns n, k and p."""

    @F.pandas_udf("double")
    def value(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([log_nfa(int(a), int(b), float(c)) for a, b, c in zip(n, k, p, strict=True)])

    return rows.withColumn("log_nfa", value(n, k, p))


def linear_scores(rows: DataFrame, features: str, weights: list[list[float]], biases: list[float], k: int = 3) -> DataFrame:
    """Adds best: the k largest of w x + b over the classes of a fixed table."""
    f = doubles(F.col(features))
    scores = F.array(*(dot(f, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, biases, strict=True)))
    return rows.withColumn("best", ranked(scores, k))


def pca_encoded(rows: DataFrame, features: str, mean: list[float], vectors: list[list[float]]) -> DataFrame:
    """Adds code: the components of the centred vector."""
    centred = F.zip_with(doubles(F.col(features)), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return rows.withColumn("centred", centred).withColumn("code", F.array(*(dot(F.col("centred"), F.array(*map(F.lit, v))) for v in vectors))).drop("centred")


def nearest_centre(rows: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    """Adds cluster and distance2: the nearest of a fixed table of centres, the first of equals."""
    f = doubles(F.col(features))
    d = F.array(*(F.aggregate(F.zip_with(f, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) for c in centres))
    return rows.withColumn("d", d).withColumn("distance2", F.array_min("d")).withColumn("cluster", F.array_position("d", F.array_min("d")).cast("int") - 1).drop("d")


def kmeans(rows: DataFrame, features: str, k: int = 5, seed: int = 1, steps: int = 10):
    """k-means++ in parallel form by Spark's own learner; returns the model."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=k, seed=seed, maxIter=steps, featuresCol="v").fit(rows.select(array_to_vector(doubles(F.col(features))).alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of edges (a, b).

    In each round every node goes over to its smallest neighbour, and edges that now join a node with itself or repeat another go; the rest is
    a smaller graph of the same components. Then the labels of the smaller graphs are handed down. Each round's tables are written to the shared folder.
    """
    rest, moves = edges.select("a", "b"), []
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("to")), "moves")
        moves.append(to)
        one = rest.join(to.toDF("a", "p"), "a").join(to.toDF("b", "q"), "b")
        low, high = F.least("p", "q"), F.greatest("p", "q")
        rest = written(one.where("p <> q").select(low.alias("a"), high.alias("b")).distinct(), "edges")
        if rest.isEmpty():
            break
    labels = moves.pop().withColumnRenamed("to", "component")
    while moves:
        labels = written(moves.pop().join(labels.toDF("to", "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component")), "labels")
    return labels


def meaningful(points: np.ndarray, steps: list[tuple[int, int, float, int]]) -> list[list[int]]:
    """The clusters of a dendrogram that are most meaningful in their branches: with the least number of false alarms."""
    n = len(points)
    low, high, members, best, chosen, nfa = [], [], [], [], [], []
    box = lambda i: (points[i], points[i]) if i < n else (low[i - n], high[i - n])
    for a, b, _, _ in steps:
        (la, ha), (lb, hb) = box(a), box(b)
        low.append(np.minimum(la, lb))
        high.append(np.maximum(ha, hb))
        members.append([x for i in (a, b) for x in ([i] if i < n else members[i - n])])
    volume = [min(float(np.prod(h - o)) or 0.001, 0.999999) for o, h in zip(low, high, strict=True)]
    for k, (a, b, _, size) in enumerate(steps):
        own = log_nfa(n, size, volume[k])
        nfa.append(own)
        below = [i - n for i in (a, b) if i >= n]
        least = min((best[i] for i in below), default=np.inf)
        alone = sum(nfa[i] for i in below) + (len(below) == 1)
        if not below or (own < least and (own < alone or len(below) == 2)):
            best.append(own)
            chosen.append([k])
        else:
            best.append(min(own, least))
            chosen.append([c for i in below for c in chosen[i]])
    return [members[c] for c in chosen[-1]] if chosen else []


def meaningful_clusters(rows: DataFrame, key: str, order: str, features: list[str], method: str = "single") -> DataFrame:
    """key, order, cluster of the members of meaningful clusters; features lie between 0 and 1; groups are images, of bounded size."""
    kind, okind = rows.schema[key].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.array(*(F.col(c).cast("double") for c in features)).alias("x")))).alias("r"))
    g = g.select(key, F.transform("r", lambda e: e[order]).alias("o"), F.transform("r", lambda e: e["x"]).alias("x"))

    def run(frames):
        for pdf in frames:
            out = []
            for k, o, x in zip(pdf[key], pdf["o"], pdf["x"], strict=True):
                p = np.stack(x)
                out += [(k, o[i], c) for c, own in enumerate(meaningful(p, merge_steps(p, method))) for i in own]
            yield pd.DataFrame(out, columns=[key, order, "cluster"])

    return g.mapInPandas(run, f"{key} {kind}, {order} {okind}, cluster int")


def evidence_clusters(rows: DataFrame, cluster: str, item: str, least: int) -> DataFrame:
    """node, component: items clustered anew by single linkage of those that at least ``least`` clusters hold together."""
    from lumenframe.operators.matching import cooccurrence

    pairs = cooccurrence(rows, cluster, item).where(F.col("n") >= least).select(F.col("i").alias("a"), F.col("j").alias("b"))
    items = rows.select(F.col(item).alias("a")).distinct()
    return components(pairs.unionByName(items.select("a", F.col("a").alias("b"))))


def learned_components(rows: DataFrame, features: str, k: int) -> tuple[list[float], list[list[float]]]:
    """Mean and the first k principal directions, by Spark's own learner; each direction's largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = rows.select(array_to_vector(doubles(F.col(features))).alias("v"))
    mean = v.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    pc = PCA(k=k, inputCol="v", outputCol="c").fit(v).pc.toArray().T
    pc = pc * np.sign(pc[np.arange(len(pc)), np.abs(pc).argmax(1)])[:, None]
    return mean.tolist(), pc.tolist()


def pca_decoded(rows: DataFrame, mean: list[float], vectors: list[list[float]]) -> DataFrame:
    """Adds decoded: the vector that a code stands for."""
    out = F.array(*map(F.lit, mean))
    for i, v in enumerate(vectors):
        part = F.transform(F.array(*map(F.lit, v)), lambda y: F.col("code")[i] * y)  # noqa: B023
        out = F.zip_with(out, part, lambda x, y: x + y)
    return rows.withColumn("decoded", out)


def vocabulary(rows: DataFrame, features: str, words: int, seed: int = 1) -> list[list[float]]:
    """Centres of a k-means vocabulary, in a fixed order."""
    return sorted(c.tolist() for c in kmeans(rows, features, words, seed).clusterCenters())
