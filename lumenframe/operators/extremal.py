"""Extremal regions of grey images: the tree of components under rising water, and the stable ones.

Pixels are rows (image, x, y, value). A component of the pixels up to a level is a node of the tree; as the level rises
components grow and merge into their parents. An image is a group: its pixels are flooded once, in order of value, by a
forest that joins each pixel with its lower neighbours. What follows, the pixels of a region, their moments, borders,
holes and strokes, are aggregations, joins and windows over rows, whatever the number of images.

Pixels that are missing are outside; an image without pixels has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Defaults of the detector: levels, least and most share of the image, most variation, least diversity.
DELTA, LEAST_AREA, MOST_AREA, MOST_VARIATION, LEAST_DIVERSITY = 2, 0.0001, 0.5, 0.5, 0.33
STEPS = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def flooded(x: np.ndarray, y: np.ndarray, v: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pixels in order of value, and for each, by its place in that order, the place of the pixel that stands for the next larger component.

    The last pixel of a component stands for it: pixels of one level and component point to it, and it points to that of its parent.
    """
    order = np.lexsort((x, y, v))
    at = {p: i for i, p in enumerate(zip(x[order].tolist(), y[order].tolist(), strict=True))}
    level = v[order]
    steps = STEPS + ([(1, 1), (-1, -1), (1, -1), (-1, 1)] if eight else [])
    up, top = list(range(len(order))), list(range(len(order)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for (px, py), i in at.items():
        for dx, dy in steps:
            j = at.get((px + dx, py + dy), i)
            if j < i and (r := root(j)) != i:
                up[r] = top[r] = i
    for i in reversed(range(len(up))):
        if level[up[up[i]]] == level[up[i]]:
            up[i] = up[up[i]]
    return order, np.array(up)


class Tree:
    """Nodes of the flooded image, children before parents: level, area, parent (its own index at a root), seed (the first pixel by y and x), and the node of each pixel."""

    def __init__(self, x, y, v, eight: bool = False):
        self.order, up = flooded(x, y, v, eight)
        level = v[self.order]
        stands = (level[up] != level) | (up == np.arange(len(up)))
        nodes = np.flatnonzero(stands)
        index = np.cumsum(stands) - 1
        self.level, self.parent = level[nodes], index[up[nodes]]
        self.of_pixel = index[np.where(stands, np.arange(len(up)), up)]
        self.area = np.bincount(self.of_pixel, minlength=len(nodes))
        key = (y[self.order].astype(np.int64) << 32) + x[self.order]
        self.seed = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(self.seed, self.of_pixel, key)
        for i, p in enumerate(self.parent.tolist()):
            if p != i:
                self.area[p] += self.area[i]
                self.seed[p] = min(self.seed[p], self.seed[i])

    def variation(self, delta: int) -> np.ndarray:
        """Growth of each node up to the largest one that holds it within delta levels."""
        reach = np.arange(len(self.parent))
        while True:
            above = self.parent[reach]
            more = (above != reach) & (self.level[above] <= self.level + delta)
            if not more.any():
                return (self.area[reach] - self.area) / self.area
            reach = np.where(more, above, reach)

    def stable(self, delta: int, least: float, most: float, most_variation: float) -> tuple[np.ndarray, np.ndarray]:
        """Nodes whose variation is a local minimum along the tree, within bounds; and all variations."""
        q = self.variation(delta)
        below = self.parent != np.arange(len(q))
        able = ((q <= q[self.parent]) | ~below) & (self.area >= int(least)) & (self.area <= int(most)) & (q <= most_variation)
        leaf, steeper = np.ones(len(q), dtype=bool), np.zeros(len(q), dtype=bool)
        leaf[self.parent[below]] = False
        steeper[self.parent[below & (q > q[self.parent])]] = True
        return able & (leaf | steeper), q

    def diverse(self, stable: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
        """Of nested stable nodes of nearly one area those with the least variation, decided from the roots down."""
        out = stable.copy()
        children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent.tolist()):
            if p != i:
                children.setdefault(p, []).append(i)
        for i in reversed(np.flatnonzero(stable).tolist()):
            up, near = i, int(self.area[i] / (1 - least) + 0.5)
            while self.parent[up] != up and self.area[self.parent[up]] < near:
                up = int(self.parent[up])
                out[i] &= not (out[up] and q[up] <= q[i])
            small = int(self.area[i] * (1 - least) + 0.5)
            inner = list(children.get(i, ())) if out[i] else []
            while inner:
                k = inner.pop()
                if self.area[k] > small:
                    out[i] &= not (stable[k] and q[k] < q[i])
                    inner += children.get(k, ())
        return out

    def pixels(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a kept node and each pixel below it (by place in the input), climbing from all pixels at once."""
        node, pixel, found = self.of_pixel, self.order, []
        while len(node):
            hit = keep[node]
            found.append((node[hit], pixel[hit]))
            above = self.parent[node]
            go = above != node
            node, pixel = above[go], pixel[go]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def _by_image(pixels: DataFrame, key: str, value: str, schema: str, rows):
    kind = pixels.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        x, y, v = (pdf[c].to_numpy().astype(np.int64) for c in ("x", "y", "v"))
        out = rows(Tree(x, y, v, rows.eight), x, y)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(next(iter(out.values()))), **out})

    own = pixels.where(F.col(value).isNotNull()).groupBy(key, "x", "y").agg(F.max(value).alias("v"))
    return own.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def component_nodes(pixels: DataFrame, key: str, value: str, delta: int = DELTA, least: float = LEAST_AREA, most: float = MOST_AREA, most_variation: float = MOST_VARIATION, eight: bool = False) -> DataFrame:
    """Every component of every level: key, level, seed_x, seed_y, area, variation, and whether it is stable."""

    def rows(t, x, y):
        stable, q = t.stable(delta, least * len(x), most * len(x), most_variation)
        return {"level": t.level, "seed_x": t.seed & 0xFFFFFFFF, "seed_y": t.seed >> 32, "area": t.area, "variation": q, "stable": stable}

    rows.eight = eight
    return _by_image(pixels, key, value, "level int, seed_x int, seed_y int, area long, variation double, stable boolean", rows)


def stable_regions(pixels: DataFrame, key: str, value: str, delta: int = DELTA, least: float = LEAST_AREA, most: float = MOST_AREA, most_variation: float = MOST_VARIATION, least_diversity: float = LEAST_DIVERSITY, eight: bool = False) -> DataFrame:
    """The pixels of all stable and diverse regions: key, region (a number within the image), level, variation, x, y."""

    def rows(t, x, y):
        stable, q = t.stable(delta, least * len(x), most * len(x), most_variation)
        node, pixel = t.pixels(t.diverse(stable, q, least_diversity))
        return {"region": node, "level": t.level[node], "variation": q[node], "x": x[pixel], "y": y[pixel]}

    rows.eight = eight
    return _by_image(pixels, key, value, "region int, level int, variation double, x int, y int", rows)


def border_distances(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (keys, x, y) with the city-block distance d of each pixel to the nearest one outside its region.

    Along a row it is the way to the nearer end of the pixel's run; over rows it is the least of that plus the rows between, within the run of the column: whatever lies beyond is no nearer.
    """
    w = lambda line, c: Window.partitionBy(*keys, line).orderBy(c)
    run = lambda line, c: F.col(c) - F.row_number().over(w(line, c))
    m = members.select(*keys, "x", "y").distinct().withColumns({"row_run": run("y", "x"), "column_run": run("x", "y")})
    ends = lambda line, r, c: Window.partitionBy(*keys, line, r)
    at = lambda line, r, c: F.least(F.col(c) - F.min(c).over(ends(line, r, c)), F.max(c).over(ends(line, r, c)) - F.col(c)) + 1
    m = m.withColumns({"h": at("y", "row_run", "x"), "u": at("x", "column_run", "y")})
    other = m.select(*keys, "x", "column_run", F.col("y").alias("oy"), F.col("h").alias("oh"))
    # A pixel looks no further along its column than its own bound.
    near = m.join(other, [*keys, "x", "column_run"]).where(F.abs(F.col("oy") - F.col("y")) <= F.least("h", "u"))
    return near.groupBy(*keys, "x", "y").agg(F.least(F.min(F.abs(F.col("oy") - F.col("y")) + F.col("oh")), F.min("u")).cast("int").alias("d"))


def holes(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys and holes of regions that are connected by their four neighbours: one less their Euler number, which counts of the four-pixel squares give."""
    corners = F.explode(F.expr("transform(sequence(0, 3), i -> named_struct('dx', i % 2, 'dy', i div 2, 'bit', shiftleft(1, i)))"))
    q = members.select(*keys, "x", "y").distinct().withColumn("c", corners)
    q = q.groupBy(*keys, (F.col("x") + F.col("c.dx")).alias("qx"), (F.col("y") + F.col("c.dy")).alias("qy")).agg(F.sum("c.bit").alias("bits"))
    ones = F.bit_count("bits")
    euler = (F.count_if(ones == 1) - F.count_if(ones == 3) + 2 * F.count_if(F.col("bits").isin(6, 9))) / 4
    return q.groupBy(*keys).agg((1 - euler).cast("int").alias("holes"))


def region_features(members: DataFrame, keys: list[str], pixels: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each region of members (keys, x, y): area, box, centre, central second moments, perimeter (pixels with a neighbour outside), holes, mean and deviation of strokes (city-block distances to the border) and of grey."""
    m = members.select(*keys, "x", "y").distinct()
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    cov = lambda a, b: F.avg(a * b) - F.avg(a) * F.avg(b)
    grey = m.join(pixels.select(key, "x", "y", F.col(value).alias("grey")), [key, "x", "y"])
    shape = grey.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        cov(x, x).alias("m20"), cov(x, y).alias("m11"), cov(y, y).alias("m02"), F.avg("grey").alias("grey_mean"), F.stddev_pop("grey").alias("grey_sd"),
    )
    # A distance of one is a pixel of the border.
    d = border_distances(m, keys).groupBy(*keys).agg(F.count_if(F.col("d") == 1).alias("perimeter"), F.avg("d").alias("stroke_mean"), F.stddev_pop("d").alias("stroke_sd"))
    return shape.join(d, keys).join(holes(m, keys), keys)
