"""Further queries: regions, masks, votes, vocabularies, medians."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import pixels as P
from lumenframe.functions import vectors as V
from lumenframe.operators import cluster as C
from lumenframe.operators import contrast, extremal, images, learners, matching, objectness, ordering, regions, solvers, strokes, windows
from lumenframe.queries import _W, _pg, _px, _vec, BOXES_SQL, WITH, boxes, iou_duck, pixel_rows, pred_truth, query
from lumenframe.queries_more import _grid, grid
from lumenframe.session import table, written

_region = "SELECT image_id, ord, (x2 - x1) * (y2 - y1) // 40 AS area, score AS eccentricity, CAST(x1 AS DOUBLE) / 400 AS solidity, CAST(ord % 4 AS INT) AS holes, CAST(x1 % 50 AS DOUBLE) AS stroke_sd, CAST(y1 % 60 AS DOUBLE) AS stroke_mean, x1, y1, x2, y2 FROM boxes"


def region_rows(spark, d):
    e = F.expr
    return boxes(spark, d).select(
        "image_id", "ord", e("(x2 - x1) * (y2 - y1) div 40").alias("area"), e("score").alias("eccentricity"), e("CAST(x1 AS DOUBLE) / 400").alias("solidity"), e("CAST(ord % 4 AS INT)").alias("holes"),
        e("CAST(x1 % 50 AS DOUBLE)").alias("stroke_sd"), e("CAST(y1 % 60 AS DOUBLE)").alias("stroke_mean"), "x1", "y1", "x2", "y2",
    )


@query(f"{WITH}, r AS ({_region}) SELECT image_id, ord FROM r WHERE area BETWEEN 75 AND 600 AND eccentricity BETWEEN 0.1 AND 0.995 AND solidity >= 0.4")
def component_filter(spark, d):
    return regions.components(region_rows(spark, d)).select("image_id", "ord")


@query(f"{WITH}, r AS ({_region}) SELECT image_id, ord FROM r WHERE (stroke_mean = 0 OR stroke_sd / stroke_mean <= 0.8) AND holes <= 2 AND x2 - x1 >= 3 AND y2 - y1 >= 3")
def region_filter(spark, d):
    return regions.strokes(region_rows(spark, d)).select("image_id", "ord")


@query(f"{WITH} SELECT image_id, label_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes GROUP BY 1, 2")
def bounding_rectangles(spark, d):
    return regions.bounding(boxes(spark, d), ["image_id", "label_id"])


@query(f"WITH {_px} SELECT img, round(count(*) FILTER (r > 100 AND g > 80) / nullif(count(*) FILTER (g > 80), 0), 6) AS recall, round(count(*) FILTER (r > 100 AND g > 80) / nullif(count(*) FILTER (r > 100), 0), 6) AS precision FROM px GROUP BY img")
def mask_recall_precision(spark, d):
    return regions.mask_scores(pixel_rows(spark, d), "img", F.col("r") > 100, F.col("g") > 80)


@query(f"{WITH} SELECT image_id, ord, round(1 - 1 / (1 + exp(2 * (score - 0.5))), 6) AS p FROM boxes")
def boosted_vote_probability(spark, d):
    return boxes(spark, d).withColumn("v", F.col("score") - 0.5).select("image_id", "ord", F.round(regions.vote_probability("v"), 6).alias("p"))


@query(f"""WITH {_pg}, p AS (SELECT p.image_id, p.ord, {iou_duck('p.', 'g.', 'eval')} AS iou, p.x1 >= g.x1 AND p.y1 >= g.y1 AND p.x2 <= g.x2 AND p.y2 <= g.y2 AS inside, g.ord AS o FROM pred p JOIN gt g USING (image_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, ord ORDER BY iou DESC, o) AS r FROM p)
SELECT image_id, ord, iou >= 0.7 AS positive FROM b WHERE r = 1 AND ((iou >= 0.7 AND inside) OR (iou <= 0.3 AND NOT inside))""")
def proposal_sampling(spark, d):
    p, t = pred_truth(spark, d)
    best = matching.best_truth(p, t)
    x = best.join(matching.renamed(p, "", ("image_id", "ord")), ["image_id", "ord"])
    g = t.select("image_id", F.col("ord").alias("truth_ord"), *(F.col(c).alias(f"g_{c}") for c in matching.BOX))
    inside = F.expr("x1 >= g_x1 AND y1 >= g_y1 AND x2 <= g_x2 AND y2 <= g_y2")
    return regions.sampled_proposals(x.join(g, ["image_id", "truth_ord"]).withColumn("cover", F.when(inside, 1).otherwise(0))).select("image_id", "ord", "positive")


@query(f"""WITH {_vec}, s AS (SELECT vec_id, label, c - 1 AS word, list_sum(list_transform(list_zip(e, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dd FROM v, (SELECT unnest({_W!r}) AS w, generate_subscripts({_W!r}, 1) AS c)),
n AS (SELECT vec_id, label, CAST(word AS INT) AS word FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, word) AS r FROM s) WHERE r = 1)
SELECT label, word, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM n GROUP BY label, word""")
def bag_of_words_histogram(spark, d):
    from lumenframe.operators.histograms import histogram

    near = C.nearest_centre(table(spark, d, "embeddings"), "embedding", _W)
    return histogram(near, "label", "cluster").select("label", F.col("bin").alias("word"), "n", F.round("p", 6).alias("share"))


_pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query(f"""WITH {_vec}, t AS (SELECT vec_id, [{', '.join(f'CAST({" + ".join(f"(CASE WHEN e[{k + 1}] > 0 THEN {int(c == i)} ELSE {int(c == j)} END)" for k, (i, j) in enumerate(_pairs) if c in (i, j))} AS INT)' for c in range(4))}] AS votes FROM v)
SELECT vec_id, CAST(list_position(votes, list_max(votes)) - 1 AS INT) AS winner, list_max(votes) AS votes FROM t""")
def pairwise_votes(spark, d):
    v = table(spark, d, "embeddings").withColumn("votes", learners.pair_votes("embedding", 4))
    return v.select("vec_id", learners.winner(F.col("votes")).alias("winner"), F.array_max("votes").alias("votes"))


@query("SELECT vec_id, round(1 / (1 + exp(-4.0 * CAST(embedding[1] AS DOUBLE) + 0.1)), 6) AS p FROM embeddings")
def platt_probability(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(learners.platt(F.col("embedding")[0].cast("double"), -4.0, 0.1), 6).alias("p"))


@query(f"""{WITH}, s AS (SELECT image_id, list_sort(list(score)) AS v, count(*) AS n FROM boxes GROUP BY image_id)
SELECT image_id, CASE WHEN n % 2 = 1 THEN v[least((n + 1) // 2, n - 1) + 1] ELSE (v[n // 2 + 1] + v[least(n // 2 + 1, n - 1) + 1]) / 2 END AS median_score, CAST(n AS BIGINT) AS n FROM s""")
def median_score(spark, d):
    """The surveyed median: the element after the middle one, or the mean of the two after it; never beyond the last."""
    g = boxes(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list("score")).alias("v"), F.count("*").alias("n"))
    at = lambda i: F.col("v")[F.least(i, F.col("n") - 1).cast("int")]
    half = F.floor(F.col("n") / 2)
    return g.select("image_id", F.when(F.col("n") % 2 == 1, at(half + 1)).otherwise((at(half) + at(half + 1)) / 2).alias("median_score"), "n")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS n, count(*) OVER () AS t FROM orders)
SELECT o_orderkey, CASE WHEN n <= floor(t * 0.1 + 0.5) THEN 'val' WHEN n <= 2 * floor(t * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS split FROM n""")
def shuffled_split(spark, d):
    s = ordering.shuffled_rank(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)
    return ordering.prefix_split(ordering.row_numbers(s, ["shuffle_key", "o_orderkey"])).select("o_orderkey", "split")


@query()
def graph_segments(spark, d):
    p = boxes(spark, d).select("image_id", F.expr("CAST(x1 div 40 AS INT)").alias("x"), F.expr("CAST(y1 div 40 AS INT)").alias("y"), (F.col("score") * 255).alias("v"))
    return learners.segments(p.groupBy("image_id", "x", "y").agg(F.avg("v").alias("v")), "image_id", 60.0, 2)


@query("SELECT vec_id, round(list_max(embedding), 6) AS top, round(list_min(embedding), 6) AS low, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS l1 FROM embeddings")
def array_statistics(spark, d):
    e = V.doubles("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(e), 6).alias("top"), F.round(F.array_min(e), 6).alias("low"), F.round(V.total(F.transform(e, F.abs)), 6).alias("l1"))


@query(f"WITH {BOXES_SQL} SELECT image_id, label_id, CAST(sum(CAST(round(score * 1000) AS BIGINT)) * 1000 // count(*) AS BIGINT) AS mean_millionths, count(*) AS n FROM boxes GROUP BY 1, 2")
def mean_score_over_crops(spark, d):
    """Mean of scores of three decimals, in whole millionths, so that no rounding of halves enters."""
    total = F.sum(F.round(F.col("score") * 1000).cast("long")) * 1000
    return boxes(spark, d).groupBy("image_id", "label_id").agg(F.floor(total / F.count("*")).alias("mean_millionths"), F.count("*").alias("n"))


# Regions from pixels: the grids of queries_more

_level_sql = """rc AS (SELECT img, x, y, v, x AS qx, y AS qy FROM gd UNION SELECT r.img, r.x, r.y, r.v, g.x, g.y FROM rc r JOIN gd g ON g.img = r.img AND g.v <= r.v AND abs(g.x - r.qx) + abs(g.y - r.qy) = 1),
cp AS (SELECT img, x, y, v AS level, count(*) AS area, min(qy * 65536 + qx) AS seed FROM rc GROUP BY 1, 2, 3, 4), nd AS (SELECT img, level, seed, min(area) AS area FROM cp GROUP BY 1, 2, 3),
st AS (SELECT DISTINCT ON (n.img, n.level, n.seed) n.*, c.x, c.y FROM nd n JOIN cp c USING (img, level, seed)),
an AS (SELECT s.img, s.level, s.seed, s.area, c.level AS alevel, c.seed AS aseed, c.area AS aarea FROM st s JOIN (SELECT DISTINCT cp.img, cp.level, cp.seed, cp.area, rc.qx, rc.qy FROM cp JOIN rc USING (img, x, y)) c ON c.img = s.img AND c.qx = s.x AND c.qy = s.y AND c.level >= s.level),
vr AS (SELECT img, level, seed, area, max(CASE WHEN alevel <= level + 2 THEN aarea END) AS reach FROM an GROUP BY 1, 2, 3, 4), vq AS (SELECT *, (reach - area) / area AS variation FROM vr),
pa AS (SELECT a.img, a.level, a.seed, arg_min(struct_pack(l := alevel, s := aseed), alevel) AS p FROM an a WHERE alevel > level GROUP BY 1, 2, 3),
pq AS (SELECT v.*, p.p, q.variation AS above FROM vq v LEFT JOIN pa p ON p.img = v.img AND p.level = v.level AND p.seed = v.seed LEFT JOIN vq q ON q.img = v.img AND q.level = p.p.l AND q.seed = p.p.s),
ch AS (SELECT img, p.l AS level, p.s AS seed, count(*) AS n, max(variation) AS steepest FROM pq WHERE p IS NOT NULL GROUP BY 1, 2, 3), tt AS (SELECT img, count(*) AS total FROM gd GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_px}, {_grid}, {_level_sql} SELECT q.img, CAST(q.level AS INT) AS level, CAST(q.seed % 65536 AS INT) AS seed_x, CAST(q.seed // 65536 AS INT) AS seed_y, q.area, round(q.variation, 6) AS variation,
  (above IS NULL OR q.variation <= above) AND q.area >= floor(0.01 * total) AND q.area <= floor(0.5 * total) AND q.variation <= 0.5 AND (ch.n IS NULL OR ch.steepest > q.variation) AS stable
FROM pq q JOIN tt USING (img) LEFT JOIN ch ON ch.img = q.img AND ch.level = q.level AND ch.seed = q.seed""")
def extremal_components(spark, d):
    """Every component of every grey level of the grids, with its area, variation and whether it is stable."""
    return extremal.component_nodes(grid(spark, d), "img", "v", least=0.01).withColumn("variation", F.round("variation", 6))


def grid_regions(spark, d):
    """Stable regions of the grids, dark (key 0) and bright (1), with their features."""
    g = grid(spark, d).select(F.col("img").alias("image"), "x", "y", F.col("v").cast("int").alias("v"))
    both = g.select(F.struct("image", F.lit(0).alias("bright")).alias("img"), "x", "y", "v").unionByName(g.select(F.struct("image", F.lit(1).alias("bright")).alias("img"), "x", "y", (255 - F.col("v")).alias("v")))
    both = both.select((F.col("img.image") * 2 + F.col("img.bright")).alias("img"), "x", "y", "v")
    m = written(extremal.stable_regions(both, "img", "v", least=0.01), "extremal-regions")
    return extremal.region_features(m, ["img", "region"], both, "img", "v")


@query()
def extremal_regions(spark, d):
    """Features of the stable regions, dark and bright; regions are named by their box and area."""
    r = grid_regions(spark, d)
    return r.select(F.expr("img div 2").alias("img"), (F.col("img") % 2).alias("bright"), "area", "x1", "y1", "x2", "y2", "perimeter", "holes", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "m20", "m11", "m02", "stroke_mean", "stroke_sd", "grey_mean", "grey_sd")))


_members = "m AS (SELECT img, CAST(v // 64 AS INT) AS band, x, y FROM gd)"


@query(f"""WITH {_px}, {_grid}, {_members}, xs AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM range(-1, 17) a(x), range(-1, 17) b(y)), k AS (SELECT DISTINCT img, band FROM m),
o AS (SELECT k.img, k.band, xs.x, xs.y FROM k, xs ANTI JOIN m ON m.img = k.img AND m.band = k.band AND m.x = xs.x AND m.y = xs.y)
SELECT m.img, m.band, m.x, m.y, CAST(min(abs(o.x - m.x) + abs(o.y - m.y)) AS INT) AS d FROM m JOIN o ON o.img = m.img AND o.band = m.band GROUP BY 1, 2, 3, 4""")
def region_border_distances(spark, d):
    """City-block distance of each cell of a grey band to the nearest cell outside it."""
    m = grid(spark, d).select("img", F.expr("CAST(v div 64 AS INT)").alias("band"), "x", "y")
    return extremal.border_distances(m, ["img", "band"])


@query()
def text_chain_from_pixels(spark, d):
    """From pixels to lines of text: stable regions, their strokes and holes, boosted vote, groups by height of their boxes."""
    r = grid_regions(spark, d).withColumn("ord", F.monotonically_increasing_id())
    r = r.select(F.col("img").alias("image_id"), "ord", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.col("grey_mean").alias("score"), "stroke_sd", "stroke_mean", "holes", "x1", "y1", "x2", "y2", F.expr("CAST(y1 div 4 AS BIGINT)").alias("line"))
    return regions.text_lines(r, [("w", 6.0, 0.5, -0.25), ("h", 9.0, 0.75, -0.5), ("score", 128.0, 0.5, 0.25)])


_dist = f"{_members}, xs AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM range(-1, 17) a(x), range(-1, 17) b(y)), k AS (SELECT DISTINCT img, band FROM m), o AS (SELECT k.img, k.band, xs.x, xs.y FROM k, xs ANTI JOIN m ON m.img = k.img AND m.band = k.band AND m.x = xs.x AND m.y = xs.y), ds AS (SELECT m.img, m.band, m.x, m.y, min(abs(o.x - m.x) + abs(o.y - m.y)) AS d FROM m JOIN o ON o.img = m.img AND o.band = m.band GROUP BY 1, 2, 3, 4)"


@query(f"""WITH RECURSIVE {_px}, {_grid}, {_dist}, up AS (SELECT img, band, x, y, x AS qx, y AS qy, d FROM ds UNION SELECT u.img, u.band, u.x, u.y, e.x, e.y, e.d FROM up u JOIN ds e ON e.img = u.img AND e.band = u.band AND e.d > u.d AND abs(e.x - u.qx) <= 1 AND abs(e.y - u.qy) <= 1),
w AS (SELECT img, band, x, y, max(d) AS w FROM up GROUP BY 1, 2, 3, 4) SELECT img, band, count(*) AS n, round(avg(w), 6) AS stroke_mean, round(stddev_pop(w), 6) AS stroke_sd FROM w GROUP BY 1, 2""")
def band_strokes(spark, d):
    """Mean and deviation of the stroke widths of each grey band of the grids."""
    m = grid(spark, d).select("img", F.expr("CAST(v div 64 AS INT)").alias("band"), "x", "y")
    w = strokes.stroke_widths(m, ["img", "band"])
    return w.groupBy("img", "band").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("stroke_mean"), F.round(F.stddev_pop("w"), 6).alias("stroke_sd"))


@query()
def stroke_text_rectangles(spark, d):
    """The text chain by strokes: stable regions cut at their edges, components of plausible shape and even stroke, and the rectangle around them."""
    g = grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v"))
    c = strokes.stroke_components(g, "v", low=60, high=240, area=(2, 120), most_cv=0.6, least=0.01, most=0.9, most_variation=1.0)
    sizes = g.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return strokes.text_rectangles(c, sizes, margin=1)


# A template that is high at the rim of a window and low inside.
_rim = [1.5 - 0.35 * min(i, j, 7 - i, 7 - j) - 0.03 * ((3 * i + j) % 5) for i in range(8) for j in range(8)]
_signs = objectness.signs_of(_rim)
_rim_sql = [sum(w if (word >> (63 - k)) & 1 else -w for word, w in _signs) for k in range(64)]
_grad_sql = """dn AS (SELECT i.img, CAST(a.x AS INT) AS x, CAST(b.y AS INT) AS y, coalesce(gd.v, 0) AS v FROM (SELECT DISTINCT img FROM gd) i CROSS JOIN range(0, 16) a(x) CROSS JOIN range(0, 16) b(y) LEFT JOIN gd ON gd.img = i.img AND gd.x = a.x AND gd.y = b.y),
gw AS (SELECT img, x, y, v, lag(v) OVER r AS l, lead(v) OVER r AS n, lag(v) OVER c AS u, lead(v) OVER c AS w FROM dn WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
gm AS (SELECT img, x, y, least(255, coalesce(abs(l - n), 2 * abs(v - coalesce(l, n))) + coalesce(abs(u - w), 2 * abs(v - coalesce(u, w)))) AS g FROM gw)"""


@query(f"""WITH {_px}, {_grid}, {_grad_sql}, wt AS (SELECT unnest({_rim_sql!r}::DOUBLE[]) AS w, generate_subscripts({_rim_sql!r}, 1) - 1 AS k)
SELECT a.img, a.x, a.y, round(sum(w * (b.g >> 4)), 6) AS score FROM gm a JOIN gm b ON b.img = a.img AND b.x BETWEEN a.x AND a.x + 7 AND b.y BETWEEN a.y AND a.y + 7 JOIN wt ON wt.k = (b.y - a.y) * 8 + b.x - a.x WHERE a.x <= 8 AND a.y <= 8 GROUP BY 1, 2, 3""")
def objectness_scores(spark, d):
    """Score of every window of 8 x 8 cells by a template of signs."""
    g = grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v"))
    return objectness.scores(g, ["v"], (16, 16), _signs).withColumn("score", F.round("score", 6))


_windows = {(8, 8): (0.01, -0.5), (8, 16): (0.012, -0.4), (16, 8): (0.012, -0.4), (4, 4): (0.02, -1.0)}


@query()
def objectness_proposals(spark, d):
    """The ten best windows of each grid over four sizes."""
    g = grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v"))
    p = objectness.proposals(g, ["v"], (16, 16), _windows, _signs, 20)
    w = Window.partitionBy("img").orderBy(F.desc("score"), "width", "height", "y1", "x1")
    return p.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where("rank <= 10").drop("raw")


# Contrast of colours and segments; cells of the grids with a colour


_cg = "cg AS (SELECT img, CAST(r // 16 AS INT) AS x, CAST(g // 16 AS INT) AS y, CAST(max(r) AS INT) AS r, CAST(max(g) AS INT) AS g, CAST(max(b) AS INT) AS b FROM px GROUP BY img, r // 16, g // 16)"


def colour_grid(spark, d):
    p = pixel_rows(spark, d)
    return p.groupBy("img", F.expr("CAST(r div 16 AS INT)").alias("x"), F.expr("CAST(g div 16 AS INT)").alias("y")).agg(*(F.max(c).alias(c) for c in "rgb"))


_labq = "CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0::DOUBLE / 3) ELSE 7.787 * {v} + 16.0 / 116.0 END"
_pal = f"""cc AS (SELECT *, CAST(floor(r / 255.0::DOUBLE * 11.9999) * 144 + floor(g / 255.0::DOUBLE * 11.9999) * 12 + floor(b / 255.0::DOUBLE * 11.9999) AS INT) AS code FROM cg),
cn AS (SELECT img, code, count(*) AS n FROM cc GROUP BY 1, 2), cr AS (SELECT *, row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY img) AS total, count(*) OVER (PARTITION BY img) AS kinds FROM cn WINDOW w AS (PARTITION BY img ORDER BY n DESC, code DESC)),
cs AS (SELECT *, least(count(*) FILTER (rank = 1 OR total - upto + n >= round_even(total * (1 - 0.95::DOUBLE), 0)) OVER (PARTITION BY img), 256) AS k FROM cr), ck AS (SELECT *, rank <= CASE WHEN k <= 10 THEN least(10, kinds) ELSE k END AS kept FROM cs),
cm AS (SELECT img, code, rank AS colour FROM ck WHERE kept UNION ALL SELECT a.img, a.code, arg_min(b.rank, (pow(a.code // 144 - b.code // 144, 2) + pow(a.code // 12 % 12 - b.code // 12 % 12, 2) + pow(a.code % 12 - b.code % 12, 2)) * 1000 + b.rank) FROM ck a JOIN ck b ON a.img = b.img AND b.kept WHERE NOT a.kept GROUP BY 1, 2),
cp AS (SELECT cc.*, colour FROM cc JOIN cm USING (img, code)), pm AS (SELECT img, colour, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM cp GROUP BY 1, 2),
pz AS (SELECT img, colour, n, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / (255.0 * 0.950456) AS x, (0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b) / 255.0 AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / (255.0 * 1.088754) AS z FROM pm),
pf AS (SELECT img, colour, n, y, {_labq.format(v='x')} AS fx, {_labq.format(v='y')} AS fy, {_labq.format(v='z')} AS fz FROM pz), pl AS (SELECT img, colour, n, CASE WHEN y > 0.008856 THEN 116.0 * fy - 16.0 ELSE 903.3 * y END AS l, 500.0 * (fx - fy) AS a, 200.0 * (fy - fz) AS b FROM pf),
pg AS (SELECT i.img, i.colour, j.colour AS other, j.n, sqrt((i.l - j.l) * (i.l - j.l) + (i.a - j.a) * (i.a - j.a) + (i.b - j.b) * (i.b - j.b)) AS gap FROM pl i JOIN pl j USING (img))"""


@query(f"""WITH {_px}, {_cg}, {_pal}, rw AS (SELECT img, colour, sum(n * gap) / sum(n) AS s, count(*) AS kinds FROM pg GROUP BY 1, 2),
nr AS (SELECT g.*, r.s, r.kinds, row_number() OVER (PARTITION BY g.img, g.colour ORDER BY gap, other) AS k FROM pg g JOIN rw r ON r.img = g.img AND r.colour = g.other), nt AS (SELECT *, sum(gap) OVER (PARTITION BY img, colour) AS total, count(*) OVER (PARTITION BY img, colour) AS size FROM nr WHERE k <= greatest(round_even(kinds * 0.25::DOUBLE, 0), 2)),
sm AS (SELECT img, colour, sum(s * (total - gap)) / max(total * size) AS smooth FROM nt GROUP BY 1, 2), st AS (SELECT img, colour, (smooth - min(smooth) OVER w) / (max(smooth) OVER w - min(smooth) OVER w) AS s FROM sm WINDOW w AS (PARTITION BY img))
SELECT c.img, c.x, c.y, c.colour, round(s, 5) AS saliency FROM cp c JOIN st USING (img, colour)""")
def colour_contrast(spark, d):
    """Contrast of the colour of each cell with all colours of its grid, smoothed over similar colours."""
    c = written(contrast.quantised(colour_grid(spark, d)), "grid-colours")
    return c.join(contrast.colour_contrast(contrast.palette(c)), ["img", "colour"]).select("img", "x", "y", "colour", F.round("saliency", 5).alias("saliency"))


@query(f"""WITH {_px}, {_cg}, {_pal}, sp AS (SELECT *, (y // 4) * 4 + x // 4 AS segment FROM cp), sg AS (SELECT img, segment, count(*) AS n, avg(x) / 16 AS cx, avg(y) / 16 AS cy, avg(abs(x - 8)) / 16 AS ox, avg(abs(y - 8)) / 16 AS oy FROM sp GROUP BY 1, 2),
sc AS (SELECT s.img, s.segment, s.colour, count(*) / any_value(g.n) AS f FROM sp s JOIN sg g USING (img, segment) GROUP BY 1, 2, 3),
pr AS (SELECT a.img, a.segment, b.segment AS t, sum(a.f * b.f * gap) AS dd FROM sc a JOIN sc b ON a.img = b.img AND a.segment != b.segment JOIN pg ON pg.img = a.img AND pg.colour = a.colour AND pg.other = b.colour GROUP BY 1, 2, 3),
sv AS (SELECT p.img, p.segment, sum(t.n * dd * exp(-(pow(s.cx - t.cx, 2) + pow(s.cy - t.cy, 2)) / 0.4)) * exp(-9.0 * (any_value(s.ox) * any_value(s.ox) + any_value(s.oy) * any_value(s.oy))) AS s FROM pr p JOIN sg s USING (img, segment) JOIN sg t ON t.img = p.img AND t.segment = p.t GROUP BY 1, 2)
SELECT img, CAST(segment AS INT) AS segment, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w), 5) AS saliency FROM sv WINDOW w AS (PARTITION BY img)""")
def block_contrast(spark, d):
    """Contrast between blocks of 4 x 4 cells as segments."""
    c = written(contrast.quantised(colour_grid(spark, d)), "grid-colours").withColumn("segment", F.expr("CAST((y div 4) * 4 + x div 4 AS INT)"))
    return contrast.segment_contrast(c, (16, 16)).withColumn("saliency", F.round("saliency", 5))


@query()
def segment_contrast(spark, d):
    """Contrast between the graph segments of each grid; likely background has none."""
    c = written(contrast.quantised(colour_grid(spark, d)), "grid-colours")
    seg = written(learners.segments(c.select("img", "x", "y", ((F.col("r") + F.col("g") + F.col("b")) / 3).alias("v")), "img", 120.0, 4), "grid-segments")
    s = contrast.segment_contrast(c.join(seg, ["img", "x", "y"]), (16, 16))
    back = contrast.border_segments(seg, (16, 16), share=0.1).withColumn("back", F.lit(0.0))
    return s.join(back, ["img", "segment"], "left").select("img", "segment", F.round(F.coalesce("back", "saliency"), 5).alias("saliency"))


_hot = f"{_grid}, ct AS (SELECT img, x, y, v % 3 AS channel, CAST(v AS DOUBLE) AS a FROM gd), ht AS (SELECT img, x, y, sum(a * w) AS heat FROM ct JOIN (VALUES (0, 0.5), (1, 1.25), (2, -0.75)) k(channel, w) USING (channel) GROUP BY 1, 2, 3), tp AS (SELECT img, max(heat) AS top FROM ht GROUP BY img), hm AS (SELECT img, x, y FROM ht JOIN tp USING (img) WHERE heat > 0.9 * top)"


@query(f"""WITH RECURSIVE {_px}, {_hot}, rc AS (SELECT img, x, y, x AS qx, y AS qy FROM hm UNION SELECT r.img, r.x, r.y, h.x, h.y FROM rc r JOIN hm h ON h.img = r.img AND abs(h.x - r.qx) <= 1 AND abs(h.y - r.qy) <= 1),
bl AS (SELECT img, x, y, min(qy * 65536 + qx) AS first FROM rc GROUP BY 1, 2, 3), g AS (SELECT img, first, count(*) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM bl GROUP BY 1, 2)
SELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY n DESC, first) AS INT) AS spot, n, x1, y1, x2, y2 FROM g""")
def activation_spots(spark, d):
    """The separate hot spots of each activation map."""
    c = grid(spark, d).select("img", "x", "y", (F.col("v") % 3).alias("channel"), F.col("v").cast("double").alias("a"))
    return contrast.spots(images.hot_cells(c, spark.createDataFrame([(0, 0.5), (1, 1.25), (2, -0.75)], "channel int, w double"), share=0.9))


# Windows, descriptors, solvers


def face_windows(spark, d):
    """A face of each kind for each grid and for each of four corners."""
    g = grid(spark, d).select("img").distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(11))))
    x, y = F.expr("CAST((ord * 5 + img) % 9 AS INT)"), F.expr("CAST((ord * 7 + img * 3) % 8 AS INT)")
    return g.select("img", "ord", F.expr("CAST(ord % 3 + 1 AS INT)").alias("kind"), x.alias("x1"), y.alias("y1"), (x + 5).alias("x2"), (y + 6).alias("y2"))


@query(f"""WITH {_px}, {_grid}, fw AS (SELECT img, ord, (ord * 5 + img) % 9 AS x, (ord * 7 + img * 3) % 8 AS y FROM (SELECT DISTINCT img FROM gd), range(0, 12) o(ord)),
ct AS (SELECT fw.img, ord, gd.v // 43 AS bin, count(*) AS n FROM fw JOIN gd ON gd.img = fw.img AND gd.x BETWEEN fw.x AND fw.x + 4 AND gd.y BETWEEN fw.y AND fw.y + 5 GROUP BY 1, 2, 3),
sh AS (SELECT img, ord, n / sum(n) OVER (PARTITION BY img, ord) AS p FROM ct) SELECT img, CAST(ord AS INT) AS ord, round(-sum(p * log2(p)), 6) AS entropy FROM sh GROUP BY 1, 2""")
def window_entropies(spark, d):
    """Entropy of the grey levels in windows of the grids, from integral histograms."""
    g = grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v"))
    h = windows.window_histograms(face_windows(spark, d).drop("kind"), windows.integral_histogram(g, "v", (16, 16)), (16, 16))
    return h.select("img", "ord", F.round(V.entropy(F.col("p")), 6).alias("entropy"))


@query()
def searched_faces(spark, d):
    """Borders of faces searched for by the entropy of windows."""
    g = grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v"))
    return windows.searched(face_windows(spark, d), g, "v", (16, 16))


@query()
def global_descriptors(spark, d):
    """Length and largest place of the descriptor of each grid by oriented filters."""
    g = windows.global_descriptors(grid(spark, d).select("img", "x", "y", F.col("v").cast("int").alias("v")), "v", (16, 16))
    return g.select("img", F.size("descriptor").alias("n"), F.round(F.array_max("descriptor"), 4).alias("most"), (F.array_position("descriptor", F.array_max("descriptor")) - 1).alias("place"))


@query(f"""WITH {_px}, {_cg}, hc AS (SELECT img, CAST(greatest(r, g, b) AS DOUBLE) AS t, CAST(least(r, g, b) AS DOUBLE) AS w, r, g, b FROM cg WHERE pow((x - 8) / 2.0, 2) + pow((y - 8) / 5.0, 2) <= 1),
hu AS (SELECT img, t / 255 AS t, w / 255 AS w, CASE WHEN t = w THEN 0 WHEN r = t THEN CASE WHEN g < b THEN 360 + 60 * (g - b) / (t - w) ELSE 60 * (g - b) / (t - w) END WHEN g = t THEN 120 + 60 * (b - r) / (t - w) ELSE 240 + 60 * (r - g) / (t - w) END AS hue FROM hc),
hs AS (SELECT img, hue, (t + w) / 2 AS l, coalesce((t - w) / nullif(CASE WHEN (t + w) / 2 <= 0.5 THEN t + w ELSE 2 - t - w END, 0), 0) AS s FROM hu)
SELECT img, CAST(least(floor(hue / 360 * 16), 15) * 16 + least(floor(s * 4), 3) * 4 + least(floor(l * 4), 3) AS INT) AS bin, count(*) AS n FROM hs GROUP BY 1, 2""")
def ellipse_colour_histogram(spark, d):
    """Histogram of hue, saturation and lightness over the ellipse at the centre of each grid."""
    c = colour_grid(spark, d).where(windows.in_ellipse((16, 16)))
    return c.groupBy("img", P.hsl_bin().alias("bin")).agg(F.count("*").alias("n"))


@query()
def solver_objectives(spark, d):
    """Objective and accuracy of linear and kernel machines that tell even labels from odd ones."""
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("s")).cache()
    right = lambda value: float(v.agg(F.avg(F.when(value * F.col("s") > 0, 1.0).otherwise(0.0))).first()[0] or 0)
    of = lambda w: V.dot(F.col("e"), F.array(*map(F.lit, map(float, w[:-1])))) + float(w[-1])
    rows = []
    w, f = solvers.trust_region(v, "e", "s", "logistic", tolerance=3e-2)
    rows.append(("logistic", round(f, 1), round(right(of(w)), 3)))
    w, primal, _ = solvers.dual_descent(v, "e", "s")
    rows.append(("dual hinge", round(primal, 1), round(right(of(w)), 3)))
    vectors, rho = solvers.kernel_machine(v, "e", "s", gamma=0.5)
    value = solvers.kernel_values(v, "vec_id", "e", vectors, rho, kind="rbf", gamma=0.5)
    kernel = v.join(value, "vec_id").agg(F.avg(F.when(F.col("value") * F.col("s") > 0, 1.0).otherwise(0.0))).first()[0]
    rows.append(("kernel", float(vectors.count()), round(float(kernel or 0), 3)))
    v.unpersist()
    return spark.createDataFrame(rows, "machine string, value double, accuracy double")
