"""Queries over the reference's own operators, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import boxes as B
from lumenframe.functions import pixels as P
from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators import cluster as C
from lumenframe.operators import augment, filters, histograms, labels, matching, ordering, ranking, signatures, statistics
from lumenframe.operators.nms import nms, spatial_peaks
from lumenframe.plans import detection
from lumenframe.session import BOXES_SQL, boxes, scratch, spread, table
from lumenframe.sources import documents as D
from lumenframe.sources import lists as L
from lumenframe.streaming import service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WITH = f"WITH {BOXES_SQL}"
_names = ", ".join(f"({k}, '{v}')" for k, v in detection.NAMES.items())
NAMED = f"{BOXES_SQL}, named AS (SELECT b.*, n.label FROM boxes b JOIN (VALUES {_names}) n(label_id, label) USING (label_id))"
BIG_W, BIG_H = 640, 480


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def iou_duck(a: str, b: str, mode: str) -> str:
    return B.iou_sql(a, b, mode).replace("0.0D", "0.0")


# Detection plan, label statistics, maps


@query(f"""WITH {NAMED}, best AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, ord) AS r FROM named WHERE score >= 0.95
), t AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rank FROM best WHERE r = 1
)
SELECT i.image_id, CAST(coalesce(rank, 1) AS INT) AS rank, coalesce(label, 'other.other') AS label, coalesce(score, 0.0) AS score,
  CAST(coalesce(floor(x1 / 0.5 + 0.5), 0) AS INT) AS x1, CAST(coalesce(floor(y1 / 0.5 + 0.5), 0) AS INT) AS y1,
  CAST(coalesce(floor(x2 / 0.5 + 0.5), 1599) AS INT) AS x2, CAST(coalesce(floor(y2 / 0.5 + 0.5), 1199) AS INT) AS y2
FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN (SELECT * FROM t WHERE rank <= 2) t USING (image_id)""")
def detections_best_per_label(spark, d):
    return detection.best_labels(boxes(spark, d))


@query(f"""WITH {NAMED}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, ord) AS r FROM named)
SELECT image_id, ord, label, score, area FROM (
  SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) * (y2 - y1) DESC, ord, label DESC) AS q FROM b WHERE r = 1) WHERE q = 1""")
def merge_predict_biggest(spark, d):
    return detection.merged_prediction(boxes(spark, d))


@query(f"""WITH {NAMED}, t AS (SELECT count(*) AS n_total, count(DISTINCT image_id) AS n_images FROM named)
SELECT label, count(*) AS n, round(count(*) / max(n_total), 4) AS share, max(n_total) AS n_total, max(n_images) AS n_images, round(max(n_total) / max(n_images), 4) AS labels_per_image FROM named, t GROUP BY label""")
def label_counts_share(spark, d):
    return statistics.label_shares(detection.named(boxes(spark, d)))


@query(f"""{WITH}, g AS (SELECT image_id, count(*) FILTER (label_id IN (1, 2)) AS l, count(*) FILTER (label_id = 3 AND score > 0.99) AS x, count(*) AS n FROM boxes GROUP BY image_id)
SELECT b.* FROM boxes b JOIN g USING (image_id) WHERE NOT (x > 0 OR l > 0.4 * n)""")
def image_reject_by_label_ratio(spark, d):
    b = boxes(spark, d)
    return filters.reject_groups(b, "image_id", F.col("label_id").isin(1, 2), (F.col("label_id") == 3) & (F.col("score") > 0.99)).select(*b.columns)


_map = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.VOC.items()) + ") m(label, mapped)"
_voc = ["cat", "car", "person", "unknown", "dog"]
_voc_case = "CASE label_id " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_voc)) + " END"


def voc_rows(spark, d) -> DataFrame:
    case = F.expr(_voc_case)
    return boxes(spark, d).select("image_id", "ord", case.alias("label"))


@query(f"{WITH}, v AS (SELECT image_id, ord, {_voc_case} AS label FROM boxes) SELECT image_id, ord, mapped AS label FROM v JOIN {_map} USING (label)")
def label_map_inner(spark, d):
    return labels.mapped_inner(voc_rows(spark, d), labels.label_map(spark))


@query(f"{WITH}, v AS (SELECT image_id, ord, {_voc_case} AS label FROM boxes) SELECT image_id, ord, coalesce(mapped, v.label) AS label FROM v LEFT JOIN {_map} ON v.label = m.label")
def label_map_keep(spark, d):
    return labels.mapped_keep(voc_rows(spark, d), labels.label_map(spark)).select("image_id", "ord", "label")


@query(f"""{WITH}, v AS (SELECT image_id * 10 + ord % 10 AS image_id, ord, {_voc_case} AS label FROM boxes), j AS (SELECT v.*, mapped, count(*) FILTER (mapped IS NULL) OVER (PARTITION BY image_id) AS none FROM v LEFT JOIN {_map} USING (label))
SELECT image_id, ord, label, mapped FROM j WHERE none = 0""")
def label_map_all_or_nothing(spark, d):
    v = voc_rows(spark, d).withColumn("image_id", F.expr("image_id * 10 + ord % 10"))
    return filters.all_or_nothing(v, labels.label_map(spark), "image_id", "label").select("image_id", "ord", "label", "mapped")


@query(f"""{WITH}, v AS (SELECT image_id, ord, CASE label_id WHEN 0 THEN 'cat' WHEN 1 THEN 'None' WHEN 2 THEN 'person.other' WHEN 3 THEN 'furniture.diningtable' ELSE 'animal.cow' END AS label FROM boxes)
SELECT image_id, ord, CASE label WHEN 'cat' THEN 'animal.cat' WHEN 'None' THEN 'other.other' WHEN 'furniture.diningtable' THEN 'furniture.table' ELSE label END AS label FROM v WHERE label != 'person.other'""")
def label_repair(spark, d):
    v = boxes(spark, d).select("image_id", "ord", F.expr("CASE label_id WHEN 0 THEN 'cat' WHEN 1 THEN 'None' WHEN 2 THEN 'person.other' WHEN 3 THEN 'furniture.diningtable' ELSE 'animal.cow' END").alias("label"))
    return labels.repaired(v)


_fine = f"SELECT image_id, ord, CAST((image_id + ord) % 73 AS INT) AS fine, score FROM boxes"
_merged = "[" + ", ".join(map(str, labels.MERGED_73)) + "]"
_reach = " OR ".join(f"(fine BETWEEN {a} AND {b} AND score {'>=' if eq else '>'} {low})" for a, b, low, eq in labels.RANGES_73)


def fine_rows(spark, d) -> DataFrame:
    return boxes(spark, d).select("image_id", "ord", F.expr("CAST((image_id + ord) % 73 AS INT)").alias("fine"), "score")


@query(f"{WITH}, f AS ({_fine}) SELECT image_id, ord, fine, score, CASE WHEN {_reach} THEN {_merged}[fine + 1] ELSE 0 END AS coarse FROM f")
def class_merge_thresholds(spark, d):
    return labels.merged_with_ranges(fine_rows(spark, d), spark).select("image_id", "ord", "fine", "score", "coarse")


@query(f"""{WITH}, f AS (SELECT image_id * 1000 + ord AS box, CAST((image_id + ord) % 73 AS INT) AS fine, score, label_id FROM boxes), c AS (SELECT *, CASE WHEN {_reach} THEN {_merged}[fine + 1] ELSE 0 END AS coarse FROM f)
SELECT box, CAST(CASE WHEN coarse = 0 THEN CASE WHEN score >= 0.5 THEN 100 + label_id ELSE 0 END ELSE coarse END AS INT) AS coarse FROM c""")
def fallback_cascade(spark, d):
    """The merged class of each box, or that of a second model where the first says other."""
    box = (F.col("image_id") * 1000 + F.col("ord")).alias("box")
    first = labels.merged_with_ranges(fine_rows(spark, d), spark).select(box, "coarse")
    second = boxes(spark, d).where("score >= 0.5").select(box, (F.col("label_id") + 100).alias("coarse"))
    return labels.cascade(first, second, "box")


_route = "CASE WHEN label_id IN (0, 1) THEN 'quality_people' WHEN label_id = 2 THEN 'quality_goods' WHEN score < 0.2 THEN 'blur' ELSE 'quality_default' END"


@query(f"{WITH}, r AS (SELECT *, {_route} AS model FROM boxes) SELECT model, count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY model")
def route_by_class(spark, d):
    return boxes(spark, d).withColumn("model", F.expr(_route)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""{WITH}, f AS (SELECT image_id, max(CASE WHEN label_id = 0 THEN score ELSE 0 END) AS dup, max(CASE WHEN label_id = 1 THEN score ELSE 0 END) AS qr, max(CASE WHEN label_id = 2 THEN score ELSE 0 END) AS norm, max(CASE WHEN label_id = 3 THEN score ELSE 0 END) AS svm FROM boxes GROUP BY image_id)
SELECT image_id, CASE WHEN dup >= 0.95 THEN 'ads.duplicate' WHEN qr >= 0.9 THEN 'ads.qr' WHEN norm >= 0.9 THEN 'norm' WHEN svm >= 0.5 THEN 'ads.svm' ELSE 'other' END AS verdict FROM f""")
def ads_decision(spark, d):
    score = lambda k: F.max(F.when(F.col("label_id") == k, F.col("score")).otherwise(0.0))
    f = boxes(spark, d).groupBy("image_id").agg(score(0).alias("dup"), score(1).alias("qr"), score(2).alias("norm"), score(3).alias("svm"))
    v = F.when(F.col("dup") >= 0.95, "ads.duplicate").when(F.col("qr") >= 0.9, "ads.qr").when(F.col("norm") >= 0.9, "norm").when(F.col("svm") >= 0.5, "ads.svm").otherwise("other")
    return f.select("image_id", v.alias("verdict"))


# Order as data


@query("""WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, CAST(n AS BIGINT) AS n, CASE WHEN n % 10 = 0 AND o_orderpriority != '1-URGENT' THEN 'test' ELSE 'train' END AS split FROM n""")
def split_every_10th(spark, d):
    n = ordering.row_numbers(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return ordering.every_tenth(n, F.col("o_orderpriority") != "1-URGENT").select("o_orderkey", F.col("n").cast("long").alias("n"), "split")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS t FROM orders)
SELECT o_orderkey, CASE WHEN n <= floor(t * 0.1 + 0.5) THEN 'val' WHEN n <= 2 * floor(t * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS split FROM n""")
def split_prefix_10_10_80(spark, d):
    return ordering.prefix_split(ordering.row_numbers(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])).select("o_orderkey", "split")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def dedup_consecutive(spark, d):
    return ordering.first_of_runs(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["event_id"], "event_type")


@query("""SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS rank FROM events WHERE value >= 20) WHERE rank <= 50""")
def quota_per_label(spark, d):
    e = table(spark, d, "events").where("value >= 20").select("event_id", "event_type")
    return ordering.first_per_label(e, "event_type", ["event_id"], 50)


@query(f"""{WITH}, q AS (SELECT label_id, image_id, row_number() OVER (PARTITION BY label_id ORDER BY image_id, ord) AS r FROM boxes WHERE score >= 0.8),
f AS (SELECT label_id, image_id AS till FROM q WHERE r = 200), e AS (SELECT till FROM (SELECT till, row_number() OVER (ORDER BY till) AS k FROM f) WHERE k = 5)
SELECT DISTINCT image_id FROM boxes LEFT JOIN f USING (label_id) WHERE (till IS NULL OR image_id <= till) AND image_id <= coalesce((SELECT till FROM e), 9223372036854775807)""")
def quota_exact(spark, d):
    g = boxes(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "label_id", "score"))).alias("r"))
    g = g.select("image_id", F.transform("r", lambda x: x["label_id"].cast("string")).alias("labels"), F.transform("r", lambda x: x["score"]).alias("scores"))
    return ordering.quota_sample(g, ["image_id"], "labels", "scores", 200, 0.8, 5)


@query(f"{WITH} SELECT image_id, ord, label_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS r FROM boxes WHERE label_id = 4) WHERE r <= 5")
def first_negatives(spark, d):
    return ordering.first_per_label(boxes(spark, d).where("label_id = 4"), "image_id", ["ord"], 5).select("image_id", "ord", "label_id")


# Geometry


@query(f"{WITH} SELECT * FROM boxes WHERE x2 - x1 >= 60 AND y2 - y1 >= 60 AND x1 >= 0 AND y1 >= 0 AND x2 <= {BIG_W} AND y2 <= {BIG_H} AND x2 - x1 >= 16 AND y2 - y1 >= 16 AND x2 - x1 >= 0.2 * (y2 - y1) AND y2 - y1 >= 0.2 * (x2 - x1)")
def box_filter_aspect(spark, d):
    return boxes(spark, d).where(B.min_side(60)).where(B.sane(BIG_W, BIG_H))


_cl = "greatest(0, least({c}, {m}))"


@query(f"""{WITH}, c AS (SELECT image_id, ord, {_cl.format(c='x1', m=399)} AS x1, {_cl.format(c='y1', m=299)} AS y1, {_cl.format(c='x2', m=399)} AS x2, {_cl.format(c='y2', m=299)} AS y2 FROM boxes)
SELECT * FROM c WHERE x2 - x1 >= 60 AND y2 - y1 >= 60 AND x2 - x1 >= 0.2 * (y2 - y1) AND x2 - x1 <= 5.0 * (y2 - y1)""")
def box_clamp_filter(spark, d):
    return filters.proposals(boxes(spark, d).select("image_id", "ord", *B.SIDES), 400, 300)


@query(f"{WITH} SELECT image_id, ord, CAST(floor(x1 / 0.8 + 0.5) AS INT) AS x1, CAST(floor(y1 / 0.6 + 0.5) AS INT) AS y1, CAST(floor(x2 / 0.8 + 0.5) AS INT) AS x2, CAST(floor(y2 / 0.6 + 0.5) AS INT) AS y2 FROM boxes")
def box_rescale_two_ratios(spark, d):
    return boxes(spark, d).select("image_id", "ord", *B.SIDES).withColumns(B.rescaled(0.8, 0.6))


_delta = {"dx": "(ord % 7 - 3) / 20.0", "dy": "(ord % 5 - 2) / 20.0", "dw": "(ord % 3 - 1) / 4.0", "dh": "(ord % 4 - 2) / 4.0"}


def _decode_sql(lo: str, hi: str, dd: str, ds: str, sign: str, size: int) -> str:
    side = f"({hi} - {lo} + 1.0)"
    return f"CAST(trunc(greatest(least({lo} + 0.5 * {side} + {side} * {dd} {sign} 0.5 * {side} * exp({ds}), {size - 1}), 0)) AS INT)"


@query(f"""{WITH}, r AS (SELECT image_id, ord, x1, y1, x2, y2, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _delta.items())} FROM boxes),
p AS (SELECT image_id, ord, {_decode_sql('x1', 'x2', 'dx', 'dw', '-', BIG_W)} AS x1, {_decode_sql('y1', 'y2', 'dy', 'dh', '-', BIG_H)} AS y1, {_decode_sql('x1', 'x2', 'dx', 'dw', '+', BIG_W)} AS x2, {_decode_sql('y1', 'y2', 'dy', 'dh', '+', BIG_H)} AS y2 FROM r)
SELECT * FROM p WHERE x1 < x2 AND y1 < y2""")
def box_delta_decode(spark, d):
    r = boxes(spark, d).select("image_id", "ord", *B.SIDES, *(F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in _delta.items()))
    return r.select("image_id", "ord", *(v.alias(k) for k, v in B.decoded(BIG_W, BIG_H).items())).where("x1 < x2 AND y1 < y2")


_jit = "SELECT image_id, ord, k, side, x1 - CASE WHEN side = 0 THEN bw ELSE 0 END AS x1, y1 - CASE WHEN side = 1 THEN bh ELSE 0 END AS y1, x2 + CASE WHEN side = 2 THEN bw ELSE 0 END AS x2, y2 + CASE WHEN side = 3 THEN bh ELSE 0 END AS y2 FROM j WHERE CASE side WHEN 0 THEN x1 - bw > 1 WHEN 1 THEN y1 - bh > 1 WHEN 2 THEN x2 + bw < {w} - 1 ELSE y2 + bh < {h} - 1 END".format(w=BIG_W, h=BIG_H)


@query(f"""{WITH}, s AS (SELECT * FROM boxes WHERE x2 <= {BIG_W} AND y2 <= {BIG_H} AND x2 - x1 >= 0.2 * (y2 - y1) AND y2 - y1 >= 0.2 * (x2 - x1)),
k AS (SELECT s.*, CAST(k AS INT) AS k, CAST(side AS INT) AS side FROM s, range(1, 13) a(k), range(0, 4) b(side)),
j AS (SELECT *, CAST(floor((x2 - x1) * k * 25 / 1000.0 + 0.5) AS INT) AS bw, CAST(floor((y2 - y1) * k * 25 / 1000.0 + 0.5) AS INT) AS bh FROM k) {_jit}""")
def box_jitter(spark, d):
    return augment.jittered(boxes(spark, d), BIG_W, BIG_H)


_patch = f"""big AS (SELECT image_id, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) * (y2 - y1) DESC, ord) AS r FROM boxes) WHERE r = 1),
e AS (SELECT *, CAST(trunc(y1 - h * 8 / 10.0) AS INT) AS up, CAST(trunc(y2 + h * 8 / 10.0) AS INT) AS down, CAST(trunc(x1 - w * 8 / 10.0) AS INT) AS le, CAST(trunc(x2 + w * 8 / 10.0) AS INT) AS ri FROM big)
SELECT image_id, 'up' AS side, x1, up AS y1, x2, up + h AS y2 FROM e WHERE up > 0
UNION ALL SELECT image_id, 'down', x1, down - h, x2, down FROM e WHERE down < {BIG_H}
UNION ALL SELECT image_id, 'left', le, y1, le + w, y2 FROM e WHERE le > 0
UNION ALL SELECT image_id, 'right', ri - w, y1, ri, y2 FROM e WHERE ri < {BIG_W}"""


@query(f"{WITH}, {_patch}")
def negative_patches(spark, d):
    return augment.patches(boxes(spark, d), BIG_W, BIG_H)


@query(f"""{WITH}, p AS ({_patch.replace('big AS', 'SELECT * FROM (WITH big AS', 1)})), o AS (
  SELECT p.image_id, p.side, max({iou_duck('p.', 'b.', 'augment')}) AS m FROM p JOIN boxes b USING (image_id) GROUP BY p.image_id, p.side)
SELECT image_id, side FROM o WHERE m < 0.5""")
def negative_patches_clear(spark, d):
    b = boxes(spark, d)
    p = augment.patches(b, BIG_W, BIG_H).withColumn("ord", F.xxhash64("side"))
    return matching.without_overlap(p, b, 0.5, "augment").select("image_id", "side")


_pg = f"{BOXES_SQL}, gt AS (SELECT * FROM boxes WHERE ord % 7 = 0), pred AS (SELECT * FROM boxes WHERE ord % 7 != 0)"


def pred_truth(spark, d) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, d)
    return b.where("ord % 7 != 0"), b.where("ord % 7 = 0")


def _iou_query(mode: str):
    def f(spark, d):
        p, t = pred_truth(spark, d)
        x = matching.pairs(p, t, mode)
        return x.groupBy("image_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum(F.round("iou", 9)), 5).alias("sum_iou"), F.round(F.max("iou"), 6).alias("max_iou"))

    f.__name__ = f"iou_{mode}"
    e = iou_duck("p.", "g.", mode)
    return query(f"WITH {_pg} SELECT p.image_id, count(*) AS n_pairs, round(sum(round({e}, 9)), 5) AS sum_iou, round(max({e}), 6) AS max_iou FROM pred p JOIN gt g USING (image_id) GROUP BY p.image_id")(f)


iou_augment, iou_eval, iou_nms, iou_exact = (_iou_query(m) for m in ("augment", "eval", "nms", "exact"))


@query(f"""WITH RECURSIVE {BOXES_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, label_id ORDER BY score DESC, ord) AS r FROM boxes
), walk(image_id, label_id, r, kept) AS (
  SELECT image_id, label_id, CAST(1 AS BIGINT), [{{'ord': ord, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] FROM r WHERE r = 1
  UNION ALL SELECT w.image_id, w.label_id, r.r, CASE WHEN len(list_filter(w.kept, lambda k: {iou_duck('k.', 'r.', 'nms')} > 0.3)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'ord': r.ord, 'score': r.score, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
  FROM walk w JOIN r ON r.image_id = w.image_id AND r.label_id = w.label_id AND r.r = w.r + 1
), last AS (SELECT image_id, label_id, arg_max(kept, r) AS kept FROM walk GROUP BY image_id, label_id), u AS (SELECT image_id, label_id, unnest(kept) AS k FROM last)
SELECT image_id, label_id, k.ord AS ord, k.score AS score, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM u""")
def nms_greedy(spark, d):
    return nms(boxes(spark, d))


@query(f"""WITH RECURSIVE {BOXES_SQL}, r AS (
  SELECT image_id, ord, score, x1 AS x, y1 AS y, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS r FROM boxes
), walk(image_id, r, kept) AS (
  SELECT image_id, CAST(1 AS BIGINT), [{{'ord': ord, 'score': score, 'x': x, 'y': y}}] FROM r WHERE r = 1
  UNION ALL SELECT w.image_id, r.r, CASE WHEN len(w.kept) >= 10 OR len(list_filter(w.kept, lambda k: abs(k.x - r.x) <= 40 AND abs(k.y - r.y) <= 40)) > 0 THEN w.kept ELSE list_append(w.kept, {{'ord': r.ord, 'score': r.score, 'x': r.x, 'y': r.y}}) END
  FROM walk w JOIN r ON r.image_id = w.image_id AND r.r = w.r + 1
), last AS (SELECT image_id, arg_max(kept, r) AS kept FROM walk GROUP BY image_id), u AS (SELECT image_id, unnest(kept) AS k FROM last)
SELECT image_id, k.ord AS ord, k.x AS x, k.y AS y, k.score AS score FROM u""")
def grid_peaks(spark, d):
    return spatial_peaks(boxes(spark, d).select("image_id", "ord", "score", F.col("x1").alias("x"), F.col("y1").alias("y")), 40, 10)


# Matching


@query(f"""WITH {_pg}, p AS (SELECT p.image_id, p.ord, g.ord AS truth_ord, {iou_duck('p.', 'g.', 'eval')} AS iou FROM pred p JOIN gt g USING (image_id))
SELECT image_id, ord, truth_ord, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ord ORDER BY iou DESC, truth_ord) AS r FROM p) WHERE r = 1""")
def match_best_gt(spark, d):
    return matching.best_truth(*pred_truth(spark, d)).withColumn("iou", F.round("iou", 6))


def _curve_sql(by: str) -> str:
    return f"""WITH {_pg}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rank FROM pred),
p AS (SELECT g.image_id, g.ord, k, max(CASE WHEN rank <= k THEN {iou_duck('r.', 'g.', 'eval')} END) AS best FROM gt g LEFT JOIN r USING (image_id) CROSS JOIN (VALUES (1), (5), (20)) s(k) GROUP BY g.image_id, g.ord, k)
SELECT {by} k, round(avg(CASE WHEN coalesce(best, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(best, 0)), 6) AS mean_best, count(*) AS n_truth FROM p JOIN gt USING (image_id, ord) GROUP BY {by} k"""


def _curve(spark, d, by):
    p, t = pred_truth(spark, d)
    out = matching.recall_curve(matching.anti_first(p), t, [1, 5, 20], by=by)
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "mean_best")})


@query(_curve_sql(""))
def recall_at_k(spark, d):
    return _curve(spark, d, ())


@query(_curve_sql("label_id,"))
def class_recall(spark, d):
    return _curve(spark, d, ("label_id",))


@query(f"WITH {_pg} SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.image_id = p.image_id AND {iou_duck('p.', 'g.', 'eval')} >= 0.1)")
def anti_overlap(spark, d):
    p, t = pred_truth(spark, d)
    return matching.without_overlap(p, t, 0.1, "eval").select(*p.columns)


@query(f"{WITH} SELECT * FROM boxes a WHERE EXISTS (SELECT 1 FROM boxes b WHERE a.image_id = b.image_id AND a.ord != b.ord AND {iou_duck('a.', 'b.', 'eval')} >= 0.4)")
def semi_support(spark, d):
    b = boxes(spark, d)
    return matching.with_support(b, b, 0.4).select(*b.columns)


@query(f"{WITH} SELECT a.* FROM boxes a WHERE (SELECT count(*) FROM boxes b WHERE a.image_id = b.image_id AND a.ord != b.ord AND {iou_duck('a.', 'b.', 'eval')} >= 0.3) >= 2")
def second_best_confirm(spark, d):
    b = boxes(spark, d)
    return matching.with_support(b, b, 0.3, 2).select(*b.columns)


@query(f"{WITH}, x AS (SELECT DISTINCT image_id, label_id FROM boxes) SELECT a.label_id AS i, b.label_id AS j, count(*) AS n FROM x a JOIN x b ON a.image_id = b.image_id AND a.label_id < b.label_id GROUP BY 1, 2")
def label_cooccurrence(spark, d):
    return matching.cooccurrence(boxes(spark, d), "image_id", "label_id")


# Vectors

_vec = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def _vector_query(name: str, f, sql: str):
    def q(spark, d):
        v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
        n = f(F.col("e"))
        return v.select("vec_id", F.round(n[0], 6).alias("first"), F.round(V.total(n), 6).alias("total"), F.round(F.array_max(n), 6).alias("top"))

    q.__name__ = name
    return query(f"WITH {_vec}, n AS (SELECT vec_id, {sql} AS n FROM v) SELECT vec_id, round(n[1], 6) AS first, round(list_sum(n), 6) AS total, round(list_max(n), 6) AS top FROM n")(q)


vec_l2norm = _vector_query("vec_l2norm", V.l2_normalised, "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))")
vec_l1norm = _vector_query("vec_l1norm", V.l1_normalised, "list_transform(e, lambda x: x / list_sum(list_transform(e, lambda y: abs(y))))")
vec_minmax = _vector_query("vec_minmax", V.min_max_normalised, "list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e)))")
vec_softmax = _vector_query("vec_softmax", V.softmax, "list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))")


@query(f"WITH {_vec}, n AS (SELECT vec_id, list_transform(e, lambda x: abs(x) / sqrt(list_dot_product(e, e))) AS n FROM v) SELECT vec_id, round(-list_sum(list_transform(n, lambda p: CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)), 6) AS entropy FROM n")
def vec_entropy(spark, d):
    n = V.l2_normalised(F.transform(V.doubles("embedding"), F.abs))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.entropy(n), 6).alias("entropy"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings)
SELECT vec_id, CAST(idx AS INT) AS idx, CAST(r AS INT) AS rank, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx) AS r FROM u) WHERE r <= 5 AND v > 0""")
def vec_argmax_topk(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.ranked(F.col("embedding"), 5)).alias("r", "x"))
    return t.where("x.value > 0").select("vec_id", "x.idx", (F.col("r") + 1).alias("rank"), F.round(F.col("x.value").cast("double"), 6).alias("value"))


_W = [[((i * 7 + c * 3) % 11 - 5) / 10 for i in range(64)] for c in range(6)]
_BIAS = [c / 20 for c in range(6)]


@query(f"""WITH {_vec}, s AS (SELECT vec_id, c - 1 AS cls, list_dot_product(e, w) + (c - 1) / 20 AS s FROM v, (SELECT unnest({_W!r}) AS w, generate_subscripts({_W!r}, 1) AS c))
SELECT vec_id, CAST(r AS INT) AS rank, CAST(cls AS INT) AS cls, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS r FROM s) WHERE r <= 3""")
def linear_score_top3(spark, d):
    t = C.linear_scores(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _W, _BIAS)
    return t.select("vec_id", F.posexplode("best").alias("r", "x")).select("vec_id", (F.col("r") + 1).alias("rank"), F.col("x.idx").alias("cls"), F.round("x.value", 6).alias("score"))


@query(f"""WITH {_vec}, c AS (SELECT vec_id, list_transform(e, lambda x: x - 0.01) AS e FROM v)
SELECT vec_id, round(list_dot_product(e, {_W[0]!r}), 6) AS c0, round(list_dot_product(e, {_W[1]!r}), 6) AS c1, round(list_dot_product(e, {_W[2]!r}), 6) AS c2 FROM c""")
def pca_encode(spark, d):
    t = C.pca_encoded(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", [0.01] * 64, _W[:3])
    return t.select("vec_id", *(F.round(F.col("code")[i], 6).alias(f"c{i}") for i in range(3)))


@query(f"""WITH {_vec}, s AS (SELECT vec_id, c - 1 AS cluster, list_sum(list_transform(list_zip(e, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dd FROM v, (SELECT unnest({_W!r}) AS w, generate_subscripts({_W!r}, 1) AS c))
SELECT vec_id, CAST(cluster AS INT) AS cluster, round(dd, 6) AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, cluster) AS r FROM s) WHERE r = 1""")
def kmeans_assign(spark, d):
    return C.nearest_centre(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _W).select("vec_id", "cluster", F.round("distance2", 6).alias("distance2"))


_ref = repr([round(((i * 5) % 9 - 4) / 16, 6) for i in range(64)])


@query(f"""WITH {_vec}, p AS (SELECT vec_id, list_zip(e, {_ref}) AS z, e FROM v), g AS (SELECT vec_id, z, e, list_transform(z, lambda q: abs(q[1] - q[2])) AS g FROM p)
SELECT vec_id, round(sqrt(list_sum(list_transform(g, lambda x: x * x))), 6) AS euclidean, round(list_sum(list_transform(g, lambda x: x * x)), 6) AS sqeuclidean, round(list_sum(g), 6) AS cityblock, round(list_max(g), 6) AS chebyshev,
  round(1 - list_dot_product(e, {_ref}) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product({_ref}, {_ref}))), 6) AS cosine,
  round(list_sum(list_transform(z, lambda q: CASE WHEN abs(q[1]) + abs(q[2]) > 0 THEN abs(q[1] - q[2]) / (abs(q[1]) + abs(q[2])) ELSE 0 END)), 6) AS canberra,
  round(list_sum(g) / list_sum(list_transform(z, lambda q: abs(q[1] + q[2]))), 6) AS braycurtis,
  round(list_sum(list_transform(z, lambda q: CASE WHEN q[1] != q[2] THEN 1.0 ELSE 0.0 END)) / 64, 6) AS hamming,
  round(list_sum(list_transform(z, lambda q: CASE WHEN q[1] != q[2] AND (q[1] != 0 OR q[2] != 0) THEN 1.0 ELSE 0.0 END)) / list_sum(list_transform(z, lambda q: CASE WHEN q[1] != 0 OR q[2] != 0 THEN 1.0 ELSE 0.0 END)), 6) AS jaccard FROM g""")
def distance_metrics(spark, d):
    ref = F.array(*(F.lit(float(x)) for x in eval(_ref, {})))
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    return v.select("vec_id", *(F.round(x, 6).alias(k) for k, x in V.distances(F.col("e"), ref).items()))


# Signatures

_codes = "codes AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(greatest(1, least(127, floor((CAST(v AS DOUBLE) + 1) * 64))) AS INT)) AS feat FROM embeddings)"


def codes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.greatest(F.lit(1), F.least(F.lit(127), F.floor((v.cast("double") + 1) * 64))).cast("int")).alias("feat"))


_code_sql = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(feat[1:{dims}], lambda x: CAST(x >> 5 AS BIGINT))), lambda c, x: ((c << 1) | x) & 4294967295)"


@query(f"WITH {_codes} SELECT id, {_code_sql.replace('{dims}', '32')} AS code FROM codes")
def signature_code(spark, d):
    return codes(spark, d).select("id", signatures.code().alias("code"))


def scan_sql(bucket: str, partial: int = 24, total: int = 420) -> str:
    """A recursive scan of c (bucket columns, id, feat) in order of id: m is the first kept row that a row resembles, or null where it is kept."""
    gap = "list_transform(list_zip(x.feat, c.feat), lambda z: abs(z[1] - z[2]))"
    on = " AND ".join(f"r.{k} = c.{k}" for k in bucket.split(", "))
    return f"""c AS (SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY id) AS n FROM c0),
r AS (SELECT DISTINCT {bucket}, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, feat INT[])[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS m FROM c
UNION ALL SELECT {', '.join(f'c.{k}' for k in bucket.split(', '))}, c.n, CASE WHEN len(near) = 0 THEN list_append(kept, {{'id': c.id, 'feat': c.feat}}) ELSE kept END, c.id, CASE WHEN len(near) > 0 THEN near[1].id END
  FROM (SELECT r.*, c.id AS own, list_filter(r.kept, lambda x: list_max({gap}) <= {partial} AND list_sum({gap}) <= {total}) AS near FROM r JOIN c ON {on} AND c.n = r.n + 1) r JOIN c ON {on} AND c.n = r.n + 1)"""


@query(f"""WITH RECURSIVE {_codes}, c0 AS (SELECT CAST(id AS BIGINT) AS id, feat, {_code_sql.replace('{dims}', '6')} AS code FROM codes), {scan_sql('code')} SELECT id, m AS duplicate_of FROM r WHERE m IS NOT NULL""")
def near_duplicate_signatures(spark, d):
    return signatures.near_duplicates(codes(spark, d), 24, 420, 6)


@query(f"""{WITH}, q AS (SELECT image_id, max(CASE WHEN ord = 1 THEN CAST(score * 1000 AS INT) % 5 END) AS q1, max(CASE WHEN ord = 2 THEN CAST(score * 1000 AS INT) % 5 END) AS q2 FROM boxes GROUP BY image_id)
SELECT image_id, CASE WHEN q1 <= 0 OR q2 <= 0 THEN 0 WHEN q2 > q1 THEN 2 ELSE 1 END AS better FROM q WHERE q1 IS NOT NULL AND q2 IS NOT NULL""")
def dup_quality_choice(spark, d):
    q = lambda o: F.max(F.when(F.col("ord") == o, F.round(F.col("score") * 1000).cast("int") % 5))
    x = boxes(spark, d).groupBy("image_id").agg(q(1).alias("q1"), q(2).alias("q2")).where("q1 IS NOT NULL AND q2 IS NOT NULL")
    return x.select("image_id", signatures.better_copy("q1", "q2").alias("better"))


# Tags, text, logs

_tags = "tags AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS ord FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]'), lambda x: x != '') AS t FROM documents))"


def tags(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens("text")).alias("ord", "word"))


@query(f"""WITH {_tags}, k(tag, keyword, label_id) AS (VALUES ('the', 'article', 1), ('and', 'conjunction', 2), ('der', 'article', 1), ('le', 'article', 1), ('los', 'article', 1))
SELECT label_id, keyword, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tags JOIN k ON word = tag GROUP BY 1, 2""")
def tag_join_unique(spark, d):
    k = spark.createDataFrame([("1;article;the,der,le,los",), ("2;conjunction;and",)], "value string")
    k = L.keyword_map(k)
    if labels.checked_dictionary(k, "tag").take(1):
        raise ValueError("a tag names two keywords")
    x = tags(spark, d).join(F.broadcast(k), F.col("word") == F.col("tag"))
    return x.groupBy("label_id", "keyword").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""{WITH.replace('WITH ', 'WITH ')}, f AS (SELECT image_id, label_id, min(ord) AS o FROM boxes GROUP BY 1, 2)
SELECT image_id, CAST(image_id AS VARCHAR) || '.jpg,' || string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY o) AS line FROM f GROUP BY image_id""")
def label_set_line(spark, d):
    return L.label_set_lines(boxes(spark, d), "image_id", "ord", "label_id")


@query("""SELECT doc_id % 4 AS part, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality != 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic != 0) AS fn, count(*) FILTER (quality != 1 AND toxic != 0) AS tn,
  round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS precision FROM labels GROUP BY 1""")
def confusion_metrics(spark, d):
    x = table(spark, d, "labels").withColumn("part", F.col("doc_id") % 4)
    return statistics.confusion(x, F.col("quality") == 1, F.col("toxic") == 0, ("part",))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file_name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS category,
  regexp_replace(url, '[^a-zA-Z0-9 .]', '', 'g') AS plain, replace(url, '/', '_') AS flat FROM pages""")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in T.path_parts("url").items()), T.plain("url").alias("plain"), T.underscored("url").alias("flat"))


_csv = "CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || ',http://a/' || o_custkey WHEN 1 THEN o_orderkey || ',x,http://b/' || o_custkey WHEN 2 THEN '' ELSE o_orderkey || ',1,2,3,4' END"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'http://a/' || o_custkey ELSE 'http://b/' || o_custkey END AS url FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def csv_width_dispatch(spark, d):
    return L.id_url(table(spark, d, "orders").select(F.expr(_csv).alias("value")))


@query(f"{WITH} SELECT image_id, label_id || '' AS label, round(score, 4) AS score, x1, y1, x2, y2, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INT) AS k FROM boxes")
def audit_log_round_trip(spark, d):
    w = Window.partitionBy("image_id").orderBy("ord")
    b = boxes(spark, d).select("image_id", F.lit(1).alias("child_id"), F.lit("u").alias("url"), F.col("label_id").cast("string").alias("label"), "score", *B.SIDES, (F.row_number().over(w) - 1).alias("k"))
    lines = L.audit_lines(b).select(F.concat(F.lit("a b c d e "), "line").alias("value"))
    return L.detection_log(lines).select("image_id", "label", F.round("score", 4).alias("score"), *B.SIDES, "k")


@query(f"""{WITH} SELECT image_id, image_id || chr(10) || count(*) || chr(10) || string_agg(x1 || ' ' || y1 || ' ' || (x2 - x1) || ' ' || (y2 - y1) || ' ' || printf('%.6f', score), chr(10) ORDER BY score DESC, ord) AS block FROM boxes GROUP BY image_id""")
def fddb_blocks(spark, d):
    return L.fddb_lines(boxes(spark, d))


@query("""WITH u AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, label || ' ' || string_agg(i || ':' || printf('%.4f', CAST(v AS DOUBLE)), ' ' ORDER BY i) AS line FROM u GROUP BY vec_id, label""")
def libsvm_sink_lines(spark, d):
    return L.libsvm_lines(table(spark, d, "embeddings"), "label", "embedding").select("vec_id", "line")


@query(f"""{WITH} SELECT image_id, image_id || chr(9) || '640' || chr(9) || '480' || chr(9) || count(*) || chr(9) || string_agg(label_id || ',' || printf('%.4f', score) || ',' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ',' || printf('%.4f', ((20000 * (x2 - x1) * (y2 - y1) + 307200) // 614400) / 10000.0) || ';', '' ORDER BY ord) AS line FROM boxes GROUP BY image_id""")
def area_share_lines(spark, d):
    return L.area_lines(boxes(spark, d).withColumn("label", F.col("label_id").cast("string")), BIG_W, BIG_H)


@query(f"WITH {NAMED} SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS ord, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM named GROUP BY label")
def dictionary_report(spark, d):
    return L.dictionary_report(detection.named(boxes(spark, d)), "label")


def voc_read_back(b: DataFrame) -> DataFrame:
    """Boxes written as VOC files and read again."""
    rows = b.select(F.col("image_id").cast("string").alias("image"), "ord", F.col("label_id").cast("string").alias("label"), *B.SIDES)
    back = D.voc_xml(rows).select(F.from_xml("xml", D.VOC, {"rowTag": "annotation"}).alias("d")).select("d.*")
    return D.voc_rows(back).drop("has_size")


@query(f"""{WITH}, i AS (SELECT image_id AS i, ord, label_id, x1, y1, x2, y2 FROM boxes) SELECT i || '' AS image, CAST(row_number() OVER (PARTITION BY i ORDER BY ord) - 1 AS INT) AS ord, label_id || '' AS label,
  greatest(x1, 1) AS x1, greatest(y1, 1) AS y1, greatest(x2, 1) AS x2, greatest(y2, 1) AS y2 FROM i""")
def voc_round_trip(spark, d):
    return voc_read_back(boxes(spark, d))


@query("SELECT event_id || '' AS id, 'http://x/' || user_id AS url FROM events WHERE event_id % 3 = 0")
def poll_responses(spark, d):
    body = F.format_string('{"succ":"%s","data":[{"id":"%d","url":"http://x/%d"}]}', F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), "event_id", "user_id")
    return D.poll_rows(table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 1, F.lit("{broken")).otherwise(body).alias("value")))


# Histograms; pixels are the prices of a brand's parts


def pixel_rows(spark, d) -> DataFrame:
    p = table(spark, d, "lineitem")
    return p.select((F.col("l_suppkey") % 20).cast("int").alias("img"), F.expr("CAST(l_orderkey % 256 AS INT)").alias("r"), F.expr("CAST((l_partkey * 3) % 256 AS INT)").alias("g"), F.expr("CAST((l_orderkey + l_partkey) % 256 AS INT)").alias("b"))


_px = "px AS (SELECT CAST(l_suppkey % 20 AS INT) AS img, CAST(l_orderkey % 256 AS INT) AS r, CAST((l_partkey * 3) % 256 AS INT) AS g, CAST((l_orderkey + l_partkey) % 256 AS INT) AS b FROM lineitem), gr AS (SELECT img, (r * 38 + g * 75 + b * 15) >> 7 AS v FROM px), h AS (SELECT img, v AS bin, count(*) AS n FROM gr GROUP BY 1, 2)"


def grey_histogram(spark, d) -> DataFrame:
    return histograms.histogram(pixel_rows(spark, d).select("img", P.grey_shift().alias("v")), "img", "v")


@query(f"WITH {_px}, p AS (SELECT img, n / sum(n) OVER (PARTITION BY img) AS p FROM h) SELECT img, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY img")
def histogram_entropy(spark, d):
    return histograms.entropy(grey_histogram(spark, d), "img").withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {_px} SELECT img, bin, CAST(floor(255 * sum(n) OVER (PARTITION BY img ORDER BY bin) / sum(n) OVER (PARTITION BY img) + 0.5) AS BIGINT) AS level FROM h")
def histogram_cdf_equalise(spark, d):
    return histograms.equalised(grey_histogram(spark, d), "img")


@query(f"""WITH {_px}, c AS (SELECT img, bin, CAST(sum(n) OVER w AS DOUBLE) AS w, CAST(sum(bin * n) OVER w AS DOUBLE) AS u, CAST(sum(n) OVER (PARTITION BY img) AS DOUBLE) AS t, CAST(sum(bin * n) OVER (PARTITION BY img) AS DOUBLE) AS m FROM h WINDOW w AS (PARTITION BY img ORDER BY bin)),
v AS (SELECT img, bin, round((m * w - u * t) * (m * w - u * t) / (w * (t - w)), 3) AS v FROM c WHERE w < t)
SELECT img, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, bin) AS r FROM v) WHERE r = 1""")
def otsu(spark, d):
    return histograms.otsu(grey_histogram(spark, d), "img")


@query(f"""WITH {_px}, c AS (SELECT a.img, a.bin, sum(abs(a.bin - b.bin) * b.n) AS d FROM h a JOIN h b USING (img) GROUP BY 1, 2),
s AS (SELECT img, bin, round(255.0 * (d - min(d) OVER (PARTITION BY img)) / nullif(max(d) OVER (PARTITION BY img) - min(d) OVER (PARTITION BY img), 0), 6) AS s FROM c)
SELECT img, bin, s AS saliency, s >= 200 AS salient FROM s""")
def saliency_contrast(spark, d):
    return histograms.contrast(grey_histogram(spark, d), "img")


@query(f"""WITH {_px}, q AS (SELECT img, r >> 6 AS r6, g >> 6 AS g6, b >> 6 AS b6, count(*) AS n FROM px GROUP BY 1, 2, 3, 4)
SELECT img, r6, g6, b6, n, share, CAST(k AS INT) AS rank FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY img), 6) AS share, row_number() OVER (PARTITION BY img ORDER BY n DESC, r6, g6, b6) AS k FROM q) WHERE k <= 2""")
def joint_histogram_top2(spark, d):
    q = pixel_rows(spark, d).select("img", *(F.shiftright(c, 6).alias(f"{c}6") for c in ("r", "g", "b")))
    return histograms.top_bins(q, "img", ["r6", "g6", "b6"])


@query(f"WITH {_px}, w AS (SELECT img, max(r) - min(r) AS r, max(g) - min(g) AS g, max(b) - min(b) AS b FROM px GROUP BY img) SELECT img, CASE WHEN r >= g AND r >= b THEN 'r' WHEN g >= b THEN 'g' ELSE 'b' END AS channel, greatest(r, g, b) AS range FROM w")
def widest_channel(spark, d):
    return histograms.widest_channel(pixel_rows(spark, d), "img", ["r", "g", "b"])


@query(f"""WITH {_px} SELECT img, count(*) AS n, count(*) FILTER ((r > 95 AND g > 40 AND b > 20 AND r - b > 15 AND r - g > 15) OR (r > 200 AND g > 210 AND b > 170 AND abs(r - b) <= 15 AND b < r AND b < g)) AS skin,
  CAST(sum((r * 30 + g * 59 + b * 11 + 50) // 100) AS BIGINT) AS grey, CAST(sum(((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3)) AS BIGINT) AS packed FROM px GROUP BY img""")
def skin_and_grey(spark, d):
    return pixel_rows(spark, d).groupBy("img").agg(F.count("*").alias("n"), F.count_if(P.skin_rgb()).alias("skin"), F.sum(P.grey_percent()).alias("grey"), F.sum(P.rgb565()).cast("long").alias("packed"))


# Groups, fusion, disagreement


@query(f"""WITH {NAMED}, c AS (SELECT image_id, label, CASE WHEN contains(label, 'person') THEN 'person' WHEN contains(label, 'animal') THEN 'animal' WHEN contains(label, 'vehicle') THEN 'vehicle' ELSE 'goods' END AS coarse FROM named WHERE score >= 0.98),
g AS (SELECT image_id, count(*) AS n, count(DISTINCT coarse) AS k FROM c GROUP BY image_id)
SELECT count(*) FILTER (n > 1) AS several, count(*) FILTER (n > 1 AND k > 1) AS differ, round(count(*) FILTER (n > 1 AND k > 1) / nullif(count(*) FILTER (n > 1), 0), 6) AS rate FROM g""")
def coarse_class_disagreement(spark, d):
    names = ["person", "animal", "vehicle"]
    coarse = F.lit("goods")
    for n in reversed(names):
        coarse = F.when(F.contains("label", F.lit(n)), n).otherwise(coarse)
    g = detection.named(boxes(spark, d), 0.98).groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct(coarse).alias("k"))
    several, differ = F.count_if(F.col("n") > 1), F.count_if((F.col("n") > 1) & (F.col("k") > 1))
    return g.agg(several.alias("several"), differ.alias("differ"), F.round(differ / F.nullif(several, F.lit(0)), 6).alias("rate"))


@query(f"""{WITH}, k AS (SELECT CASE WHEN label_id = 4 THEN 'other' WHEN label_id IN (0, 1) THEN 'generic' ELSE 'specific' END AS kind FROM boxes), c AS (SELECT kind, count(*) AS n FROM k GROUP BY kind)
SELECT kind, n, round(100.0 * n / CASE WHEN kind = 'other' THEN (SELECT sum(n) FROM c) ELSE (SELECT sum(n) FROM c WHERE kind != 'other') END, 4) AS percent FROM c""")
def result_tally(spark, d):
    kind = F.expr("CASE WHEN label_id = 4 THEN 'other' WHEN label_id IN (0, 1) THEN 'generic' ELSE 'specific' END")
    c = boxes(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("kind") != "other", F.col("n"))).alias("named"))
    return c.crossJoin(F.broadcast(t)).select("kind", "n", F.round(100.0 * F.col("n") / F.when(F.col("kind") == "other", F.col("all")).otherwise(F.col("named")), 4).alias("percent"))


@query(f"""{WITH}, f AS (SELECT image_id, ord, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS e, score FROM boxes),
n AS (SELECT image_id, ord, e / sqrt(sum(e * e) OVER w) AS e, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS s FROM f WINDOW w AS (PARTITION BY image_id)),
z AS (SELECT image_id, ord, round(e * s, 6) AS fused FROM n)
SELECT image_id, ord, fused, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fused DESC, ord) AS r FROM z) WHERE r <= 5""")
def score_fusion_top5(spark, d):
    w = Window.partitionBy("image_id")
    f = boxes(spark, d).select("image_id", "ord", F.expr("CAST((x2 - x1) * (y2 - y1) AS DOUBLE)").alias("e"), "score")
    low, high = F.min("score").over(w), F.max("score").over(w)
    s = F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    f = f.select("image_id", "ord", F.round(F.col("e") / F.sqrt(F.sum(F.col("e") * F.col("e")).over(w)) * s, 6).alias("score"))
    return ranking.top(f, 5).select("image_id", "ord", F.col("score").alias("fused"), "rank")


@query(f"""{WITH}, s AS (SELECT image_id, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM boxes)
SELECT image_id, round(avg(w), 6) AS w_mean, round(stddev_pop(w), 6) AS w_sd, round(stddev_pop(w) / avg(w), 6) AS w_cv, round(avg(h), 6) AS h_mean, round(stddev_pop(h), 6) AS h_sd, round(stddev_pop(h) / avg(h), 6) AS h_cv FROM s GROUP BY image_id""")
def group_feature_stats(spark, d):
    s = boxes(spark, d).select("image_id", F.expr("CAST(x2 - x1 AS DOUBLE)").alias("w"), F.expr("CAST(y2 - y1 AS DOUBLE)").alias("h"))
    return statistics.group_features(s, "image_id", ["w", "h"])


@query(f"{WITH} SELECT image_id, count(*) AS n FROM boxes GROUP BY image_id HAVING stddev_pop(x2 - x1) <= 0.5 * avg(x2 - x1)")
def steady_groups(spark, d):
    """Widths are whole numbers, so groups at the limit are told exactly."""
    b = boxes(spark, d).select("image_id", (F.col("x2") - F.col("x1")).alias("w"))
    return filters.steady_groups(b, "image_id", "w").select("image_id", "n")


@query(f"{WITH} SELECT image_id, CAST(arg_max(ord, (x2 - x1) * (y2 - y1) * 10000 - ord) AS BIGINT) AS ord, max((x2 - x1) * (y2 - y1)) AS area FROM boxes GROUP BY image_id")
def max_area_element(spark, d):
    return ranking.largest(boxes(spark, d))


@query(f"{WITH}, i AS (SELECT image_id * 40 + ord AS image_id, label_id, x1, y1, x2, y2 FROM boxes) SELECT image_id, min(label_id) AS label_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM i GROUP BY image_id HAVING count(*) = 1 AND min(x2) - min(x1) >= 192 AND min(y2) - min(y1) >= 144")
def single_object_images(spark, d):
    b = boxes(spark, d).withColumn("image_id", F.col("image_id") * 40 + F.col("ord"))
    one = filters.single_object(b, "image_id", BIG_W, BIG_H).where("x2 - x1 >= 192 AND y2 - y1 >= 144")
    return one


@query("WITH s AS (SELECT label, sum(list_dot_product(embedding, embedding)) + label AS v FROM embeddings GROUP BY label), w AS (SELECT row_number() OVER (ORDER BY v DESC, label) AS k, sum(v) OVER (ORDER BY v DESC, label) AS u, sum(v) OVER () AS a FROM s) SELECT CAST(least(coalesce(min(k) FILTER (u > 0.9 * a), 1000), 1000) AS INT) AS k FROM w")
def variance_cut(spark, d):
    v = table(spark, d, "embeddings").groupBy("label").agg((F.sum(V.dot(V.doubles("embedding"), V.doubles("embedding"))) + F.first("label")).alias("v"))
    return statistics.variance_cut(v, "label", "v")


# Clusters and streams


@query()
def agglomerative_clusters(spark, d):
    b = boxes(spark, d).select("image_id", "ord", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return C.agglomerative(b, "image_id", "ord", ["cx", "cy"], "average")


@query()
def connected_components(spark, d):
    """Components of orders (even nodes, twice the key) and parts (odd nodes) over all line items."""
    e = spread(table(spark, d, "lineitem")).select(F.expr("2 * l_orderkey").alias("a"), F.expr("2 * l_partkey + 1").alias("b")).distinct()
    return C.components(e)


def event_stream(spark, d) -> DataFrame:
    """Events as a stream; a single file is named by a pattern that fits it alone."""
    path = f"{d}/events.parquet"
    return service.poll_stream(spark, f"{d}/event[s].parquet" if _is_file(spark, path) else path, table(spark, d, "events").schema)


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("SELECT event_id, user_id, CASE WHEN value >= 50 THEN event_type ELSE 'null' END AS label, CASE WHEN value >= 50 THEN value ELSE -1.0 END AS score FROM events")
def stream_label_microbatch(spark, d):
    items = event_stream(spark, d).select("event_id", "user_id", "event_type", "value")
    out = service.label_stream(items, F.col("event_type"), F.col("value"), 50.0).select("event_id", "user_id", "label", "score")
    return service.run_to_end(out, scratch(spark, "stream"), scratch(spark, "stream-state"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Insert-if-new with a watermark, which is longer here than the events span: state of older keys is dropped."""
    out = service.first_of_each(event_stream(spark, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "10000 days").select("user_id", "event_type")
    return service.run_to_end(out, scratch(spark, "stream"), scratch(spark, "stream-state"))
