"""Further queries: sources, stores, layers, faces, images, merges, distances and learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import boxes as B
from lumenframe.functions import layers as Y
from lumenframe.functions import pixels as P
from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators import augment, faces, filters, histograms, images, labels, learners, matching, ordering, ranking, regions, signatures
from lumenframe.operators import cluster as C
from lumenframe.plans import detection
from lumenframe.queries import BIG_H, BIG_W, BOXES_SQL, NAMED, WITH, _code_sql, _codes, _decode_sql, _delta, _px, _vec, boxes, codes, iou_duck, pixel_rows, query, scan_sql
from lumenframe.session import scratch, table
from lumenframe.sources import lists as L
from lumenframe.sources import models, stores
from lumenframe.streaming import service

# Sources and sinks


@query("SELECT label, CAST(p AS INT) AS ord, path FROM (SELECT o_orderkey % 3 AS label, 0 AS p, 'a/' || o_orderkey || '.jpg' AS path FROM orders UNION ALL SELECT o_orderkey % 3, 1, 'b/' || o_custkey || '.jpg' FROM orders)")
def path_list_tokens(spark, d):
    """Lists of two paths to a line, with a label as the name of the file."""
    lines = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("file"), F.lit(0).alias("ord"), F.format_string("a/%d.jpg \t b/%d.jpg\r", "o_orderkey", "o_custkey").alias("value"))
    return L.path_list(lines).select(F.col("file").alias("label"), F.col("sub").alias("ord"), "path")


@query("SELECT 'img/' || o_orderkey || '.jpg' AS path, CAST(o_custkey % 7 AS INT) AS label FROM orders WHERE o_orderkey % 5 != 0")
def labelled_list_lines(spark, d):
    value = F.when(F.col("o_orderkey") % 5 == 0, F.lit("alone")).otherwise(F.format_string("img/%d.jpg %dx", "o_orderkey", F.col("o_custkey") % 7))
    return L.labelled_list(table(spark, d, "orders").select(F.lit("f").alias("file"), F.lit(0).alias("ord"), value.alias("value"))).select("path", "label")


@query("SELECT count(DISTINCT page_id) AS n_pages, count(*) AS n, count(DISTINCT url) AS n_ids FROM pages")
def url_only_ids(spark, d):
    """Ids made from urls: as many as there are different urls."""
    u = L.url_only(table(spark, d, "pages").select(F.col("url").alias("value")))
    return u.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).crossJoin(table(spark, d, "pages").agg(F.count_distinct("page_id").alias("n_pages"))).select("n_pages", "n", "n_ids")


@query("SELECT url, 'l' || page_id % 3 AS label, CAST(page_id % 10 AS DOUBLE) / 10 AS score FROM pages WHERE page_id % 7 NOT IN (0, 3)")
def url_label_score_lines(spark, d):
    tail = F.format_string("%s,l%d,%.1f", "url", F.col("page_id") % 3, F.col("page_id") % 10 / 10)
    k = F.col("page_id") % 7
    value = F.when(k == 0, F.format_string("%s,l1,-0.5", "url")).when(k == 3, F.lit("")).when(k == 5, F.concat(F.lit("x,"), tail)).otherwise(tail)
    return L.url_label_score(table(spark, d, "pages").select(value.alias("value")))


@query("SELECT page_id AS id, url, CASE page_id % 2 WHEN 0 THEN 'fixed' ELSE 'own' END AS label, CAST(page_id % 10 AS DOUBLE) / 10 AS score FROM pages")
def id_url_score_lines(spark, d):
    s = F.col("page_id") % 10 / 10
    value = F.when(F.col("page_id") % 2 == 0, F.format_string("%d,%s,%.1f", "page_id", "url", s)).otherwise(F.format_string("%d,%.1f,%s,own", "page_id", s, "url"))
    return L.id_url_score(table(spark, d, "pages").select(value.alias("value")), "fixed")


@query("SELECT page_id, 'http://host/' || regexp_extract('x/' || url || '.jpg', '^[^/]*/(.*g)', 1) AS moved FROM pages")
def path_to_url(spark, d):
    return table(spark, d, "pages").withColumn("p", F.concat(F.lit("x/"), "url", F.lit(".jpg"))).select("page_id", T.url_of_path("p", "http://host/").alias("moved"))


@query("SELECT i AS id, page_id IS NOT NULL AS known FROM range(1, 501) r(i) LEFT JOIN pages ON page_id = i")
def id_range_known(spark, d):
    return L.id_range(spark, 0, 500).join(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit(True).alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("known"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderkey % 9 != 4 UNION ALL SELECT 0 FROM orders WHERE o_orderkey % 9 = 4")
def id_list_lines(spark, d):
    """A list of ids: what a line starts with, 0 for one that does not start with a number."""
    v = F.when(F.col("o_orderkey") % 9 == 4, F.lit("none")).otherwise(F.format_string(" %d tail", "o_orderkey"))
    return table(spark, d, "orders").select(T.prefix_number(v, "long").alias("id"))


def _faces_line(stride: int) -> str:
    """A line with two faces of the page: path, count and stride tokens for each."""
    one = "transform(sequence(0, {s} - 1), j -> CAST((page_id * 31 + k * 17 + j * 7) % 620 AS STRING))".format(s=stride)
    return f"concat_ws(' ', concat('p/', page_id, '.jpg'), '2', array_join(flatten(transform(sequence(0, 1), k -> {one})), ' '))"


def _face_sql(j: int) -> str:
    return f"CAST((page_id * 31 + k * 17 + {j} * 7) % 620 AS INT)"


@query(f"SELECT 'p/' || page_id || '.jpg' AS path, CAST(k AS INT) AS k, {_face_sql(2)} AS x1, {_face_sql(1)} AS y1, {_face_sql(3)} AS x2, {_face_sql(0)} AS y2, CAST({_face_sql(4)} AS DOUBLE) AS score FROM pages, range(0, 2) r(k)")
def vendor_face_boxes(spark, d):
    return L.vendor_faces(table(spark, d, "pages").select(F.expr(_faces_line(220)).alias("value")))


_five = [(s - 2, s - 1) for s in (217, 219, 101, 177, 209)]
# The right eye's y is the first token after its stride, which belongs to the next face or to nothing.
_five_sql = {i: f"CAST((page_id * 31 + (k + {(a // 219)}) * 17 + {a % 219} * 7) % 620 AS INT)" for i, a in enumerate(x for p in _five for x in p)}


@query(f"""WITH f AS (SELECT page_id, k, [{', '.join(f"CASE WHEN k + {a // 219} > 2 THEN -1 ELSE {_five_sql[i]} END" for i, a in enumerate(x for p in _five for x in p))}] AS points FROM pages, range(0, 2) r(k)),
g AS (SELECT page_id, bool_and(points[1] < 620 AND points[2] < 560 AND points[4] < 560 AND points[6] < 560 AND points[8] < 560 AND points[10] < 560 AND points[4] >= 0) AS ok FROM f GROUP BY page_id)
SELECT 'p/' || page_id || '.jpg' AS path, CAST(k AS INT) AS k, points[1] AS x, points[6] AS y FROM f JOIN g USING (page_id) WHERE ok""")
def vendor_face_points(spark, d):
    """Five points of each face at stride 219; a bad face discards its image. One token more stands at the end of a line."""
    line = F.concat_ws(" ", F.expr(_faces_line(219)), F.expr("CAST((page_id * 31 + 2 * 17) % 620 AS STRING)"))
    return L.vendor_points(table(spark, d, "pages").select(line.alias("value")), 620, 560).select("path", "k", F.col("points")[0].alias("x"), F.col("points")[5].alias("y"))


@query(f"{WITH}, c AS (SELECT image_id, count(*) AS n FROM boxes GROUP BY image_id) SELECT image_id || '' AS id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INT) AS k, x1, y1, x2, y2 FROM boxes JOIN c USING (image_id) WHERE n >= 2 QUALIFY x2 - x1 >= 60 AND y2 - y1 >= 60")
def counted_box_lines(spark, d):
    b = boxes(spark, d)
    lines = L.roi_lines(b.limit(0), b).select(F.col("line").alias("value"))
    return L.counted_boxes(lines, 2, 60)


@query("SELECT page_id || '' AS id, CAST(page_id % 100 AS INT) AS first, CAST(page_id % 100 + 9 AS INT) AS last FROM pages WHERE page_id % 4 != 0")
def landmark_lines(spark, d):
    numbers = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("page_id") % 100 + i).cast("string"))
    value = F.concat_ws(" ", F.col("page_id").cast("string"), F.array_join(F.when(F.col("page_id") % 4 == 0, F.slice(numbers, 1, 9)).otherwise(numbers), " "))
    return L.landmarks(table(spark, d, "pages").select(value.alias("value"))).select("id", F.col("points")[0].alias("first"), F.col("points")[9].alias("last"))


@query(f"""{WITH}, i AS (SELECT DISTINCT image_id, CASE WHEN image_id % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM boxes)
SELECT part, image_id || '' AS name, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INT) AS k, CAST(CASE label_id WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS class_id, x1, y1, x2, y2 FROM boxes JOIN i USING (image_id) QUALIFY label_id < 3""")
def box_file_lists(spark, d):
    """Train and test lists joined with files of boxes in a small YAML dialect and with class names."""
    b = boxes(spark, d)
    one = F.format_string("  - {bndbox: [%d, %d, %d, %d], name: c%d}", "x1", "y1", "x2", "y2", "label_id")
    files = b.groupBy(F.col("image_id").cast("string").alias("name")).agg(F.concat(F.lit("annotation:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("s")))), lambda x: x["s"]), "\n")).alias("value"))
    lists = b.select("image_id").distinct().select(F.when(F.col("image_id") % 4 == 0, "test").otherwise("train").alias("part"), F.col("image_id").cast("string").alias("name"))
    classes = spark.createDataFrame([(0, "c2"), (1, "c1"), (2, "c0")], "ord int, label string")
    return L.box_files(lists, files, classes)


@query(f"""{WITH} SELECT image_id, image_id || ' ' || count(*) || ' ' || string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ' ' ORDER BY ord % 7 != 0, ord) AS line FROM boxes WHERE ord % 7 = 0 OR score >= 0.5 GROUP BY image_id""")
def roi_list_lines(spark, d):
    b = boxes(spark, d)
    return L.roi_lines(b.where("ord % 7 = 0"), b.where("ord % 7 != 0 AND score >= 0.5"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS n_lines FROM documents")
def document_line_counts(spark, d):
    return L.line_counts(table(spark, d, "documents"), "doc_id", "text")


@query(f"{WITH} SELECT label_id, count(*) AS n, count(DISTINCT image_id) AS n_images, max(ord) AS last FROM boxes GROUP BY label_id")
def label_folders(spark, d):
    """Rows written to a folder for each label and read back from the names of the folders."""
    path = scratch(spark, "folders")
    stores.write_by(boxes(spark, d), path, "label_id")
    return stores.read_by(spark, path).groupBy("label_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("n_images"), F.max("ord").alias("last"))


@query("""WITH b AS (SELECT 'k' || o_custkey AS key, 0 AS batch, max(o_orderkey) || '' AS value FROM orders GROUP BY 1 UNION ALL SELECT 'k' || o_custkey, 1, CASE WHEN o_custkey % 2 = 0 THEN 'new' END FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey),
l AS (SELECT key, arg_max(struct_pack(v := value), batch).v AS value FROM b GROUP BY key) SELECT key, value FROM l WHERE value IS NOT NULL AND key >= 'k1' AND key <= 'k5'""")
def key_value_scan(spark, d):
    """Two batches put, of which the second replaces and deletes, and a range of keys scanned."""
    o, store = table(spark, d, "orders"), stores.KeyValueStore(spark, scratch(spark, "keys"))
    key = F.concat(F.lit("k"), "o_custkey").alias("key")
    store.put(o.groupBy(key).agg(F.max("o_orderkey").cast("string").alias("value")))
    store.put(o.where("o_custkey % 3 = 0").select(key, F.when(F.col("o_custkey") % 2 == 0, "new").alias("value")).distinct())
    return store.scan("k1", "k5")


_sig = f"WITH {_codes}, c AS (SELECT id, feat, CAST(id % 3 AS INT) AS class_id, {_code_sql.replace('{dims}', '6')} AS code FROM codes)"


def signed(spark, d) -> DataFrame:
    return codes(spark, d).select("id", "feat", (F.col("id") % 3).cast("int").alias("class_id"), signatures.code(dims=6).alias("code"))


_near = "list_max(list_transform(list_zip(a.feat, b.feat), lambda z: abs(z[1] - z[2]))) <= 24 AND list_sum(list_transform(list_zip(a.feat, b.feat), lambda z: abs(z[1] - z[2]))) <= 420"


@query(f"""{_sig.replace("WITH", "WITH RECURSIVE").replace("c AS", "s0 AS")}, c0 AS (SELECT class_id, code, CAST(id AS BIGINT) AS id, feat FROM s0 a WHERE id % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM s0 b WHERE b.id % 2 = 0 AND a.class_id = b.class_id AND a.code = b.code AND {_near})), {scan_sql('class_id, code')}
SELECT class_id, code, id FROM r WHERE id IS NOT NULL AND m IS NULL""")
def signature_store(spark, d):
    """Signatures with even ids are in the store; of the others those that resemble none are appended."""
    s, path = signed(spark, d), scratch(spark, "signatures")
    stores.append_signatures(s.where("id % 2 = 0"), path)
    new = stores.new_signatures(s.where("id % 2 = 1"), stores.read_by(spark, path), 24, 420)
    return new.select("class_id", "code", "id")


@query("SELECT page_id, CAST(3 AS INT) AS channels, CAST(page_id % 50 AS INT) AS height, CAST(page_id % 70 AS INT) AS width, CAST(page_id % 9 - 4 AS INT) AS label, sha256(coalesce(html, '')) AS digest FROM pages")
def image_records(spark, d):
    """Image records written in wire format and read back."""
    p = table(spark, d, "pages").select("page_id", F.lit(3).alias("channels"), F.expr("CAST(page_id % 50 AS INT)").alias("height"), F.expr("CAST(page_id % 70 AS INT)").alias("width"), F.expr("CAST(page_id % 9 - 4 AS INT)").alias("label"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("data"))
    back = models.records_read(models.records_written(p, "page_id"), "page_id")
    return back.select("page_id", "channels", "height", "width", "label", F.sha2("data", 256).alias("digest"))


_model = "concat('svm_type c_svc\\nkernel_type rbf\\nSV\\n', label % 3, ' ', label % 5 - 2, ' 1:0.5 3:', label, '\\n-1 0 2:1.5\\n')"


@query("SELECT DISTINCT label AS model, CAST(ord AS INT) AS ord, CASE ord WHEN 0 THEN CAST(label % 3 AS DOUBLE) ELSE -1 END AS first, CASE ord WHEN 0 THEN CAST(label AS DOUBLE) END AS third FROM embeddings, range(0, 2) r(ord)")
def support_vector_tables(spark, d):
    m = table(spark, d, "embeddings").select(F.col("label").alias("model"), "label").distinct().select("model", F.expr(_model).alias("value"))
    return models.svm_vectors(m).select("model", "ord", F.col("coef")[0].alias("first"), F.element_at("features", 3).alias("third"))


# Filters and joins

_img = "img AS (SELECT DISTINCT image_id, CAST(16 + image_id % 90 AS INT) AS width, CAST(8 + image_id * 7 % 80 AS INT) AS height, CAST(CASE WHEN image_id % 7 = 0 THEN 1 ELSE 3 END AS INT) AS channels, CAST(CASE WHEN image_id % 11 = 0 THEN 16 ELSE 8 END AS INT) AS depth FROM boxes)"


@query(f"{WITH}, {_img} SELECT image_id, width, height FROM img WHERE width >= 32 AND height >= 32 AND channels = 3 AND depth = 8")
def image_validity(spark, d):
    e = F.expr
    i = boxes(spark, d).select("image_id").distinct().select("image_id", e("CAST(16 + image_id % 90 AS INT)").alias("width"), e("CAST(8 + image_id * 7 % 80 AS INT)").alias("height"), e("CASE WHEN image_id % 7 = 0 THEN 1 ELSE 3 END").alias("channels"), e("CASE WHEN image_id % 11 = 0 THEN 16 ELSE 8 END").alias("depth"))
    return filters.valid_images(i, 32).select("image_id", "width", "height")


_clamp = "greatest(0, least({c}, {m}))"
_cl4 = ", ".join(f"{_clamp.format(c=c, m=m)} AS {c}" for c, m in (("x1", 399), ("y1", 299), ("x2", 399), ("y2", 299)))


@query(f"""{WITH}, c AS (SELECT image_id, ord, {_cl4} FROM boxes), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS rank FROM c WHERE x2 - x1 >= 30 AND y2 - y1 >= 30 AND x2 - x1 >= 0.2 * (y2 - y1) AND x2 - x1 <= 5.0 * (y2 - y1))
SELECT image_id, ord, x1, y1, x2, y2, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""")
def proposals_first_ten(spark, d):
    """The surveyed filter of proposals in its training form, and the first N of each image."""
    p = filters.proposals(boxes(spark, d).select("image_id", "ord", *B.SIDES), 400, 300, 0.1, 24)
    return ordering.first_per_label(p, "image_id", ["ord"], 10)


@query(f"""{WITH}, c AS (SELECT image_id, ord, score, {_cl4} FROM boxes WHERE score >= 0.2), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rank FROM c WHERE x2 - x1 >= 40 AND y2 - y1 >= 40 AND x2 - x1 >= 0.125 * (y2 - y1) AND x2 - x1 <= 8 * (y2 - y1))
SELECT image_id, ord, score, x1, y1, x2, y2, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def detector_output_top(spark, d):
    return filters.detector_output(boxes(spark, d).select("image_id", "ord", "score", *B.SIDES), 400, 300, 5, least=40)


@query(f"""{WITH}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS r FROM boxes WHERE score >= 0.98)
SELECT i.image_id, CAST(coalesce(label_id, 51) AS INT) AS label_id, coalesce(score, 0.0) AS score, CAST(coalesce(x1, 0) AS INT) AS x1, CAST(coalesce(x2, {BIG_W - 1}) AS INT) AS x2 FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN (SELECT * FROM t WHERE r = 1) t USING (image_id)""")
def default_class(spark, d):
    """Images without a sure detection get class 51 over their whole area."""
    b = boxes(spark, d)
    rows = ranking.top(b.where("score >= 0.98"), 1).withColumn("label", F.col("label_id").cast("string")).drop("label_id")
    return ranking.with_default(rows, b.select("image_id").distinct(), BIG_W, BIG_H, "51").select("image_id", F.col("label").cast("int").alias("label_id"), "score", "x1", "x2")


@query("SELECT o_orderkey || '' AS stem, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def list_join_basename(spark, d):
    """A list of images joined with annotation files on their names without folder and ending."""
    imgs = table(spark, d, "orders").select(F.format_string("data/%d/%d.v2.jpg", F.col("o_custkey") % 7, "o_orderkey").alias("path"))
    notes = table(spark, d, "lineitem").select(F.format_string("xml/%d.v2.xml", "l_orderkey").alias("file"))
    x = imgs.select(T.path_parts("path")["stem"].alias("stem")).join(notes.select(T.path_parts("file")["stem"].alias("stem")), "stem")
    return x.groupBy(F.regexp_replace("stem", r"\.v2$", "").alias("stem")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT event_id AS ord, user_id AS id, n FROM events JOIN r USING (user_id) WHERE n > 5")
def ordered_list_join(spark, d):
    """A list of ids joined with results; its order stays with the rows, as ord."""
    e = table(spark, d, "events")
    asked = e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("id"))
    return asked.join(e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).where("n > 5"), "id").select("ord", "id", "n")


@query(f"""WITH {_codes}, p AS (SELECT a.id, list_transform(list_zip(a.feat[1:36], b.feat[1:36]), lambda z: abs(z[1] - z[2])) AS c, list_transform(list_zip(a.feat[37:64], b.feat[37:64]), lambda z: abs(z[1] - z[2])) AS e FROM codes a JOIN codes b ON b.id = a.id + 1)
SELECT id, CAST(CASE WHEN list_max(c) <= 10 AND list_sum(c) <= 32 THEN 2 WHEN list_sum(c) <= 230 AND list_sum(e) <= 170 THEN 1 ELSE 0 END AS INT) AS same FROM p""")
def picture_similarity(spark, d):
    """Each signature against the next; the colour limit is widened for these vectors."""
    c = codes(spark, d).select("id", F.slice("feat", 1, 36).alias("cld"), F.slice("feat", 37, 28).alias("ehd"))
    n = c.select((F.col("id") - 1).alias("id"), F.col("cld").alias("cld2"), F.col("ehd").alias("ehd2"))
    return c.join(n, "id").select("id", signatures.same_picture("cld", "ehd", "cld2", "ehd2", near=230).alias("same"))


@query("SELECT event_id AS id, CAST(0 AS INT) AS shard, event_type AS label, CAST(event_id % 64 AS INT) AS class_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 1, event_type, CAST(event_id % 64 + 64 AS INT) FROM events WHERE event_id % 2 = 1")
def shards_with_offset(spark, d):
    """Two shards of classes one after the other: the second's ids start at 64."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2).cast("int").alias("shard"), F.col("event_type").alias("label"), (F.col("event_id") % 64).cast("int").alias("class_id"))
    return e.where("shard = 0").unionByName(e.where("shard = 1").withColumn("class_id", F.col("class_id") + 64))


# Aggregations


@query(f"""{WITH}, g AS (SELECT DISTINCT image_id, k FROM boxes, range(0, 5) r(k)), l AS (SELECT image_id, max(ord) AS last FROM boxes GROUP BY image_id), m AS (SELECT image_id, label_id AS k, min(ord) AS first, arg_max(ord, score * 1e6 - ord / 1e3) AS best FROM boxes GROUP BY 1, 2)
SELECT image_id, CAST(k AS INT) AS cluster, CAST(coalesce(first, last) AS BIGINT) AS first, CAST(coalesce(best, last) AS BIGINT) AS best FROM g JOIN l USING (image_id) LEFT JOIN m USING (image_id, k)""")
def cluster_representatives(spark, d):
    """First and highest-scored member of each of five clusters of an image; an empty cluster gives the image's last."""
    b = boxes(spark, d)
    return ranking.representatives(b, "image_id", "label_id", "ord", "score", 5).select("image_id", F.col("label_id").alias("cluster"), "first", "best")


@query(f"""WITH {_px}, h3 AS (SELECT img, r // 64 AS rb, g // 64 AS gb, b // 64 AS bb, count(*) AS n, CAST(floor((sum(r) + 128) / count(*)) AS INT) AS r, CAST(floor((sum(g) + 128) / count(*)) AS INT) AS g, CAST(floor((sum(b) + 128) / count(*)) AS INT) AS b FROM px GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, rb, gb, bb) AS q FROM h3 WHERE (r + g + b) / 3.0 / 255.0 <= 0.8 AND (r + g + b) / 3.0 / 255.0 > 0.2)
SELECT i.img, CAST(coalesce(r, 185) AS INT) AS r, CAST(coalesce(g, 185) AS INT) AS g, CAST(coalesce(b, 185) AS INT) AS b FROM (SELECT DISTINCT img FROM px) i LEFT JOIN (SELECT * FROM k WHERE q = 1) k USING (img)""")
def main_colours(spark, d):
    return histograms.main_colour(pixel_rows(spark, d), "img")


@query(f"""WITH {_px}, c AS (SELECT img, r // 32 AS bin, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY 1, 2), p AS (SELECT img, n / sqrt(sum(n * n) OVER (PARTITION BY img)) AS p FROM c)
SELECT img, CAST(floor(round(least(-sum(p * log2(p)), 2.0) * 63.5, 9) + 0.5) AS INT) AS score FROM p GROUP BY img""")
def last_channel_entropy(spark, d):
    return histograms.last_channel_entropy(pixel_rows(spark, d), "img")


@query("SELECT event_type, CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) * 10.0 / count(*)) AS BIGINT) AS mean_thousandths, count(*) AS n FROM events GROUP BY event_type")
def mean_latency(spark, d):
    """Mean time of an item in thousandths: total times a thousand over the number of items."""
    total = F.sum(F.round(F.col("value") * 100).cast("long")) * 10.0
    return table(spark, d, "events").groupBy("event_type").agg(F.floor(total / F.count("*")).alias("mean_thousandths"), F.count("*").alias("n"))


_cells = "SELECT DISTINCT image_id, label_id, x1 // 40 AS x, y1 // 40 AS y FROM boxes"


def cells(spark, d) -> DataFrame:
    return boxes(spark, d).select("image_id", "label_id", F.expr("CAST(x1 div 40 AS INT)").alias("x"), F.expr("CAST(y1 div 40 AS INT)").alias("y")).distinct()


@query(f"""{WITH}, c AS ({_cells}), g AS (SELECT image_id, label_id, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy, sum(x * y)::DOUBLE AS sxy FROM c GROUP BY 1, 2),
m AS (SELECT *, sxx - sx / n * sx AS a, syy - sy / n * sy AS b, sxy - sx / n * sy AS c FROM g), e AS (SELECT *, (a + b) / 2 AS h, sqrt(4 * c * c + (a - b) * (a - b)) / 2 AS r FROM m)
SELECT image_id, label_id, n AS area, round(sx / n, 6) AS cx, round(sy / n, 6) AS cy, round(sqrt(greatest(1 - coalesce((h - r) / nullif(h + r, 0), 1), 0)), 4) AS eccentricity FROM e""")
def blob_shapes(spark, d):
    s = regions.blob_shapes(cells(spark, d), ["image_id", "label_id"])
    return s.select("image_id", "label_id", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("eccentricity", 4).alias("eccentricity"))


@query()
def blob_solidity(spark, d):
    return regions.solidity(regions.labelled_blobs(cells(spark, d), "image_id"), ["image_id", "blob"])


# Order


@query(f"""{WITH}, o AS (SELECT image_id * 16 + ord % 16 AS image_id, label_id, count(*) AS n FROM boxes GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY label_id ORDER BY image_id) AS upto FROM o),
f AS (SELECT label_id, min(image_id) AS till FROM w WHERE upto > 60 GROUP BY label_id), k AS (SELECT image_id, count(*) AS kinds, min(label_id) AS label_id FROM o GROUP BY image_id)
SELECT image_id, kinds FROM k LEFT JOIN f USING (label_id) WHERE kinds > 1 OR till IS NULL OR image_id <= till""")
def single_label_cap(spark, d):
    return ordering.capped_single(boxes(spark, d).withColumn("image_id", F.expr("image_id * 16 + ord % 16")), "image_id", "label_id", 60)


# Geometry


@query(f"""{WITH}, s AS (SELECT * FROM boxes WHERE x2 <= {BIG_W} AND y2 <= {BIG_H} AND x2 - x1 >= 0.2 * (y2 - y1) AND y2 - y1 >= 0.2 * (x2 - x1)),
j AS (SELECT s.*, CAST(k AS INT) AS k, CAST(floor((x2 - x1) * k * 75 / 1000.0 + 0.5) AS INT) AS bw, CAST(floor((y2 - y1) * k * 75 / 1000.0 + 0.5) AS INT) AS bh FROM s, range(1, 3) a(k))
SELECT image_id, ord, k, x1 - bw AS x1, y1 - bh AS y1, x2 + bw AS x2, y2 + bh AS y2 FROM j WHERE x1 - bw > 1 AND y1 - bh > 1 AND x2 + bw < {BIG_W - 1} AND y2 + bh < {BIG_H - 1}""")
def box_growth(spark, d):
    return augment.grown(boxes(spark, d), BIG_W, BIG_H)


_f = "((ord * 13 + {i} * 37) % 100) / 100.0 - 0.5"
_ten = [f"CAST({'y1' if i % 2 else 'x1'} + floor((({_f.format(i=i)}) + 0.5) * ({'y2 - y1' if i % 2 else 'x2 - x1'}) + 0.5) AS INT)" for i in range(10)]


@query(f"""{WITH}, p AS (SELECT image_id, ord, [{', '.join(_ten)}] AS p FROM boxes WHERE label_id = 0), f AS (SELECT image_id, ord, p, CASE WHEN p[3] != p[1] THEN degrees(atan((p[2] - p[4]) / CAST(p[3] - p[1] AS DOUBLE))) ELSE 90.0 * sign(p[2] - p[4]) END AS a FROM p)
SELECT i.image_id, coalesce(f.ord, 0) AS ord, CAST(coalesce(p[1], 0) AS INT) AS eye_x, CAST(coalesce(p[10], 0) AS INT) AS mouth_y, round(coalesce(a, 0.0), 6) AS angle FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN f USING (image_id)""")
def face_landmarks(spark, d):
    """Landmarks of faces alone, with the angle of the eyes; an image without a face gets a row of zeros."""
    b = boxes(spark, d)
    feature = F.array(*(F.expr(f"CAST({_f.format(i=i).replace('100.0', '100.0D').replace('0.5', '0.5D')} AS DOUBLE)") for i in range(10)))
    p = b.where("label_id = 0").withColumn("p", augment.landmark_points(feature)).select("image_id", "ord", "p", augment.eye_angle(F.col("p")).alias("angle"))
    x = b.select("image_id").distinct().join(p, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("image_id", zero(F.col("ord")).alias("ord"), zero(F.col("p")[0]).alias("eye_x"), zero(F.col("p")[9]).alias("mouth_y"), F.round(F.coalesce("angle", F.lit(0.0)), 6).alias("angle"))


_ang = "radians(score * 360)"
_cxy = "floor(x1 + (x2 - x1) * 0.5 + 0.5) AS cx, floor(y1 + (y2 - y1) * 0.5 + 0.5) AS cy, cos(radians(score * 360)) * 0.5 AS a, sin(radians(score * 360)) * 0.5 AS b, x2 - x1 AS w, y2 - y1 AS h"


@query(f"{WITH}, c AS (SELECT image_id, ord, {_cxy} FROM boxes) SELECT image_id, ord, round(cx - a * w - b * h, 4) AS p0x, round(cy + b * w - a * h, 4) AS p0y, round(cx + a * w - b * h, 4) AS p1x, round(cy - b * w - a * h, 4) AS p1y, round(cx + a * w + b * h, 4) AS p2x, round(cy - b * w + a * h, 4) AS p2y, round(cx - a * w + b * h, 4) AS p3x, round(cy + b * w + a * h, 4) AS p3y FROM c")
def rotated_boxes(spark, d):
    return boxes(spark, d).select("image_id", "ord", *(F.round(v, 4).alias(k) for k, v in augment.rotated_corners(F.col("score") * 360).items()))


@query(f"{WITH}, s AS (SELECT image_id, ord, x2 - x1 AS w, y2 - y1 AS h FROM boxes) SELECT image_id, ord, round(least(1.0, 100.0 / greatest(w, h)), 6) AS ratio, CAST(floor(w * least(1.0, 100.0::DOUBLE / greatest(w, h)) + 0.5) AS INT) AS new_width, CAST(floor(h * least(1.0, 100.0::DOUBLE / greatest(w, h)) + 0.5) AS INT) AS new_height FROM s")
def resize_targets(spark, d):
    s = boxes(spark, d).select("image_id", "ord", F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"))
    r = augment.resized("w", "h", 100)
    return s.select("image_id", "ord", F.round(r["ratio"], 6).alias("ratio"), r["new_width"].alias("new_width"), r["new_height"].alias("new_height"))


_raw_cols = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _delta.items())


@query(f"""WITH RECURSIVE {BOXES_SQL}, q AS (SELECT *, {_raw_cols} FROM boxes WHERE label_id < 4 AND score >= 0.5),
z AS (SELECT image_id, ord, label_id, score, {_decode_sql('x1', 'x2', 'dx', 'dw', '-', BIG_W)} AS x1, {_decode_sql('y1', 'y2', 'dy', 'dh', '-', BIG_H)} AS y1, {_decode_sql('x1', 'x2', 'dx', 'dw', '+', BIG_W)} AS x2, {_decode_sql('y1', 'y2', 'dy', 'dh', '+', BIG_H)} AS y2 FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label_id ORDER BY score DESC, ord) AS r FROM z WHERE x1 < x2 AND y1 < y2),
walk(image_id, label_id, r, kept) AS (
  SELECT image_id, label_id, CAST(1 AS BIGINT), [{{'ord': ord, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] FROM r WHERE r = 1
  UNION ALL SELECT w.image_id, w.label_id, r.r, CASE WHEN len(list_filter(w.kept, lambda k: {iou_duck('k.', 'r.', 'nms')} > 0.3)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'ord': r.ord, 'score': r.score, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
  FROM walk w JOIN r ON r.image_id = w.image_id AND r.label_id = w.label_id AND r.r = w.r + 1
), last AS (SELECT image_id, label_id, arg_max(kept, r) AS kept FROM walk GROUP BY image_id, label_id), u AS (SELECT image_id, label_id, unnest(kept) AS k FROM last),
t AS (SELECT image_id, n.label, k, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, k.ord) AS rank FROM u JOIN (VALUES {', '.join(f"({k}, '{v}')" for k, v in detection.NAMES.items())}) n(label_id, label) USING (label_id))
SELECT i.image_id, CAST(coalesce(rank, 1) AS INT) AS rank, coalesce(label, 'other.other') AS label, coalesce(k.score, 0.0) AS score, {', '.join(f"CAST(coalesce(floor(k.{c} / 0.5 + 0.5), {v}) AS INT) AS {c}" for c, v in (('x1', 0), ('y1', 0), ('x2', 2 * BIG_W - 1), ('y2', 2 * BIG_H - 1)))}
FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN (SELECT * FROM t WHERE rank <= 10) t USING (image_id)""")
def detect_plan(spark, d):
    """Raw regions with scores by class to named detections in the original image: all steps of the plan. The fifth class is the background's score here."""
    b = boxes(spark, d).select("*", *(F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in _delta.items()))
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.when(F.col("label_id") < 4, F.col("label_id") + 1).otherwise(0), F.col("score")).otherwise(0.0))
    return detection.detect(b.withColumn("scores", scores), BIG_W, BIG_H, 0.5, 0.3, 10, 0.5)


_fb = "fb AS (SELECT *, CASE label_id WHEN 0 THEN 'face' WHEN 1 THEN 'eye' WHEN 2 THEN 'mouth' WHEN 3 THEN 'nose' ELSE 'half' END AS label FROM boxes WHERE score >= 0.8)"


@query(f"""{WITH}, {_fb}, fa AS (SELECT * FROM fb WHERE label = 'face'), pa AS (SELECT * FROM fb WHERE label IN ('eye', 'mouth', 'nose')),
fr AS (SELECT * FROM pa p WHERE NOT EXISTS (SELECT 1 FROM fa f WHERE f.image_id = p.image_id AND {iou_duck('p.', 'f.', 'eval')} >= 0.1)),
lo AS (SELECT * FROM fr p WHERE EXISTS (SELECT 1 FROM fr f WHERE f.image_id = p.image_id AND f.ord != p.ord AND {iou_duck('p.', 'f.', 'eval')} >= 0.005)),
ma AS (SELECT image_id, 'parts' AS kind, 'face' AS label, max(score) AS score, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lo GROUP BY image_id HAVING count(*) >= 2),
ha AS (SELECT image_id, 'half', 'face', score, x1, y1, x2, y2 FROM fb h WHERE label = 'half' AND image_id NOT IN (SELECT image_id FROM ma) AND NOT EXISTS (SELECT 1 FROM fa f WHERE f.image_id = h.image_id AND {iou_duck('h.', 'f.', 'eval')} >= 0.3)),
st AS (SELECT image_id, 'strong', 'face', score, x1, y1, x2, y2 FROM fa WHERE score >= 0.95),
we AS (SELECT image_id, 'weak', 'face', score, x1, y1, x2, y2 FROM fa f WHERE score < 0.95 AND (SELECT count(*) FROM pa p WHERE p.image_id = f.image_id AND {iou_duck('f.', 'p.', 'eval')} >= 0.05) >= 2),
al AS (SELECT * FROM ma UNION ALL SELECT * FROM ha UNION ALL SELECT * FROM st UNION ALL SELECT * FROM we)
SELECT i.image_id, coalesce(kind, 'none') AS kind, coalesce(label, 'other') AS label, coalesce(score, 0.0) AS score, CAST(coalesce(x1, 0) AS INT) AS x1, CAST(coalesce(y1, 0) AS INT) AS y1, CAST(coalesce(x2, 639) AS INT) AS x2, CAST(coalesce(y2, 479) AS INT) AS y2
FROM (SELECT DISTINCT image_id FROM fb) i LEFT JOIN al USING (image_id)""")
def face_repair(spark, d):
    b = boxes(spark, d).withColumn("label", F.expr("CASE label_id WHEN 0 THEN 'face' WHEN 1 THEN 'eye' WHEN 2 THEN 'mouth' WHEN 3 THEN 'nose' ELSE 'half' END"))
    return faces.repaired(b.drop("label_id"), low=0.8, high=0.95)


# Label merges and routing

_f90 = "CAST((image_id * 3 + ord) % 90 AS INT)"
_tiny90 = f"({_f90} = 84 AND (x2 - x1 < 64 OR y2 - y1 < 64))"


@query(f"{WITH}, f AS (SELECT image_id, ord, score, {_f90} AS fine, CASE WHEN {_tiny90} THEN 55 ELSE {_f90} END AS pos FROM boxes) SELECT image_id, ord, fine, CAST(CASE WHEN score >= {labels.LEAST_90!r}[pos + 1] THEN {labels.MERGED_90!r}[pos + 1] ELSE 55 END AS INT) AS coarse FROM f")
def class_merge_90(spark, d):
    b = boxes(spark, d).withColumn("fine", F.expr(_f90))
    return labels.merged_with_least(b, labels.MERGED_90, labels.LEAST_90, 55, 84).select("image_id", "ord", "fine", "coarse")


_f6 = "CAST((image_id + ord) % 6 AS INT)"


@query(f"{WITH}, f AS (SELECT image_id, ord, score, {_f6} AS fine, CASE WHEN {_f6} = 5 AND (x2 - x1 < 64 OR y2 - y1 < 64) THEN 1 ELSE {_f6} END AS pos FROM boxes) SELECT image_id, ord, fine, CAST(CASE WHEN score >= {labels.LEAST_6!r}[pos + 1] THEN {labels.MERGED_6!r}[pos + 1] ELSE 55 END AS INT) AS coarse FROM f")
def class_merge_6(spark, d):
    b = boxes(spark, d).withColumn("fine", F.expr(_f6))
    return labels.merged_with_least(b, labels.MERGED_6, labels.LEAST_6, 55, 5).select("image_id", "ord", "fine", "coarse")


@query(f"{WITH}, f AS (SELECT image_id, ord, score, CAST((image_id + ord * 7) % 110 AS INT) AS fine FROM boxes) SELECT image_id, ord, 'c' || fine AS label, score FROM f WHERE fine < 95")
def class_names_95(spark, d):
    """Classes to names of a dictionary of 95; classes beyond it are dropped. The same holds for those of 46 and 20."""
    names = spark.createDataFrame([(i, f"c{i}") for i in range(95)], "fine int, label string")
    f = boxes(spark, d).select("image_id", "ord", "score", F.expr("CAST((image_id + ord * 7) % 110 AS INT)").alias("fine"))
    return f.join(F.broadcast(names), "fine").select("image_id", "ord", "label", "score")


_q = "SELECT image_id, ord, CAST((image_id + ord) % 37 AS INT) AS class37, CAST(ord % 3 AS INT) AS ql, score AS qs, CAST(label_id % 3 AS INT) AS bl, CAST((x1 + y1) % 100 AS DOUBLE) / 100 AS bs FROM boxes"


@query(f"""{WITH}, q AS ({_q}), m AS (SELECT *, {labels.QUALITY_MODEL!r}[class37 + 1] AS model FROM q), a AS (SELECT *, model >= 0 AND ql = 2 AND qs >= 0.8 AS asked, bl = 2 AND bs >= 0.9 AS good FROM m)
SELECT image_id, ord, CAST(model AS INT) AS model, CAST(CASE WHEN class37 >= 34 THEN 1 WHEN asked THEN CASE WHEN good THEN 2 ELSE 0 END WHEN model >= 0 THEN ql ELSE 1 END AS INT) AS quality,
  CASE WHEN class37 >= 34 THEN 2.0 WHEN asked THEN CASE WHEN good THEN bs ELSE 2.0 END WHEN model >= 0 THEN qs ELSE 2.0 END AS quality_score FROM a""")
def quality_routing(spark, d):
    e = F.expr
    q = boxes(spark, d).select("image_id", "ord", e("CAST((image_id + ord) % 37 AS INT)").alias("class37"), e("CAST(ord % 3 AS INT)").alias("quality_label"), F.col("score").alias("quality_raw"), e("CAST(label_id % 3 AS INT)").alias("blur_label"), e("CAST((x1 + y1) % 100 AS DOUBLE) / 100").alias("blur_raw"))
    return labels.quality_verdict(q).select("image_id", "ord", "model", "quality", "quality_score")


# Vectors, distances, layers

_ref2 = [round(((i * 5) % 9 - 4) / 16, 6) for i in range(64)]
_var = [round(0.5 + (i % 4) / 4, 6) for i in range(64)]
_two = [[2.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(64)] for i in range(64)]


@query(f"""WITH {_vec}, g AS (SELECT vec_id, e, list_transform(list_zip(e, {_ref2!r}), lambda q: q[1] - q[2]) AS g FROM v)
SELECT vec_id, round(list_sum(list_transform(g, lambda x: pow(abs(x), 3))), 6) AS minkowski, round(list_sum(list_transform(list_zip(g, {_var!r}), lambda q: q[1] * q[1] / q[2])), 6) AS seuclidean,
  round({' + '.join(f"{_two[i][j]} * g[{i + 1}] * g[{j + 1}]" for i in range(64) for j in range(64) if _two[i][j])}, 6) AS mahalanobis FROM g""")
def weighted_distances(spark, d):
    lit = lambda x: F.array(*map(F.lit, x))
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    gaps = V.weighted_distances(F.col("e"), lit(_ref2), lit(_var), _two)
    return v.select("vec_id", *(F.round(c, 6).alias(k) for k, c in gaps.items()))


_bits = f"""b AS (SELECT vec_id, list_transform(list_zip(e, {_ref2!r}), lambda q: [CAST(q[1] > 0 AS INT), CAST(q[2] > 0 AS INT)]) AS z FROM v),
c AS (SELECT vec_id, list_sum(list_transform(z, lambda q: q[1] * q[2])) AS tt, list_sum(list_transform(z, lambda q: abs(q[1] - q[2]))) AS xo, list_sum(list_transform(z, lambda q: q[1] * (1 - q[2]))) AS tf FROM b)"""


@query(f"""WITH {_vec}, {_bits} SELECT vec_id, round(2.0 * tf * (xo - tf) / (tf * (xo - tf) + tt * (64 - tt - xo)), 6) AS yule, CAST(xo AS DOUBLE) AS matching, round(xo / (xo + 2.0 * tt), 6) AS dice, round(2.0 * xo / (xo + 64), 6) AS rogerstanimoto, CAST(64 - tt AS DOUBLE) AS russellrao,
  round(2.0 * xo / (tt + 2 * xo), 6) AS sokalsneath, round(1 - (tt / (tt + tf) + tt / (tt + xo - tf)) / 2.0, 6) AS kulsinski, round(xo / (xo + tt), 6) AS jaccard_bool FROM c""")
def bool_distances(spark, d):
    bits = lambda a: F.transform(a, lambda x: x > 0)
    v = table(spark, d, "embeddings").select("vec_id", bits(V.doubles("embedding")).alias("e"))
    return v.select("vec_id", *(F.round(x, 6).alias(k) for k, x in V.bool_distances(F.col("e"), bits(F.array(*map(F.lit, _ref2)))).items()))


_act = {
    "absval": "abs(x)", "relu": "greatest(x, 0.0)", "prelu": "greatest(x, 0.0) + 0.1 * least(x, 0.0)", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "bnll": "greatest(x, 0.0) + ln(1 + exp(-abs(x)))", "sigmoid": "1 / (1 + exp(-x))",
    "tanh": "tanh(x)", "exp": "exp(x)", "log": "ln(abs(x) + 1e-9)", "power": "pow(1.0 + 0.5 * x, 2)", "threshold": "CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
}


@query(f"WITH {_vec} SELECT vec_id, {', '.join(f'round(list_sum(list_transform(e, lambda x: {v})), 5) AS {k}' for k, v in _act.items())} FROM v")
def layer_activations(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    return v.select("vec_id", *(F.round(V.total(a), 5).alias(k) for k, a in Y.activations(F.col("e")).items()))


@query(f"""WITH {_vec}, m AS (SELECT vec_id, label, e, list_sum(e) / 64 AS m FROM v), c AS (SELECT vec_id, list_transform(e, lambda x: x - m) AS c, e FROM m)
SELECT vec_id, round(c[1] / (sqrt(list_dot_product(c, c) / 64) + 1e-9), 6) AS mvn, round(e[3] / pow(1 + 0.0001 / 5 * (e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4] + e[5] * e[5]), 0.75), 6) AS lrn, round((e[2] - 0.1) / (0.5 + 1e-8), 6) AS pixel FROM c""")
def layer_normalisations(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    one = lambda x: F.array_repeat(F.lit(x), 64)
    return v.select("vec_id", F.round(Y.mean_variance_normalised(F.col("e"))[0], 6).alias("mvn"), F.round(Y.response_normalised(F.col("e"))[2], 6).alias("lrn"), F.round(Y.pixel_normalised(F.col("e"), one(0.1), one(0.5))[1], 6).alias("pixel"))


@query("""WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY i)
SELECT vec_id, CAST(i AS INT) AS i, round((x - m) / sqrt(v + 1e-5), 5) AS x FROM u JOIN s USING (i)""")
def batch_normalisation(spark, d):
    """Each component by its mean and variance over the table."""
    u = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.doubles("embedding")).alias("i", "x")).withColumn("i", F.col("i") + 1)
    s = u.groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return u.join(F.broadcast(s), "i").select("vec_id", "i", F.round((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + 1e-5), 5).alias("x"))


_sub = "list_transform(list_zip(e, {r}), lambda q: {f})"


@query(f"""WITH {_vec}, p AS (SELECT vec_id, label % 64 AS t, e, list_transform(list_zip(e, {_ref2!r}), lambda q: q[1] - q[2]) AS g, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM v), h AS (SELECT *, list_transform(list_zip(e, range(0, 64)), lambda q: greatest(0.0, 1 - CASE WHEN q[2] = t THEN q[1] ELSE -q[1] END)) AS h FROM p)
SELECT vec_id, round(list_dot_product(g, g) / 2, 5) AS euclidean, round(list_sum(list_transform(g, lambda d: CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END)), 5) AS smooth_l1, round(-ln(greatest(x[t + 1] / list_sum(x), 1e-30)), 5) AS softmax,
  round(list_sum(h), 5) AS hinge_l1, round(list_dot_product(h, h), 5) AS hinge_l2, round(list_sum(list_transform(list_zip(e, range(0, 64)), lambda q: greatest(q[1], 0.0) - q[1] * CASE WHEN q[2] = t THEN 1.0 ELSE 0.0 END + ln(1 + exp(-abs(q[1]))))), 5) AS sigmoid_cross_entropy,
  round(list_dot_product(g, g) / 2, 5) AS contrastive_same, round(pow(greatest(1 - sqrt(list_dot_product(g, g)), 0.0), 2) / 2, 5) AS contrastive_other FROM h""")
def layer_losses(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"), (F.col("label") % 64).alias("t"))
    return v.select("vec_id", *(F.round(x, 5).alias(k) for k, x in Y.losses(F.col("e"), F.array(*map(F.lit, _ref2)), F.col("t")).items()))


@query(f"""WITH {_vec} SELECT vec_id, round(list_sum(e), 5) AS total, round(list_dot_product(e, e), 5) AS sumsq, round(list_sum(list_transform(e, lambda x: abs(x))), 5) AS asum, round(e[11], 6) AS cropped, CAST(128 AS INT) AS tiled,
  round(list_max(list_transform(list_zip(e, {_ref2!r}), lambda q: greatest(q[1], q[2]))), 6) AS largest, round(list_sum(list_transform(list_zip(e, {_ref2!r}), lambda q: 2.5 * q[1] + q[2])), 5) AS axpy, round(list_sum(list_transform(e, lambda x: pow(x, 3))), 5) AS cubes, CAST(list_sum(list_transform(e, lambda x: sign(x))) AS DOUBLE) AS signs FROM v""")
def layer_shapes(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    e, r, red = F.col("e"), F.array(*map(F.lit, _ref2)), Y.reductions(F.col("e"))
    return v.select(
        "vec_id", F.round(red["sum"], 5).alias("total"), F.round(red["sumsq"], 5).alias("sumsq"), F.round(red["asum"], 5).alias("asum"), F.round(Y.cropped(e, 10, 4)[0], 6).alias("cropped"), F.size(Y.tiled(e, 2)).alias("tiled"),
        F.round(F.array_max(Y.eltwise(e, r, "max")), 6).alias("largest"), F.round(V.total(V.axpy(2.5, e, r)), 5).alias("axpy"), F.round(V.total(V.powx(e, 3.0)), 5).alias("cubes"), V.total(V.sign(e)).alias("signs"),
    )


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN (label % 64) = list_position(embedding, list_max(embedding)) - 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM embeddings GROUP BY label")
def layer_accuracy(spark, d):
    hit = F.col("label") % 64 == F.array_position("embedding", F.array_max("embedding")) - 1
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("accuracy"))


# Pixels and images


@query(f"""WITH {_px} SELECT img, CAST(sum(((r >> 4) << 12) | ((g >> 4) << 8) | ((b >> 4) << 4) | 15) AS BIGINT) AS packed16, CAST(sum((255::BIGINT << 24) | (r::BIGINT << 16) | (g << 8) | b) AS BIGINT) AS packed32, CAST(sum((g >> 4) << 4) AS BIGINT) AS green16, CAST(sum(g) AS BIGINT) AS green32 FROM px GROUP BY img""")
def pixel_packing(spark, d):
    p = pixel_rows(spark, d).withColumns({"p16": P.rgba4444(), "p32": P.rgba8888()})
    return p.groupBy("img").agg(F.sum("p16").cast("long").alias("packed16"), F.sum("p32").alias("packed32"), F.sum(P.unpack4444("p16")["g"]).cast("long").alias("green16"), F.sum(P.unpack8888("p32")["g"]).cast("long").alias("green32"))


_luma = "((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14)"
_hue0 = "CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0.0 WHEN r = greatest(r, g, b) THEN 60.0 * (g - b) / (greatest(r, g, b) - least(r, g, b)) WHEN g = greatest(r, g, b) THEN 120.0 + 60.0 * (b - r) / (greatest(r, g, b) - least(r, g, b)) ELSE 240.0 + 60.0 * (r - g) / (greatest(r, g, b) - least(r, g, b)) END"
_hue = f"hu AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360.0 ELSE h0 END AS hue FROM (SELECT *, CAST({_hue0} AS DOUBLE) AS h0 FROM px))"


@query(f"""WITH {_px}, {_hue}, s AS (SELECT *, CAST(r AS DOUBLE) / nullif(r + g + b, 0) AS q, CAST(g AS DOUBLE) / nullif(r + g + b, 0) AS p, ((r - {_luma}) * 11682 + (128 << 14) + 8192) >> 14 AS cr, ((b - {_luma}) * 9241 + (128 << 14) + 8192) >> 14 AS cb FROM hu)
SELECT img, count(*) FILTER (p < -1.8423 * q * q + 1.5294 * q + 0.0422 AND p > -0.7279 * q * q + 0.6066 * q + 0.1766 AND (q - 0.33) * (q - 0.33) + (p - 0.33) * (p - 0.33) > 0.004) AS rg,
  count(*) FILTER (cr BETWEEN 133 AND 173 AND cb BETWEEN 77 AND 127) AS ycrcb, count(*) FILTER (floor(hue / 2 + 0.5) % 180 BETWEEN 7 AND 29) AS hsv FROM s GROUP BY img""")
def skin_masks(spark, d):
    return pixel_rows(spark, d).groupBy("img").agg(F.count_if(P.skin_rg()).alias("rg"), F.count_if(P.skin_ycrcb()).alias("ycrcb"), F.count_if(P.skin_hsv()).alias("hsv"))


_hslbin = "least(CAST(floor(hue / 360 * 16) AS INT), 15) * 16 + least(CAST(floor(s * 4) AS INT), 3) * 4 + least(CAST(floor((t + w) / 2 * 4) AS INT), 3)"


@query(f"""WITH {_px}, {_hue}, l AS (SELECT img, hue, greatest(r, g, b) / 255.0::DOUBLE AS t, least(r, g, b) / 255.0::DOUBLE AS w FROM hu), b AS (SELECT *, coalesce((t - w) / nullif(CASE WHEN (t + w) / 2 <= 0.5 THEN t + w ELSE 2 - t - w END, 0), 0) AS s FROM l),
c AS (SELECT img, {_hslbin} AS bin, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT img, bin, n / sum(n) OVER (PARTITION BY img) AS p FROM c), i AS (SELECT DISTINCT img FROM p),
q AS (SELECT x.img, sum(least(x.p, y.p)) AS common FROM p x JOIN p y ON y.img = x.img + 1 AND y.bin = x.bin GROUP BY x.img)
SELECT a.img AS a, a.img + 1 AS b, round(1 - coalesce(common, 0) / (1 + 1e-6), 5) AS distance FROM i a JOIN i z ON z.img = a.img + 1 LEFT JOIN q ON q.img = a.img""")
def hue_histogram_distances(spark, d):
    h = histograms.histogram(pixel_rows(spark, d).withColumn("hsl", P.hsl_bin()), "img", "hsl")
    return histograms.histogram_distances(h, "img").withColumn("distance", F.round("distance", 5))


_grid = "gd AS (SELECT img, CAST(r // 16 AS INT) AS x, CAST(g // 16 AS INT) AS y, CAST(max(b) AS INT) AS v FROM px GROUP BY 1, 2, 3)"


def grid(spark, d) -> DataFrame:
    return pixel_rows(spark, d).groupBy("img", F.expr("CAST(r div 16 AS INT)").alias("x"), F.expr("CAST(g div 16 AS INT)").alias("y")).agg(F.max("b").alias("v"))


@query(f"""WITH {_px}, {_grid}, n AS (SELECT a.img, a.x, a.y, b.v, (2 - abs(a.x - b.x)) * (2 - abs(a.y - b.y)) AS w FROM gd a JOIN gd b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
SELECT img, x, y, round(sum(w * v) / sum(w), 6) AS smooth, list_sort(list(v))[CAST(count(*) // 2 AS INT) + 1] AS median FROM n GROUP BY 1, 2, 3""")
def grid_filters(spark, d):
    """Binomial mean and median of the neighbours of each cell."""
    g = grid(spark, d)
    return images.smoothed(g, "v").join(images.median_filtered(g, "v"), ["img", "x", "y"]).withColumn("smooth", F.round("smooth", 6))


@query(f"WITH {_px}, {_grid}, t AS (SELECT CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(tx * 16 // 10 AS INT) AS x, CAST(ty * 16 // 24 AS INT) AS y FROM range(0, 10) a(tx), range(0, 24) b(ty)) SELECT img, tx - 2 AS x, ty - 3 AS y, v FROM gd JOIN t USING (x, y) WHERE tx BETWEEN 2 AND 8 AND ty BETWEEN 3 AND 20")
def grid_resize_region(spark, d):
    """16 x 16 cells to 10 x 24 by the nearest, and a region of the result."""
    return images.region(images.resampled(grid(spark, d), (16, 16), (10, 24)), 2, 3, 8, 20)


@query(f"""WITH {_px}, {_grid}, g AS (SELECT a.img, a.x, a.y, greatest(abs(coalesce(r.v, a.v) - coalesce(l.v, a.v)), abs(coalesce(w.v, a.v) - coalesce(u.v, a.v))) AS g FROM gd a LEFT JOIN gd l ON l.img = a.img AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN gd r ON r.img = a.img AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN gd u ON u.img = a.img AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN gd w ON w.img = a.img AND w.x = a.x AND w.y = a.y + 1)
SELECT img, round(avg(g), 6) AS before FROM g GROUP BY img""")
def blur_gradients(spark, d):
    return images.blur_measures(grid(spark, d), "v").select("img", F.round("before", 6).alias("before"))


_labf = "CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0::DOUBLE / 3) ELSE 7.787 * {v} + 16.0 / 116.0 END"


@query(f"""WITH {_px}, z AS (SELECT img, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / (255.0 * 0.950456) AS x, (0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b) / 255.0 AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / (255.0 * 1.088754) AS z FROM px),
f AS (SELECT img, y, {_labf.format(v='x')} AS fx, {_labf.format(v='y')} AS fy, {_labf.format(v='z')} AS fz FROM z), l AS (SELECT img, CASE WHEN y > 0.008856 THEN 116.0 * fy - 16.0 ELSE 903.3 * y END AS l, 500.0 * (fx - fy) + 128 AS a, 200.0 * (fy - fz) + 128 AS b FROM f),
m AS (SELECT img, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM l GROUP BY img) SELECT img, count(*) AS n, round(avg((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb)), 3) AS mean_saliency FROM l JOIN m USING (img) GROUP BY img""")
def mean_colour_saliency(spark, d):
    s = images.mean_colour_saliency(pixel_rows(spark, d), P.lab())
    return s.groupBy("img").agg(F.count("*").alias("n"), F.round(F.avg("saliency"), 3).alias("mean_saliency"))


_w3 = [(0, 0.5), (1, 1.25), (2, -0.75)]


@query(f"""WITH {_px}, {_grid}, c AS (SELECT img, x, y, v % 3 AS channel, CAST(v AS DOUBLE) AS a FROM gd), ht AS (SELECT img, x, y, sum(a * w) AS heat FROM c JOIN (VALUES {', '.join(map(str, _w3))}) k(channel, w) USING (channel) GROUP BY 1, 2, 3), t AS (SELECT img, max(heat) AS top FROM ht GROUP BY img)
SELECT img, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS n, round(max(top), 6) AS top FROM ht JOIN t USING (img) WHERE heat > 0.5 * top GROUP BY img""")
def activation_map_boxes(spark, d):
    c = grid(spark, d).select("img", "x", "y", (F.col("v") % 3).alias("channel"), F.col("v").cast("double").alias("a"))
    return images.activation_boxes(c, spark.createDataFrame(_w3, "channel int, w double")).withColumn("top", F.round("top", 6))


# JSON and XML


@query("""SELECT event_id, 'k,id,t' AS members, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(-1 AS BIGINT) AS missing, CASE WHEN event_id % 2 = 0 THEN 'number' ELSE 'array' END AS kind,
  '{"k":' || json_extract_string(props, '$.k') || ',"id":' || event_id || ',"t":"' || event_type || '"}' AS compact, length('{"k":' || json_extract_string(props, '$.k') || ',"id":' || event_id || ',"t":"' || event_type || '"}') + 16 AS styled_length FROM events""")
def json_access(spark, d):
    """Members, typed access with a default, kinds, and both writers."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("t"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.withColumn("j", T.json_compact("k", "id", "t")).withColumn("mixed", F.when(F.col("event_id") % 2 == 0, F.lit('{"v":1.5}')).otherwise(F.lit('{"v":[1]}')))
    styled = F.length(T.json_styled("k", "id", "t"))
    return e.select("event_id", F.concat_ws(",", T.json_members("j")).alias("members"), T.json_get("j", "$.k", "long", -1).alias("k"), T.json_get("j", "$.none", "long", -1).alias("missing"), T.json_kind("mixed", "$.v").alias("kind"), F.col("j").alias("compact"), styled.cast("long").alias("styled_length"))


@query("SELECT page_id, 'p' || page_id AS name, CASE WHEN page_id % 2 = 0 THEN 'a<b$1\\&' ELSE 'plain' END AS changed FROM pages")
def xml_text(spark, d):
    """Text of an element read, and set to text that needs escaping, and read again."""
    x = table(spark, d, "pages").select("page_id", F.concat(F.lit("<annotation><object><name>p"), "page_id", F.lit("</name></object></annotation>")).alias("xml"))
    x = x.withColumn("new", T.xml_set("xml", "name", F.when(F.col("page_id") % 2 == 0, F.lit("a<b$1\\&")).otherwise(F.lit("plain"))))
    return x.select("page_id", T.xml_get("xml", "annotation/object/name").alias("name"), T.xml_get("new", "annotation/object/name").alias("changed"))


@query("SELECT page_id, CASE WHEN position('.' IN url) > 1 THEN substr(url, 1, position('.' IN url) - 2) ELSE '' END AS head, substr(url, position('.' IN url) + 1) AS tail FROM pages")
def cut_at_mark(spark, d):
    return table(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in T.cut_at("url", ".").items()))


# Clusters and learners


@query(f"""WITH RECURSIVE {BOXES_SQL}, x AS (SELECT DISTINCT image_id, x1 // 20 AS item FROM boxes), p AS (SELECT a.item AS i, b.item AS j FROM x a JOIN x b ON a.image_id = b.image_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= (SELECT 6 * count(DISTINCT image_id) / 20 FROM boxes)),
e AS (SELECT i, j FROM p UNION SELECT j, i FROM p UNION SELECT item, item FROM x), r(n, m) AS (SELECT DISTINCT i, i FROM e UNION SELECT r.n, e.j FROM r JOIN e ON r.m = e.i)
SELECT CAST(n AS BIGINT) AS node, CAST(min(m) AS BIGINT) AS component FROM r GROUP BY n""")
def evidence_clusters(spark, d):
    """Columns of images clustered by how many images hold two of them together."""
    b = boxes(spark, d).select("image_id", F.expr("x1 div 20").alias("item"))
    least = -(-6 * b.select("image_id").distinct().count() // 20)
    return C.evidence_clusters(b, "image_id", "item", least)


@query()
def meaningful_text_lines(spark, d):
    """Meaningful clusters of the centres of boxes, within their image."""
    b = boxes(spark, d).select("image_id", "ord", ((F.col("x1") + F.col("x2")) / (2.0 * 1280)).alias("cx"), ((F.col("y1") + F.col("y2")) / (2.0 * 960)).alias("cy"))
    return C.meaningful_clusters(b, "image_id", "ord", ["cx", "cy"])


_sv = [(0.5, _ref2), (-1.25, _var), (0.75, _ref2[::-1])]


@query(f"""WITH {_vec}, s AS (SELECT vec_id, c, list_sum(list_transform(list_zip(e, w), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d2, list_dot_product(e, w) AS dp FROM v, (VALUES {', '.join(f'({c}, {w!r}::DOUBLE[])' for c, w in _sv)}) k(c, w))
SELECT vec_id, round(sum(c * exp(-0.05 * d2)) - 0.1, 6) AS rbf, round(sum(c * pow(0.05 * dp + 1, 3)) - 0.1, 6) AS poly, round(sum(c * tanh(0.05 * dp + 1)) - 0.1, 6) AS sigmoid FROM s GROUP BY vec_id""")
def kernel_decisions(spark, d):
    """Decision values of support-vector machines of three kernels."""
    sv = spark.createDataFrame(_sv, "coef double, vector array<double>")
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    out = v.select("vec_id")
    for kind in ("rbf", "poly", "sigmoid"):
        own = learners.decision_values(v, "vec_id", "e", sv, 0.1, kind=kind, gamma=0.05, coef0=1.0, degree=3)
        out = out.join(own.select("vec_id", F.round("value", 6).alias(kind)), "vec_id")
    return out


_stumps = [("w", 60.0, -0.5, 0.25), ("h", 80.0, 0.75, -0.25), ("score", 0.5, -1.0, 1.0)]


@query(f"""{WITH}, s AS (SELECT image_id, ord, x2 - x1 AS w, y2 - y1 AS h, score FROM boxes), v AS (SELECT image_id, ord, {' + '.join(f"CASE WHEN {c} <= {t} THEN {a} ELSE {b} END" for c, t, a, b in _stumps)} AS v FROM s) SELECT image_id, ord, CAST(v AS DOUBLE) AS votes, round(1 - 1 / (1 + exp(2 * v)), 6) AS p FROM v""")
def stump_votes(spark, d):
    s = boxes(spark, d).select("image_id", "ord", F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"), "score")
    return s.withColumn("votes", learners.stump_votes(s, _stumps)).select("image_id", "ord", "votes", F.round(regions.vote_probability("votes"), 6).alias("p"))


@query(f"""{WITH}, r AS (SELECT image_id, ord, x2 - x1 AS w, y2 - y1 AS h, score, CAST(x1 % 50 AS DOUBLE) AS sd, CAST(y1 % 60 AS DOUBLE) AS mean, CAST(ord % 4 AS INT) AS holes, x1, y1, x2, y2, x1 // 100 AS line FROM boxes),
k AS (SELECT *, {' + '.join(f"CASE WHEN {c} <= {t} THEN {a} ELSE {b} END" for c, t, a, b in _stumps)} AS v FROM r WHERE (mean = 0 OR sd / mean <= 0.8) AND holes <= 2 AND w >= 3 AND h >= 3),
g AS (SELECT image_id, CAST(line AS BIGINT) AS line, count(*) AS n, avg(v) AS vote, stddev_pop(h) / avg(h) AS cv, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM k WHERE v > 0 GROUP BY 1, 2)
SELECT image_id, line, n, x1, y1, x2, y2, round(1 - 1 / (1 + exp(2 * vote)), 6) AS p FROM g WHERE n >= 2 AND cv <= 0.5""")
def text_chain(spark, d):
    """From regions to lines of text: filter, boosted vote, groups, filter and vote of groups, rectangle."""
    r = boxes(spark, d).select("image_id", "ord", F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"), "score", F.expr("CAST(x1 % 50 AS DOUBLE)").alias("stroke_sd"), F.expr("CAST(y1 % 60 AS DOUBLE)").alias("stroke_mean"), F.expr("CAST(ord % 4 AS INT)").alias("holes"), *B.SIDES, F.expr("x1 div 100").alias("line"))
    return regions.text_lines(r, _stumps)


@query()
def learned_pca_error(spark, d):
    """Mean squared error of vectors coded by eight learned components and decoded."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    mean, vectors = C.learned_components(v, "embedding", 8)
    x = C.pca_decoded(C.pca_encoded(v, "embedding", mean, vectors), mean, vectors)
    gap = F.zip_with("decoded", V.doubles("embedding"), lambda a, b: a - b)
    return x.select("vec_id", F.round(V.dot(gap, gap), 6).alias("error"))


@query()
def learned_vocabulary_histogram(spark, d):
    """A vocabulary of eight words learned by k-means, and the histogram of words of each label."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = C.nearest_centre(v, "embedding", C.vocabulary(v, "embedding", 8))
    return histograms.histogram(near, "label", "cluster").select("label", F.col("bin").alias("word"), "n", F.round("p", 6).alias("share"))


@query()
def linear_models(spark, d):
    """Accuracy on the training rows of logistic, support-vector and boosted-stump models of one label against the rest."""
    v = table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("e"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("y"))
    v = v.select("vec_id", "e", "y", *(F.col("e")[i].alias(f"f{i}") for i in range(4)), (2 * F.col("y") - 1).alias("s")).cache()
    rows = []
    for kind in ("logistic", "svm"):
        m = learners.linear_classifier(v, "e", "y", kind)
        rows.append((kind, float(m.transform(learners.vectorised(v, "e")).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])))
    stumps = learners.boosted_stumps(v, ["f0", "f1", "f2", "f3"], "s", 4)
    rows.append(("stumps", float(v.agg(F.avg(((learners.stump_votes(v, stumps) > 0) == (F.col("s") > 0)).cast("double"))).first()[0])))
    w = learners.solved(v, ["f0", "f1", "f2", "f3"], "y", "adam", 10)
    z = sum((F.col(f"f{i}") * w[i] for i in range(4)), F.lit(w[4]))
    rows.append(("adam", float(v.agg(F.avg(((z > 0) == (F.col("y") > 0)).cast("double"))).first()[0])))
    v.unpersist()
    return spark.createDataFrame(rows, "model string, accuracy double").withColumn("accuracy", F.round("accuracy", 6))


@query()
def image_cuts(spark, d):
    """Normalised cuts of the boxes of an image by the closeness of their centres."""
    b = boxes(spark, d).select("image_id", "ord", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return learners.point_cuts(b, "image_id", "ord", ["cx", "cy"], 5000.0)


@query(f"{_sig.replace('WITH', 'WITH RECURSIVE').replace('c AS', 's0 AS')}, c0 AS (SELECT code, CAST(id AS BIGINT) AS id, feat FROM s0), {scan_sql('code')} SELECT code, id, m IS NULL AS is_new, m AS duplicate_of FROM r WHERE id IS NOT NULL")
def stream_new_signatures(spark, d):
    """Signatures as a stream: which are new to their bucket, and which earlier one the others resemble."""
    path = scratch(spark, "signature-stream")
    rows = signed(spark, d).select("code", "id", "feat")
    # Four files in order of id, written one after the other: a source reads the oldest first.
    cuts = [None, *rows.agg(F.percentile_approx("id", [0.25, 0.5, 0.75])).first()[0], None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows if low is None else rows.where(F.col("id") > low)
        (part if high is None else part.where(F.col("id") <= high)).coalesce(1).write.mode("append").parquet(path)
    s = service.poll_stream(spark, path, "code long, id long, feat array<int>", 1)
    return service.run_to_end(service.new_in_stream(s, "code", 24, 420), scratch(spark, "stream"), scratch(spark, "stream-state"))


_nfa = "list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))"


@query(f"{WITH}, b AS (SELECT image_id, ord, 20 + ord AS n, 1 + ord % 15 AS k, CAST(0.05 + score * 0.5 AS DOUBLE) AS p FROM boxes) SELECT image_id, ord, round(log10({_nfa}), 5) AS log_nfa FROM b")
def false_alarms(spark, d):
    b = boxes(spark, d).select("image_id", "ord", (20 + F.col("ord")).alias("n"), (1 + F.col("ord") % 15).alias("k"), (0.05 + F.col("score") * 0.5).alias("p"))
    return C.false_alarms(b, "n", "k", "p").select("image_id", "ord", F.round("log_nfa", 5).alias("log_nfa"))


@query()
def coupled_probabilities(spark, d):
    """Probabilities of four classes from logistic pairwise ones."""
    r = F.transform(F.slice(V.doubles("embedding"), 1, 6), lambda x: 1 / (1 + F.exp(-4 * x)))
    p = learners.coupled_probabilities(table(spark, d, "embeddings").select("vec_id", r.alias("r")), "vec_id", 4)
    return p.select("vec_id", F.round(F.array_max("p"), 4).alias("top"), F.round(V.total(F.col("p")), 4).alias("total"))
