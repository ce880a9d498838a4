"""Readers and writers of line-based files. Line order is data: readers add ord, the line's place in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import prefix_number, tokens


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, value of the lines that are not blank.

    Files are read in splits; a row for each split, of which there are few, tells how many lines stand before it.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = t.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = splits.select("file", "at", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")).alias("before"))
    x = t.join(F.broadcast(before), ["file", "at"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("ord"), "value")
    return x.where(F.trim("value") != "")


def path_list(lines: DataFrame) -> DataFrame:
    """file, ord, sub, path: tokens between white space, one path each."""
    return lines.select("file", "ord", F.posexplode(tokens("value")).alias("sub", "path"))


def labelled_list(lines: DataFrame) -> DataFrame:
    t = tokens("value")
    return lines.where(F.size(t) >= 2).select("file", "ord", t[0].alias("path"), prefix_number(t[1], "int").alias("label"))


def comma_parts(c: str = "value") -> Column:
    return F.filter(F.split(F.col(c), ","), lambda x: x != "")


def id_url(lines: DataFrame) -> DataFrame:
    """(c0, c1) of two columns, (c0, c2) of three; other widths are dropped."""
    p = comma_parts()
    url = F.when(F.size(p) == 2, F.try_element_at(p, F.lit(2))).when(F.size(p) == 3, F.try_element_at(p, F.lit(3)))
    return lines.select(p[0].alias("id"), url.alias("url"), *(c for c in lines.columns if c != "value")).where("url IS NOT NULL")


def url_only(lines: DataFrame) -> DataFrame:
    """A fixed id from the url itself in place of a random one."""
    return lines.select(F.xxhash64("value").alias("id"), F.col("value").alias("url"))


def url_label_score(lines: DataFrame) -> DataFrame:
    """The last three of three or four columns; rows with a negative score or an empty field go."""
    p = comma_parts()
    x = lines.where(F.size(p).isin(3, 4)).withColumn("p", F.slice(p, -3, 3))
    x = x.select(F.col("p")[0].alias("url"), F.col("p")[1].alias("label"), prefix_number(F.col("p")[2]).alias("score"))
    return x.where("score >= 0 AND url != '' AND label != ''")


def id_url_score(lines: DataFrame, label: str) -> DataFrame:
    """(id, url, score) with a constant label, or (id, score, url, label)."""
    p = comma_parts()
    x = lines.withColumn("p", p).withColumn("four", F.size("p") == 4).where(F.size("p").isin(3, 4))
    at = lambda i: F.try_element_at("p", F.lit(i))
    return x.select(prefix_number(at(1), "long").alias("id"), F.when(F.col("four"), at(3)).otherwise(at(2)).alias("url"), F.when(F.col("four"), at(4)).otherwise(F.lit(label)).alias("label"), prefix_number(F.when(F.col("four"), at(2)).otherwise(at(3))).alias("score"))


def id_range(spark: SparkSession, start: int, n: int) -> DataFrame:
    return spark.range(start + 1, start + n + 1)


def strided(t: str, first: str, count: str, width: int) -> Column:
    """The groups of ``width`` tokens from index first on, as arrays; groups that the line does not hold whole are left out."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.expr(count) - 1, F.lit(0))), lambda i: F.slice(F.col(t), F.expr(first) + 1 + i * width, width))
    return F.filter(groups, lambda g: (F.size(g) == width) & (F.expr(count) > 0))


def detection_log(lines: DataFrame) -> DataFrame:
    """image_id, child_id, url, k, label, score, box of lines with five leading tokens, ids, url, count and six tokens a detection."""
    x = lines.withColumn("t", tokens("value")).where("size(t) >= 9").withColumn("n", prefix_number(F.col("t")[8], "int"))
    x = x.select(prefix_number(F.col("t")[5], "long").alias("image_id"), prefix_number(F.col("t")[6], "long").alias("child_id"), F.col("t")[7].alias("url"), F.posexplode(strided("t", "9", "n", 6)).alias("k", "g"))
    return x.select("image_id", "child_id", "url", "k", F.col("g")[0].alias("label"), prefix_number(F.col("g")[1]).alias("score"), *(prefix_number(F.col("g")[i], "int").alias(c) for i, c in ((2, "x1"), (3, "y1"), (4, "x2"), (5, "y2"))))


def counted_boxes(lines: DataFrame, least_boxes: int = 2, least_side: int = 20) -> DataFrame:
    """id, k and box of lines ``id n`` and n times four corners; lines with few boxes and small boxes go."""
    x = lines.withColumn("t", tokens("value")).withColumn("n", prefix_number(F.col("t")[1], "int")).where(F.col("n") >= least_boxes)
    x = x.select(F.col("t")[0].alias("id"), F.posexplode(strided("t", "2", "n", 4)).alias("k", "g"))
    x = x.select("id", "k", *(prefix_number(F.col("g")[i], "int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    return x.where(f"x2 - x1 >= {least_side} AND y2 - y1 >= {least_side}")


def vendor_faces(lines: DataFrame, stride: int = 220) -> DataFrame:
    """path, k, box and score of lines ``path n`` and n groups of stride tokens that start with y2 y1 x1 x2 score."""
    x = lines.withColumn("t", tokens("value")).withColumn("n", prefix_number(F.col("t")[1], "int"))
    x = x.select(F.col("t")[0].alias("path"), F.posexplode(strided("t", "2", "n", stride)).alias("k", "g"))
    order = {"x1": 2, "y1": 1, "x2": 3, "y2": 0}
    return x.select("path", "k", *(prefix_number(F.col("g")[i], "int").alias(c) for c, i in order.items()), prefix_number(F.col("g")[4]).alias("score"))


def landmarks(lines: DataFrame) -> DataFrame:
    """id and ten integers."""
    t = tokens("value")
    return lines.where(F.size(t) == 11).select(t[0].alias("id"), F.transform(F.slice(t, 2, 10), lambda x: prefix_number(x, "int")).alias("points"))


def keyword_map(lines: DataFrame) -> DataFrame:
    """tag, keyword, label_id of ``label_id;keyword;tag1,tag2``."""
    p = F.split("value", ";")
    return lines.where(F.size(p) >= 3).select(F.explode(F.filter(F.split(p[2], ","), lambda x: x != "")).alias("tag"), p[1].alias("keyword"), prefix_number(p[0], "int").alias("label_id"))


# Sinks: a column of finished lines; ``write.text`` puts them where they belong.


def audit_lines(detections: DataFrame) -> DataFrame:
    """image child url n (label score x1 y1 x2 y2)* of detections with k."""
    one = F.format_string("%s %.4f %d %d %d %d", "label", F.col("score").cast("double"), *(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")))
    g = detections.groupBy("image_id", "child_id", "url").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("s")))).alias("d"))
    return g.select("image_id", F.concat_ws(" ", "image_id", "child_id", "url", F.size("d"), F.array_join(F.transform("d", lambda x: x["s"]), " ")).alias("line"))


def fddb_lines(detections: DataFrame) -> DataFrame:
    """image_id and the text of its block: id, count, and x y w h score by falling score."""
    one = F.format_string("%d %d %d %d %.6f", F.col("x1").cast("int"), F.col("y1").cast("int"), (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int"), F.col("score").cast("double"))
    g = detections.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", one.alias("s")))).alias("d"))
    return g.select("image_id", F.concat_ws("\n", F.col("image_id").cast("string"), F.size("d").cast("string"), F.array_join(F.transform("d", lambda x: x["s"]), "\n")).alias("block"))


def libsvm_lines(rows: DataFrame, label: str, features: str, decimals: int = 4) -> DataFrame:
    pair = F.transform(F.col(features), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string(f"%.{decimals}f", x.cast("double"))))
    return rows.withColumn("line", F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pair, " ")))


def label_set_lines(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """key and ``key.jpg,l1,l2``: the distinct labels in the order in which they first appear."""
    first = rows.groupBy(key, label).agg(F.min(order).alias("o"))
    g = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", F.col(label).alias("l")))).alias("d"))
    return g.select(key, F.concat_ws(",", F.concat(F.col(key).cast("string"), F.lit(".jpg")), F.array_join(F.transform("d", lambda x: x["l"]), ",")).alias("line"))


def area_lines(detections: DataFrame, width: int, height: int) -> DataFrame:
    """id, width, height, n and ``label,score,x1,y1,x2,y2,share of the image;`` for each detection, between tabs."""
    share = F.expr(f"(20000 * (x2 - x1) * (y2 - y1) + {width * height}) div {2 * width * height}") / 10000
    one = F.format_string("%s,%.4f,%d,%d,%d,%d,%.4f;", "label", F.col("score").cast("double"), *(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")), share.cast("double"))
    g = detections.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("s")))).alias("d"))
    return g.select("image_id", F.concat_ws("\t", "image_id", F.lit(str(width)), F.lit(str(height)), F.size("d").cast("string"), F.array_join(F.transform("d", lambda x: x["s"]), "")).alias("line"))


def dictionary_report(rows: DataFrame, label: str) -> DataFrame:
    """ord, label, n, share by name; labels are few, so their window is small."""
    g = rows.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.orderBy(label)
    return g.select((F.row_number().over(w) - 1).alias("ord"), label, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("share"))


def vendor_points(lines: DataFrame, width: int, height: int, stride: int = 219) -> DataFrame:
    """path, k and five points (left eye, right eye, nose, corners of the mouth) of lines ``path n`` and n groups of stride tokens.

    A face with a point outside the image is bad, and one bad face discards the whole line.
    """
    # Offsets of the x of the five points, counted from the start of the line.
    starts = (217, 219, 101, 177, 209)
    x = lines.withColumn("t", tokens("value")).withColumn("n", prefix_number(F.col("t")[1], "int")).where("n >= 1")
    at = lambda k, i: F.floor(F.coalesce(F.try_element_at(F.col("t"), i + k * stride + 1).try_cast("double"), F.lit(-1.0)) + 0.5).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array(*(at(k, F.lit(s + j)) for s in starts for j in (0, 1))))
    x = x.select(F.col("t")[0].alias("path"), points.alias("faces"))
    good = F.forall("faces", lambda p: F.forall(F.transform(p, lambda v, i: (v >= 0) & (v < F.when(i % 2 == 0, width).otherwise(height))), lambda ok: ok))
    return x.where(good).select("path", F.posexplode("faces").alias("k", "points"))


def box_files(lists: DataFrame, boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """part, name, ord, class_id and corners: lists (part, ord, name) of train and test images, files of boxes (name, value) with lines ``- {bndbox: [x1, y1, x2, y2], name: label}``, and class names (ord, label). A box in another form is an error."""
    line = r"bndbox:\s*\[\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\]\s*,\s*name:\s*([^}\s]+)"
    boxes_of = F.filter(F.split("value", "\n"), lambda s: s.contains("bndbox"))
    rows = boxes.select("name", F.posexplode(boxes_of).alias("k", "s"))
    # A box in another form would be lost silently.
    rows = rows.withColumn("s", F.when(F.col("s").rlike(line), F.col("s")).otherwise(F.raise_error(F.concat(F.lit("unread box in "), "name", F.lit(": "), "s")).cast("string")))
    rows = rows.select("name", "k", F.regexp_extract("s", line, 5).alias("label"), *(F.regexp_extract("s", line, i + 1).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    ids = classes.select("label", F.col("ord").alias("class_id"))
    # A few labels hold all rows, so rows are not dealt by label: the class names, a bounded dictionary, go to them.
    return lists.join(rows, "name").join(F.broadcast(ids), "label").select("part", "name", "k", "class_id", "x1", "y1", "x2", "y2")


def roi_lines(truth: DataFrame, proposals: DataFrame, key: str = "image_id") -> DataFrame:
    """key and ``id n`` with n times four corners: truths first, then proposals, each by ord."""
    side = lambda df, first: df.select(key, F.lit(first).alias("part"), "ord", "x1", "y1", "x2", "y2")
    one = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")))
    g = side(truth, 0).unionByName(side(proposals, 1)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "ord", one.alias("s")))).alias("d"))
    return g.select(key, F.concat_ws(" ", F.col(key).cast("string"), F.size("d").cast("string"), F.array_join(F.transform("d", lambda x: x["s"]), " ")).alias("line"))


def line_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each text: line ends, and a last line without one."""
    t = F.coalesce(F.col(text), F.lit(""))
    ends = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return texts.select(key, (ends + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)).cast("long").alias("n_lines"))
