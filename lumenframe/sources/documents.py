"""VOC XML, COCO JSON, poll responses, configurations."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
COCO = (
    "categories array<struct<supercategory:string,id:int,name:string>>, images array<struct<file_name:string,id:long>>,"
    " annotations array<struct<image_id:long,category_id:int,bbox:array<double>>>"
)


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """image, has_size, ord, label, box of annotation files; coordinates below 1 gain one."""
    return voc_rows(spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path))


def voc_rows(t: DataFrame) -> DataFrame:
    x = t.select(F.regexp_replace("filename", r"\.jpg$", "").alias("image"), F.col("size").isNotNull().alias("has_size"), F.posexplode("object").alias("ord", "o"))
    box = {"x1": "xmin", "y1": "ymin", "x2": "xmax", "y2": "ymax"}
    return x.select("image", "has_size", "ord", F.col("o.name").alias("label"), *((v + F.when(v < 1, 1).otherwise(0)).alias(c) for c, v in ((c, F.col(f"o.bndbox.{s}")) for c, s in box.items())))


def voc_xml(rows: DataFrame) -> DataFrame:
    """image and its annotation as XML; coordinates are at least 1."""
    at = {s: F.greatest(F.col(c), F.lit(1)).alias(s) for c, s in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))}
    one = F.struct("ord", F.struct(F.col("label").alias("name"), F.struct(*at.values()).alias("bndbox")).alias("o"))
    g = rows.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("d"))
    doc = F.struct(F.concat("image", F.lit(".jpg")).alias("filename"), F.transform("d", lambda x: x["o"]).alias("object"))
    return g.select("image", F.to_xml(doc, {"rowTag": "annotation"}).alias("xml"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    return coco_rows(spark.read.schema(COCO).option("multiLine", True).json(path))


def coco_rows(t: DataFrame) -> DataFrame:
    """file_name, category, box of a COCO document, boxes rounded half up to corners."""
    cats = t.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    images = t.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    notes = t.select(F.posexplode("annotations").alias("ord", "a")).select("ord", "a.image_id", "a.category_id", F.transform("a.bbox", lambda v: F.floor(v + 0.5).cast("int")).alias("b"))
    b = F.col("b")
    x = notes.join(images, "image_id").join(F.broadcast(cats), "category_id")
    return x.select("file_name", "ord", "category", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))


POLL = "succ string, data array<struct<id:string,url:string>>"


def poll_rows(responses: DataFrame, column: str = "value") -> DataFrame:
    """id, url of the responses that succeeded; others, and broken JSON, give nothing."""
    r = responses.select(F.from_json(column, POLL).alias("r")).where("r.succ = 'true'")
    return r.select(F.explode("r.data").alias("d")).select("d.id", "d.url")


def read_config(text: str, env: dict[str, str] | None = None) -> dict:
    """A configuration: ``k = v`` lines, # comments, groups as ``name (`` to ``)``, and %name% from the same or an outer group or the environment."""
    env = dict(os.environ if env is None else env)
    stack: list[dict] = [{}]
    for line in text.splitlines():
        s = line.split("#", 1)[0].strip()
        if not s:
            continue
        if s.endswith("("):
            stack[-1][s[:-1].strip()] = group = {}
            stack.append(group)
        elif s == ")":
            if len(stack) == 1:
                raise ValueError("a group ends that never began")
            stack.pop()
        else:
            k, sep, v = s.partition("=")
            if not sep:
                raise ValueError(f"neither assignment nor group: {s}")
            scope = env | {a: b for g in stack for a, b in g.items() if isinstance(b, str)}
            v = v.strip()
            for _ in range(32):
                new = re.sub(r"%(\w+)%", lambda m: scope.get(m[1], m[0]), v)
                if new == v:
                    break
                v = new
            stack[-1][k.strip()] = v
    if len(stack) != 1:
        raise ValueError("a group never ends")
    return stack[0]
