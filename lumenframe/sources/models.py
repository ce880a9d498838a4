"""Model files as tables: support vectors, linear weights, principal components; image records in wire format; a rolling log."""

from __future__ import annotations

import csv
import io
import logging
import logging.handlers

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import tokens
from lumenframe.session import small_batches


def svm_header(text: str) -> dict[str, list[str]]:
    """The lines of a support-vector model before its vectors: name and values."""
    out = {}
    for line in text.split("\n"):
        if line.strip() == "SV":
            break
        name, _, values = line.partition(" ")
        out[name] = values.split()
    return out


def svm_vectors(models: DataFrame) -> DataFrame:
    """model, ord, coef (array) and features (index: value) of the support vectors of models (model, value)."""
    lines = F.filter(F.split(F.regexp_extract("value", r"(?s)\nSV\n(.*)$", 1), "\n"), lambda s: F.trim(s) != "")
    x = models.select("model", F.posexplode(lines).alias("ord", "line")).withColumn("t", tokens("line"))
    plain = F.filter("t", lambda s: ~s.contains(":"))
    pairs = F.transform(F.filter("t", lambda s: s.contains(":")), lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("i"), F.split(s, ":")[1].cast("double").alias("v")))
    return x.select("model", "ord", F.transform(plain, lambda s: s.cast("double")).alias("coef"), F.map_from_entries(pairs).alias("features"))


def svm_text(header: dict[str, list[str]], vectors: list[tuple[list[float], dict[int, float]]]) -> str:
    rows = [" ".join([*(f"{c:.17g}" for c in coef), *(f"{i}:{v:.8g}" for i, v in sorted(f.items()))]) for coef, f in vectors]
    return "\n".join([*(f"{k} {' '.join(v)}" for k, v in header.items()), "SV", *rows, ""])


def linear_weights(models: DataFrame) -> DataFrame:
    """model, ord, weights: the lines after ``w`` of linear models (model, value), one for each feature."""
    lines = F.filter(F.split(F.regexp_extract("value", r"(?s)\nw *\n(.*)$", 1), "\n"), lambda s: F.trim(s) != "")
    return models.select("model", F.posexplode(lines).alias("ord", "line")).select("model", "ord", F.transform(tokens("line"), lambda s: s.cast("double")).alias("weights"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


# Field numbers of the public image record: channels, height, width, data, label.
FIELDS = {1: "channels", 2: "height", 3: "width", 4: "data", 5: "label"}


def record_bytes(channels: int, height: int, width: int, data: bytes, label: int) -> bytes:
    """An image record in protocol-buffer wire format."""
    numbers = b"".join(_varint(k << 3) + _varint(v & (1 << 64) - 1) for k, v in ((1, channels), (2, height), (3, width)))
    return numbers + _varint(4 << 3 | 2) + _varint(len(data)) + data + _varint(5 << 3) + _varint(label & (1 << 64) - 1)


def record_fields(raw: bytes) -> dict:
    """Fields of an image record; unknown ones are skipped."""
    at, out = 0, {}

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = number()
        name, kind = FIELDS.get(tag >> 3), tag & 7
        if kind == 0:
            v = number()
            v = v - (1 << 64) if v >> 63 else v
        elif kind == 2:
            n = number()
            v = raw[at : at + n]
            at += n
        else:
            at += 8 if kind == 1 else 4
            continue
        if name:
            out[name] = v
    return out


def records_written(rows: DataFrame, key: str) -> DataFrame:
    """key and record of rows (key, channels, height, width, data, label)."""
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("channels", "height", "width", "data", "label")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([record_bytes(*r) for r in zip(*cols, strict=True)], pa.binary())], names=[key, "record"])

    return rows.select(key, "channels", "height", "width", "data", "label").mapInArrow(run, f"{key} {kind}, record binary")


def records_read(rows: DataFrame, key: str) -> DataFrame:
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [record_fields(r) for r in b.column("record").to_pylist()]
            ints = [pa.array([g.get(c) for g in got], pa.int32()) for c in ("channels", "height", "width", "label")]
            yield pa.RecordBatch.from_arrays([b.column(key), *ints, pa.array([g.get("data") for g in got], pa.binary())], names=[key, "channels", "height", "width", "label", "data"])

    return rows.select(key, "record").mapInArrow(run, f"{key} {kind}, channels int, height int, width int, label int, data binary")


class CsvFormatter(logging.Formatter):
    """time;level;thread;name;line;message with quoted fields."""

    def format(self, record: logging.LogRecord) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="").writerow([self.formatTime(record), record.levelname, record.thread, record.name, record.lineno, record.getMessage()])
        return out.getvalue()


def rolling_log(name: str, path: str, most_bytes: int, files: int, console: bool = False) -> logging.Logger:
    """A logger of the driver to a file that rolls over at a size, of which a number of old ones stay."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    handlers = [logging.handlers.RotatingFileHandler(path, maxBytes=most_bytes, backupCount=files, encoding="utf-8"), *([logging.StreamHandler()] if console else [])]
    for h in handlers:
        h.setFormatter(CsvFormatter())
        log.addHandler(h)
    return log
