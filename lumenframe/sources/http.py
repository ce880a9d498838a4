"""HTTP: fetching pages and ranges, polling and posting. One try with a timeout; a failure is a row, not an exception."""

from __future__ import annotations

import json
import time
from pathlib import Path
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def get(url: str, timeout: float, headers: dict[str, str] | None = None) -> tuple[int, bytes, str | None]:
    """(status, body, error); status 0 if there was no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
            return r.status, r.read(), None
    except urllib.error.HTTPError as e:
        return e.code, b"", str(e)
    except (OSError, ValueError) as e:
        return 0, b"", str(e)


def fetched(rows: DataFrame, key: str = "id", url: str = "url", timeout: float = 10.0) -> DataFrame:
    """key, status, body and error of each url."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in (b.slice(x, 20) for x in range(0, b.num_rows, 20)):
                got = [get(u, timeout) if u else (0, b"", "no url") for u in part.column(url).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.string())], names=[key, "status", "body", "error"])

    return rows.select(key, url).mapInArrow(run, f"{key} {kind}, status int, body binary, error string")


def fetched_in_ranges(rows: DataFrame, parts: int, key: str = "id", url: str = "url", size: str = "size", timeout: float = 10.0) -> DataFrame:
    """key and body of files of a known size, each got in a number of byte ranges by as many rows; null if a range failed."""
    kind = rows.schema[key].dataType.simpleString()
    step = F.greatest(F.ceil(F.col(size) / parts), F.lit(1)).cast("long")
    x = rows.select(key, url, size, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(size) - 1, F.lit(0)).cast("long"), step)).alias("first"))
    x = x.withColumn("last", F.least(F.col("first") + F.greatest(F.ceil(F.col(size) / parts), F.lit(1)).cast("long"), F.col(size)) - 1)

    def run(batches):
        for b in batches:
            for k, u, a, z in zip(*(b.column(c).to_pylist() for c in (key, url, "first", "last")), strict=True):
                status, body, _ = get(u, timeout, {"Range": f"bytes={a}-{z}"})
                ok = status == 206 and len(body) == z - a + 1
                yield pa.RecordBatch.from_arrays([pa.array([k], b.column(key).type), pa.array([a], pa.int64()), pa.array([body if ok else None], pa.binary())], names=[key, "first", "part"])

    got = x.repartition(key, "first").select(key, url, "first", "last").mapInArrow(run, f"{key} {kind}, first long, part binary")
    g = got.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "part"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["part"]))
    return g.select(key, F.when(~F.exists("p", lambda x: x["part"].isNull()), whole).alias("body"))


def post_rows(url: str, columns: list[str], timeout: float = 10.0):
    """For ``foreachBatch``: posts the rows of each partition as lines joined by a backslash and n."""

    def send(batch: DataFrame, _id: int) -> None:
        def run(rows):
            lines = [",".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows]
            if lines:
                urllib.request.urlopen(urllib.request.Request(url, data="\\n".join(lines).encode()), timeout=timeout).close()

        batch.select(*columns).foreachPartition(run)

    return send


class _Poll(SimpleDataSourceStreamReader):
    """Offsets count polls that gave items; an error is waited out once and gives no rows.

    The service gives an item once, so a poll's items are kept in the folder ``keep``, which the driver sees after a restart too, until its batch is
    committed. Without that option a restart with uncommitted polls fails rather than lose their items.
    """

    def __init__(self, options: dict[str, str]):
        self.url, self.limit = options["url"], int(options.get("limit", "100"))
        self.wait, self.timeout = float(options.get("wait", "2")), float(options.get("timeout", "10"))
        self.held: dict[int, list[tuple[str, str]]] = {}
        self.keep = Path(options["keep"]) if options.get("keep") else None
        if self.keep:
            self.keep.mkdir(parents=True, exist_ok=True)

    def kept(self, poll: int) -> list[tuple[str, str]]:
        if poll not in self.held:
            file = self.keep and self.keep / f"poll-{poll}.json"
            if not file or not file.exists():
                raise RuntimeError(f"the items of poll {poll} are gone: set the option keep to a folder that outlives the driver")
            self.held[poll] = [(a, b) for a, b in json.loads(file.read_text())]
        return self.held[poll]

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def read(self, start: dict):
        sep = "&" if "?" in self.url else "?"
        status, body, _ = get(f"{self.url}{sep}limit={self.limit}", self.timeout)
        rows = []
        try:
            answer = json.loads(body) if status == 200 else {}
            if str(answer.get("succ")).lower() == "true":
                rows = [(str(d.get("id")), str(d.get("url"))) for d in answer.get("data", [])][: self.limit]
        except (ValueError, AttributeError):
            status = 0
        if not rows:
            if status != 200:
                time.sleep(self.wait)
            return iter([]), start
        self.held[start["polls"]] = rows
        if self.keep:
            new = self.keep / f"poll-{start['polls']}.new"
            new.write_text(json.dumps(rows))
            new.replace(new.with_suffix(".json"))
        return iter(rows), {"polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for k in range(start["polls"], end["polls"]) for r in self.kept(k)])

    def commit(self, end: dict) -> None:
        if self.keep:
            for f in self.keep.glob("poll-*.json"):
                if int(f.stem.split("-")[1]) < end["polls"]:
                    f.unlink()
        for k in [k for k in self.held if k < end["polls"]]:
            del self.held[k]


class PollSource(DataSource):
    """``spark.readStream.format("lumenframe_poll").option("url", ...)``: items (id, url) of a service that answers ``{"succ": "true", "data": [...]}``."""

    @classmethod
    def name(cls) -> str:
        return "lumenframe_poll"

    def schema(self) -> str:
        return "id string, url string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Poll(self.options)


__all__ = ["PollSource", "fetched", "fetched_in_ranges", "get", "post_rows"]
