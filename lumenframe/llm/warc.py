"""WARC archives: a writer with revisit records and a splittable reader.

The writer stores each record as a gzip member of its own. Of records with equal payloads of
at least ``least`` bytes the one with the smallest id is a response and the others are revisits
of it without payload; which is which is settled on digests, and no payload is shuffled for it. Each
task writes one file under a name of its own attempt; the table of files that the tasks return lists
only those of the attempts that count, so a lost executor leaves at most a file that nobody reads.

The reader deals out byte ranges of files and owns the records whose members start inside a range:

1. Every range is scanned for the gzip magic. A candidate is a member that decodes whole and starts
   with a WARC version line and readable headers; from it the members that follow each other are
   walked to the end of the range. A payload may hold archives itself, so such a chain may lie
   inside a record.
2. For each file the chains are followed from its start: where the true chain of one range ends, that
   of the next begins. Chains that nobody arrives at lie inside records. After damage, reading goes on
   with the next candidate.
3. The ranges are read along the true chains.

So the records do not depend on how a file is split. A member of any size is read by the range in
which it starts; ranges inside it have no true chain.

Defined results: a null payload counts as empty; null ids are written and read as null and are
never chosen as the response of others unless all ids are null; rows equal in payload and id are
ordered by url, and of wholly equal rows one is the response if any is; a payload of any length is
one record; other columns are ignored, whatever their names; an empty table writes nothing and
reads as an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import scratch_path, table, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RANGE = 4 << 20


#: Distinct repeated payloads up to which their digests are broadcast, and parts into which rows are dealt beyond.
SMALL, SALTS = 200_000, 16


def classified(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, n_bytes, refers_to, revisit of (page_id, url, payload)."""
    p = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    # One row for each digest, id and url: partial aggregation keeps it so for each task, however hot a payload is.
    kinds = p.where(F.col("n_bytes") >= least).groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", F.col("copies").alias("twins"))
    firsts = kinds.groupBy("digest").agg(F.min(rank).alias("f"), F.sum("copies").alias("n")).where("n > 1")
    firsts = written(firsts.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.twins").alias("twins")), "warc-firsts")
    n, n_twins = firsts.agg(F.count("*"), F.count_if(F.col("twins") > 1)).first()
    if n <= SMALL:
        x = p.join(F.broadcast(firsts), "digest", "left")
    else:  # a hot digest meets its row in many parts
        salts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salts, ["digest", "salt"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    x = x.withColumn("revisit", F.col("twins").isNotNull() & ~is_first)
    cols = ["page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "revisit"]
    if not n_twins:
        return x.select(*cols)
    # Wholly equal rows that come first: one response for each such group, all its other rows revisit it.
    twin = ~F.col("revisit") & F.coalesce(F.col("twins") > 1, F.lit(False))
    one = x.where(twin).groupBy("digest", "page_id", "url").agg(F.first("payload").alias("payload"), F.first("n_bytes").alias("n_bytes"), F.first("twins").alias("twins"))
    again = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("twins")))).withColumns({"revisit": F.col("k") > 1, "first_id": F.col("page_id")})
    return x.where(~twin).select(*cols).unionByName(again.select(*cols))


def record(page_id, url, payload: bytes | None, digest: str, refers_to=None, revisit: bool = False, n_bytes: int | None = None) -> bytes:
    """One WARC record; a revisit has no payload, only its length n_bytes."""
    n_bytes = len(payload) if n_bytes is None else n_bytes
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    body = http if revisit else http + payload
    odd = url is not None and (url != url.strip() or not url.isprintable())
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url) if odd else url or ""),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(n_bytes)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if odd:
        head.append(("X-Target-URI-Quoted", "1"))
    if revisit:
        head[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + lines + b"\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the output of classified() and returns path, bytes, records of each file."""

    def run(batches):
        system, base = filesystem(folder)
        out, size, n, path = None, 0, 0, f"{base}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for part in (b.slice(x, 200) for x in range(0, b.num_rows, 200)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit", "n_bytes")), strict=True):
                    member = gzip_member(record(*row))
                    out.write(member)
                    size += len(member)
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return written(pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit", "n_bytes").mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Source:
    """A file read forward through a buffer; what is asked for is seen in the buffer, not copied."""

    def __init__(self, f, size: int, chunk: int = 1 << 20):
        self.f, self.size, self.chunk, self.buf, self.at = f, size, chunk, b"", 0

    def fill(self, start: int, n: int) -> None:
        end = min(start + n, self.size)
        if not (self.at <= start and end <= self.at + len(self.buf)):
            self.f.seek(start)
            self.buf, self.at = self.f.read(max(n, self.chunk)), start

    def view(self, start: int, n: int) -> memoryview:
        """n bytes from start, or as many as there are."""
        self.fill(start, n)
        return memoryview(self.buf)[start - self.at : start - self.at + n]

    def find(self, mark: bytes, start: int, end: int) -> int | None:
        """The first place of mark from start on and before end."""
        while start < min(end, self.size):
            self.fill(start, len(mark))
            hit = self.buf.find(mark, start - self.at)
            if hit >= 0:
                return self.at + hit if self.at + hit < end else None
            start = max(start + 1, self.at + len(self.buf) - len(mark) + 1)
        return None


#: Compressed bytes given to the decoder at a time: what lies behind a member is handed back as a copy.
FEED = 1 << 13


def read_member(src: _Source, start: int, peek: bool = False):
    """(data, end) of the gzip member at start, or None; with peek only its first bytes."""
    z = zlib.decompressobj(31)
    out, at, feed = [], start, FEED
    try:
        while not z.eof:
            raw = src.view(at, feed)
            if not len(raw):
                return None
            if peek:
                return z.decompress(raw, len(VERSION)), at
            out.append(z.decompress(raw))
            at += len(raw) - len(z.unused_data)
            feed = min(2 * feed, src.chunk)
    except zlib.error:
        return None
    return out[0] if len(out) == 1 else b"".join(out), at


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record, or None if they don't hold together."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not data.startswith(b"WARC/1."):
        return None
    try:
        lines = [x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]]
        h = {k.lower(): v for k, v in lines}
        n = int(h["content-length"])
    except (ValueError, KeyError, UnicodeDecodeError):
        return None
    return (h, rest[:n]) if len(rest) >= n else None


def member_at(src: _Source, at: int):
    """(data, end) of the gzip member at a place, or None."""
    return read_member(src, at) if src.view(at, len(MAGIC)) == MAGIC else None


def chains_in(f, size: int, start: int, end: int) -> list[tuple[int, int, bool, list[int]]]:
    """(first, stop, whole, starts) of the chains of members found in [start, end): starts are those of the members, stop is where the last ends; a chain that is not whole ends before the range does, at what is no member."""
    src, at, out = _Source(f, size), start, []
    while (at := src.find(MAGIC, at, end)) is not None:
        first = read_member(src, at, peek=True)
        got = read_member(src, at) if first and first[0].startswith(b"WARC/1.") else None
        if not got or not parse(got[0]):
            at += 1
            continue
        starts, stop = [at], got[1]
        while stop < min(end, size) and (got := member_at(src, stop)):
            starts.append(stop)
            stop = got[1]
        out.append((at, stop, stop >= min(end, size), starts))
        at = stop
    return out


def true_chains(ranges: list[tuple[int, list[tuple[int, int, bool, list[int]]]]], split: int, size: int) -> list[tuple[int, int]]:
    """(range, entry) of the true chains of a file, from the chains of its ranges: those that the members from its start arrive at."""
    at, sure, out = 0, True, []
    for first, chains in sorted(ranges, key=lambda r: r[0]):
        end = min(first + split, size)
        while at < end:
            own = next((c for c in chains if at in c[3]), None) if sure else None
            if own is None:  # damage, or no archive from here on: go on with the next candidate
                own = next((c for c in chains if c[0] >= at), None)
                if own is None:
                    at, sure = end, False
                    break
                at = own[0]
            out.append((first, at))
            at, sure = own[1], own[2]
    return out


def records_from(f, size: int, start: int, end: int):
    """Headers and blocks of the records of the chain of members that starts at a place, as far as they start before end."""
    src, at = _Source(f, size), start
    while at < min(end, size) and (got := member_at(src, at)):
        rec = parse(got[0])
        if rec:
            yield rec
        at = got[1]


def opened(path: str):
    from pyarrow import fs

    system, own = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return system.open_input_file(own)


def file_entries(files: DataFrame, split: int) -> DataFrame:
    """path, bytes, first, entry: the true chains of each range of files listed as (path, bytes)."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("first")).repartition(parts, "path", "first")

    def scan(batches):
        for b in batches:
            for path, size, first in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "first")), strict=True):
                with opened(path) as f:
                    c = chains_in(f, size, first, first + split)
                cols = list(zip(*c, strict=True)) if c else [(), (), (), ()]
                n = len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * max(n, 1)), pa.array([size] * max(n, 1), pa.int64()), pa.array([first] * max(n, 1), pa.int64()), *(pa.array(x if n else [None], t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True))],
                    names=["path", "bytes", "first", "head", "stop", "whole", "starts"],
                )

    found = ranges.mapInArrow(scan, "path string, bytes long, first long, head long, stop long, whole boolean, starts array<long>")

    def follow(t: pa.Table) -> pa.Table:
        """One file: its ranges and their chains, a few numbers for each record."""
        by: dict[int, list] = {}
        for first, *c in zip(*(t.column(x).to_pylist() for x in ("first", "head", "stop", "whole", "starts")), strict=True):
            own = by.setdefault(first, [])
            if c[0] is not None:
                own.append((*c[:3], set(c[3])))
        size = t.column("bytes")[0].as_py()
        out = true_chains([(k, sorted(v, key=lambda c: c[0])) for k, v in by.items()], split, size)
        return pa.table({"path": pa.array([t.column("path")[0].as_py()] * len(out), pa.string()), "bytes": pa.array([size] * len(out), pa.int64()), "first": pa.array([x[0] for x in out], pa.int64()), "entry": pa.array([x[1] for x in out], pa.int64())})

    return found.groupBy("path").applyInArrow(follow, "path string, bytes long, first long, entry long").repartition(parts, "path", "first")


def read_archives(files: DataFrame, split: int = RANGE) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of archives listed as (path, bytes)."""
    schema = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def run(batches):
        rows: list[tuple] = []
        held = 0
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path, size, first, entry in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "first", "entry")), strict=True):
                with opened(path) as f:
                    for h, block in records_from(f, size, entry, first + split):
                        payload = block.partition(b"\r\n\r\n")[2]
                        revisit = h.get("warc-type") == "revisit"
                        ident = [h.get(k, "<urn:page:>")[len("<urn:page:") : -1] or None for k in ("warc-record-id", "warc-refers-to")]
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        n = int(h.get("x-payload-length", 0)) if revisit else len(payload)
                        uri = h.get("warc-target-uri", "")
                        rows.append((ident[0], unquote(uri) if "x-target-uri-quoted" in h else uri, h.get("warc-type"), ident[1], digest, n, None if revisit else payload))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield batch()
                            rows.clear()
                            held = 0
        if rows:
            yield batch()

    return file_entries(files, split).mapInArrow(run, schema)


def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.col("html"), "UTF-8").alias("payload"))
    files = write_archives(classified(pages), scratch_path(spark, "warc"))
    back = read_archives(files)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to
FROM m
"""
