"""WARC archives with a two-level capture index.

write_archives() turns rows of (page_id, url, html) into gzip-per-record WARC files. build_index() sorts the captures by
reversed-host URL key into compressed blocks and keeps a sparse directory of them: one entry a block, one top entry an
index file. lookup() binary-searches tops, then the directory, and range-reads only the blocks and records it needs.

Defined results: a null html is an empty payload; a null url has the key ""; equal payloads of at least `min_revisit`
bytes keep those rows as response whose page_id is the largest of the group (a null page_id is below all others; rows
repeated with that page_id all stay responses), the rest become revisits. An empty table gives no files and no rows.
Columns other than page_id, url and html are ignored. Files are named by task attempt and only captures of tasks that
Spark commits are indexed, so a lost executor leaves at most unreferenced files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, persist_table, scratch_dir, shuffle_width

BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
EMPTY_SHA1_HEX = hashlib.sha1(b"").hexdigest()
WARC_DATE = "2024-01-01T00:00:00Z"
CAPTURES = "urlkey string, page_id long, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://a.example.com:80/x?q#f -> com,example,a)/x?q."""
    u = (url or "").split("#", 1)[0].strip()
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)(.*)", u, re.S)
    if not m:
        return u
    host = m[1].rpartition("@")[2].lower()
    host = re.sub(r":(80|443)?$", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_safe(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str) -> bytes:
    """One WARC record; refers_to makes it a revisit, whose block keeps the HTTP header and leaves out the payload."""
    digest = _b32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, serial)}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_header_safe(url)}" if url is not None else None,
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {page_id}" if page_id is not None else None,
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(x for x in head if x is not None).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record. A response's digest and size are measured on its payload and held against its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _b32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record of page {h.get('X-Page-Id')}")
    as_id = lambda k: int(h[k]) if k in h else None
    return {"page_id": as_id("X-Page-Id"), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": as_id("X-Refers-To-Page-Id"), "payload": None if revisit else payload}


def revisit_targets(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(digest, keeper): for payloads that more than one row has, the page_id that stays a response. Counts are partial before the shuffle, so a hot payload costs a row a task."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return (
        pages.select(F.sha1(html.cast("binary")).alias("digest"), "page_id", F.octet_length(html).alias("size"))
        .where(F.col("size") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count("page_id").alias("n"), F.count(F.lit(1)).alias("rows"))
        .where((F.col("least") < F.col("keeper")) | ((F.col("rows") > F.col("n")) & (F.col("n") > 0)))
        .select("digest", "keeper")
    )


def write_archives(pages: DataFrame, out_dir: str, min_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below out_dir; returns the captures (CAPTURES), already committed as a table."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # a written table has a known size, so Spark broadcasts it only below its own threshold and shuffles (splitting hot digests) beyond
    keep = persist_table(revisit_targets(pages, min_revisit), "warc-keepers")
    html = F.coalesce(F.col("html"), F.lit(""))
    marked = (
        pages.withColumn("digest", F.when(F.octet_length(html) >= min_revisit, F.sha1(html.cast("binary"))))
        .join(keep, "digest", "left")
        .select("page_id", "url", "html", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        out, name, at, serial, stem, part = None, "", 0, 0, uuid.uuid4().hex, 0
        try:
            for b in batches:
                rows = []
                for pid, url, text, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at, part = f"{stem}-{part:05d}.warc.gz", 0, part + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    raw = make_record(pid, url, (text or "").encode(), ref, f"{stem}/{serial}")
                    serial += 1
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    rows.append((url_key(url), pid, "response" if ref is None else "revisit", name, at, len(member)))
                    at += len(member)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in CAPTURES.split(", ")])
        finally:
            if out is not None:
                out.close()

    return persist_table(map_arrow(marked, write, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, index_dir: str, shards: int | None = None, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Sort captures into compressed blocks; returns the tops [(first key, index file)], one an index file, in key order.

    The sort is by (key, file, offset), so captures of one hot URL spread over as many blocks and files as they need. Only
    the tops reach the driver: as many as shuffle partitions."""
    shards = shards or shuffle_width(captures.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(index_dir)
        fs.create_dir(root, recursive=True)
        name, out, at, lines, directory, first = f"cdx-{uuid.uuid4().hex}.gz", None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            out.write(block)
            directory.append((lines[0][0], lines[-1][0], at, len(block)))
            at += len(block)
            lines = []

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}", compression=None), row[0]
                lines.append(row)
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory, ensure_ascii=False).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([directory[-1][1]]), pa.array([name])], names=["first", "last", "name"])

    ordered = captures.repartitionByRange(shards, "urlkey", "file", "offset").sortWithinPartitions("urlkey", "file", "offset")
    tops = persist_table(map_arrow(ordered, pack, "first string, last string, name string"), "warc-tops")
    return sorted((r["first"], r["last"], r["name"]) for r in tops.collect())


class _Files:
    """Open files of one folder, the most recent few."""

    def __init__(self, uri: str, keep: int = 48):
        (self.fs, self.root), self.keep, self.open = _open_fs(uri), keep, OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.root}/{name}")
        self.open[name] = f
        if len(self.open) > self.keep:
            self.open.popitem(last=False)[1].close()
        return f.read_at(length, offset)

    def load(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read()


def lookup(spark: SparkSession, keys: DataFrame, tops: list[tuple[str, str, str]], index_dir: str, archive_dir: str, with_payload: bool = True) -> DataFrame:
    """Every capture of the distinct keys in keys.urlkey, read from the archives: RECORD columns. Unknown keys give no row.

    Stage 1 binary-searches tops and block directories and emits (block, key) pairs, for a hot key one a block; stage 2
    reads each block once and range-reads the records asked for, in file order."""
    schema = RECORD if with_payload else RECORD.rsplit(",", 1)[0]
    firsts, lasts = [t[0] for t in tops], [t[1] for t in tops]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, cached = _Files(index_dir), OrderedDict()

        def directory(name: str):
            d = cached.pop(name, None)
            if d is None:
                rows = json.loads(files.load(f"{name}.dir"))
                d = [r[0] for r in rows], [r[1] for r in rows], rows
            cached[name] = d
            if len(cached) > 16:
                cached.popitem(last=False)
            return d

        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                for t in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    f, la, rows = directory(tops[t][2])
                    for k in range(bisect_left(la, key), bisect_right(f, key)):
                        out.append((tops[t][2], rows[k][2], rows[k][3], key))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "at", "size", "urlkey"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archive = _Files(index_dir), _Files(archive_dir)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

        def emit(block, wanted):
            rows = [r for r in map(json.loads, zlib.decompress(index.read(*block)).decode().split("\n")) if r[0] in wanted]
            rows.sort(key=lambda r: (r[3], r[4]))
            done, held = [], 0
            for r in rows:
                got = parse_record(zlib.decompress(archive.read(r[3], r[4], r[5]), 31))
                done.append([got[n] for n in names])
                held += len(got["payload"] or b"") if with_payload else 0
                if held > 1 << 24:
                    yield batch(done)
                    done, held = [], 0
            if done:
                yield batch(done)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        block, wanted = None, set()
        for b in batches:
            for name, at, size, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (name, at, size) != block:
                    if block:
                        yield from emit(block, wanted)
                    block, wanted = (name, at, size), set()
                wanted.add(key)
        if block:
            yield from emit(block, wanted)

    pairs = map_arrow(keys.select("urlkey").where("urlkey is not null").distinct(), locate, "name string, at long, size long, urlkey string")
    return map_arrow(pairs.repartition(shuffle_width(spark), "name", "at").sortWithinPartitions("name", "at"), fetch, schema)


def url_keys(pages: DataFrame) -> DataFrame:
    """The distinct index keys of pages.url."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["urlkey"])

    return map_arrow(pages.select(F.col("url").cast("string")).distinct(), key, "urlkey string").distinct()


def archive_round_trip(pages: DataFrame, min_revisit: int = 0, with_payload: bool = True) -> DataFrame:
    """Write archives and index below the shared folder, then look every page's URL up and read its records back."""
    spark = pages.sparkSession
    root = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, f"{root}/archives", min_revisit)
    tops = build_index(captures, f"{root}/index")
    return lookup(spark, url_keys(pages), tops, f"{root}/index", f"{root}/archives", with_payload)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = archive_round_trip(pages, 0, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
