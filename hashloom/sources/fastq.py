"""FASTQ as a Spark data source, and a splitter.

A record is a header line that begins with @, a sequence line, and as a rule a line that begins with + and a quality line. Where a
record begins is told by the lines around alone, so any cutting of a file into byte ranges gives the same records. A line
that begins with @ is a header if the next line begins with neither @ nor + and the one after it begins with + or @, is empty
or is missing (an empty sequence needs the +), unless it is the quality of the three lines before it: header, sequence of
its length, + line. So qualities that begin with @ or + do not mislead it, records without + line are read, a cut-off last
record with a sequence is kept, and what is no record is passed over, here and in every range. A range owns the records
whose header begins in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import cut, files

SCHEMA = "seq_no long, header string, seq string"
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
_AT, _PLUS, _LF = ord("@"), ord("+"), ord("\n")


class FastqRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _strings(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def _headers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: bool) -> tuple[np.ndarray, int]:
    """Indices of the header lines among lines [starts, ends), and how many lines are decided; `whole` says that no line follows."""
    n = len(starts)
    decided = n if whole else max(0, n - 2)
    first = np.zeros(n + 5, np.int16)  # from three lines ahead to two behind; 0: an empty line; -1: no line
    first[:3], first[n + 3 :] = -1, -1
    some = ends > starts
    first[3 : n + 3][some] = buf[starts[some]]
    size = np.full(n + 3, -1)
    size[3:] = ends - starts
    head = np.flatnonzero(first[3 : decided + 3] == _AT)
    second, third = first[head + 4], first[head + 5]
    ok = (second != -1) & (second != _AT) & (second != _PLUS)
    ok &= (third == _PLUS) | ((second != 0) & ((third == _AT) | (third == 0) | (third == -1)))
    quality = (first[head + 2] == _PLUS) & (first[head + 1] != _AT) & (first[head + 1] != _PLUS) & (first[head] == _AT) & (size[head + 1] == size[head + 3])
    return head[ok & ~quality], decided


def _lines_before(f: pa.NativeFile, begin: int) -> int:
    """The start of a line, at least four before the first line that starts at `begin` or later; 0 if there are fewer."""
    back = 1 << 16
    while back < begin:
        f.seek(begin - back)
        feeds = np.flatnonzero(np.frombuffer(f.read(back), np.uint8) == _LF)
        if len(feeds) > 4:
            return begin - back + int(feeds[-5]) + 1
        back *= 4
    return 0


def record_batches(path: str, begin: int, end: int, block: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """(offset, header, sequence) of the records that begin in [begin, end), a batch a block."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        at = _lines_before(f, begin)
        f.seek(at)
        raw, seen = b"", 0  # lines of raw that were decided before
        while True:
            more = f.read(max(block, len(raw)))  # a line longer than a block is read in ever larger steps
            raw, last = raw + more, not more
            buf = np.frombuffer(raw, np.uint8)
            feeds = np.flatnonzero(buf == _LF)
            ends = np.append(feeds, len(buf)) if last and len(buf) and buf[-1] != _LF else feeds
            starts = np.concatenate([[0], feeds + 1])[: len(ends)]
            head, decided = _headers(buf, starts, ends, last)
            head = head[(head >= seen) & (starts[head] + at >= begin) & (starts[head] + at < end)]
            if len(head):
                a, b, c, d = (x.tolist() for x in (starts[head] + 1, ends[head], starts[head + 1], ends[head + 1]))
                names, seqs = [raw[i:j] for i, j in zip(a, b, strict=True)], [raw[i:j] for i, j in zip(c, d, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(starts[head] + at), _strings(names), _strings(seqs)], names=["seq_no", "header", "seq"])
            if last or decided and starts[decided] + at >= end:
                return
            keep = max(0, decided - 3)
            seen, done = decided - keep, int(starts[keep]) if len(starts) else 0
            raw, at = raw[done:], at + done


def records(path: str, begin: int, end: int) -> Iterator[tuple[int, str, str]]:
    """The records of a range, one by one."""
    for b in record_batches(path, begin, end):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.parts = int(options["num_parts"]) if options.get("num_parts") else None

    def partitions(self) -> list[FastqRange]:
        return [FastqRange(uri, a, b) for p in self.paths for uri, size in files(p) for a, b in cut(size, self.parts or max(1, -(-size // self.range_bytes)))]

    def read(self, part: FastqRange) -> Iterator[pa.RecordBatch]:
        if part.begin < part.end:
            yield from record_batches(part.path, part.begin, part.end)


class FastqSource(DataSource):
    """format("fastq"): seq_no is the byte offset of the record in its file, so it orders a file's records and does not depend on ranges."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").options(**{k: str(v) for k, v in options.items()}).load(path)


def split_fastq(df: DataFrame, path: str, parts: int | None = None, size: int | None = None, measure: str = "records") -> DataFrame:
    """Write records(seq_no, header, seq[, qual]) as FASTQ below path/part=N and return (part, records). `parts` deals records by number; `size` cuts where the running
    sum of the measure (records, length or bytes) passes a multiple of it. Running sums are taken within ranges of seq_no first, then over the ranges' totals."""
    qual = F.col("qual") if "qual" in df.columns else F.repeat(F.lit("I"), F.length("seq"))
    text = F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), qual)
    m = {"records": F.lit(1), "length": F.length("seq"), "bytes": F.octet_length(text) + 1}[measure]
    rows = df.select("seq_no", text.alias("value"), m.cast("long").alias("m"))
    if size is None:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("seq_no"), F.lit(parts or 1)).cast("int"))
    else:
        lo, hi = rows.agg(F.min("seq_no"), F.max("seq_no")).first()
        span = max(1, ((hi or 0) - (lo or 0) + 1) // 1024)
        rows = rows.withColumn("range", F.floor((F.col("seq_no") - F.lit(lo or 0)) / span))
        ahead = rows.groupBy("range").agg(F.sum("m").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.sum("m").over(Window.partitionBy("range").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("within", within).join(ahead.select("range", "ahead"), "range").withColumn("part", F.floor((F.col("ahead") + F.col("within") - F.col("m")) / size).cast("int"))
    rows.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
    return rows.groupBy("part").agg(F.count("*").alias("records"))
