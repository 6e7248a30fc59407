"""Files read in byte ranges whose ends a callback moves to record boundaries.

A range [begin, end) of n equal ones owns the bytes from boundary(begin) up to boundary(end), so every byte has one owner for any n
as long as the callback is a function of the file and the offset. Offsets 0 and the file's size are not moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: (file, offset) -> offset of the record that begins at or after it.
Boundary = Callable[[pa.NativeFile, int], int]
STEP = 1 << 20


def next_line(file: pa.NativeFile, offset: int) -> int:
    """The first offset after a line feed that stands at `offset` or later; the file's size without one."""
    file.seek(offset)
    while block := file.read(STEP):
        at = block.find(b"\n")
        if at >= 0:
            return offset + at + 1
        offset += len(block)
    return offset


def files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the files at a path, or of those in a folder, by name; names that begin with . or _ are not data."""
    fs, name = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(name)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File]
    return [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if not f.base_name.startswith((".", "_"))]


def cut(size: int, parts: int) -> list[tuple[int, int]]:
    at = [size * i // parts for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def read_ranges(spark: SparkSession, path: str, parts: int, parse: Callable[[bytes], list], schema: str, boundary: Boundary = next_line) -> DataFrame:
    """parse(bytes of a range) as rows of schema, a range a task; `boundary` decides where ranges end. A range is held in memory, so choose parts by size."""
    ranges = [(uri, size, a, b) for uri, size in files(path) for a, b in cut(size, parts)]
    fields = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as f:
                    first, last = (x if x in (0, size) else boundary(f, x) for x in (a, b))
                    if first >= last:
                        continue
                    f.seek(first)
                    rows = parse(f.read(last - first))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=fields)

    frame = spark.createDataFrame(ranges, "uri string, size long, a long, b long") if ranges else spark.createDataFrame([], "uri string, size long, a long, b long")
    return frame.repartition(max(1, len(ranges))).mapInArrow(run, schema)
