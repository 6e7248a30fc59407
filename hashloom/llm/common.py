"""What the training-data operators share: shared-folder tables, Arrow text buffers, word spans, hashing."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

U64 = np.uint64


#: Rows of an Arrow batch between the JVM and Python: whole texts stand in them, in both processes.
BATCH_ROWS = 1024


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. Its tables stay while results that read them may be asked for; release() ends that."""
    return f"{shared_dir(spark)}/hashloom/{spark.sparkContext.applicationId}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all that operators have written for this application: intermediate tables, windows, archives. Results that were not written elsewhere are lost with them."""
    drop_path(spark, scratch_dir(spark))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(fn, schema) with memory in bounds: batches hold at most BATCH_ROWS rows (set in the session; Spark's default of 10,000 whole texts takes
    hundreds of MB in the JVM and in Python), and workers give back what a task leaves unused."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(_frugal(fn), schema)


def _frugal(fn: Callable) -> Callable:
    """fn, giving unused memory back to the system when its task ends: workers are kept, and what each keeps adds up over operators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64; wraps."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def whole_rows(docs: DataFrame) -> DataFrame:
    """docs as one struct column `row`, for functions that pass rows through; row_text() has its texts, so that they cross to Python once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def row_text(batch: pa.RecordBatch) -> pa.Array:
    rows = batch.column(0)
    text = rows.field(rows.type.get_field_index("text"))
    return text if pa.types.is_string(text.type) else text.cast(pa.string())


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def row_chunks(col: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges whose texts hold at most max_bytes together; a longer text is a range of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    offs = text_buffer(col)[1]
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of words in concatenated texts: starts, ends, and words per text (counts). is_word: 256 booleans."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    w = is_word[raw]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:n])
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    both = cut[w[cut] & w[cut - 1]]  # a text ends and the next begins inside a run of word bytes
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


_RNG = np.random.default_rng(20240117)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
MULT = U64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    p = np.empty(max(n, 1), U64)
    p[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        step = p[k - 1 : k] * MULT
        p[k : k + m] = p[:m] * step
        k += m
    return p


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial in an odd constant over random byte codes, mixed with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    at = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    pw = _powers(int(lens.max()))
    codes = BYTE_CODE[raw[np.repeat(starts, lens) + at]]
    codes *= pw[at]
    h = np.add.reduceat(codes, first)
    return mix64(h ^ (lens.astype(U64) * U64(0xD6E8FEB86659FD93)))
