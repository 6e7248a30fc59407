"""A bounded stream of upserts into a keyed table.

The stateful aggregation deals rows by key, so each key has one owner; availableNow ends the run when the files that were there are read;
max_files bounds a micro-batch. State is kept for every key, as the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kv import Combine, combiner, lookup

ROW = "key long, value long, seq long"
COMPACT = 8


def read_rows(spark: SparkSession, path: str, schema: str = ROW, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def upserts(rows: DataFrame, combine: Combine = "last") -> DataFrame:
    """The running table (key, value, n): n counts the key's rows."""
    return rows.groupBy("key").agg(combiner(combine).alias("value"), F.count("*").alias("n"))


def _put(changed: DataFrame, batch: int, path: str) -> None:
    """Add a micro-batch's changed keys to the table below path, and every COMPACT batches fold all before it into a base. A batch that is tried
    again writes the same folders again; a base counts once it is whole, and only batches after the newest base are read."""
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if (batch + 1) % COMPACT == 0:
        read_table(spark, path, before=batch).write.mode("overwrite").parquet(f"{path}/base={batch}")


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished batch= or base= folders."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.Path(f"{path}/{kind}=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def run_to_table(rows: DataFrame, path: str, checkpoint: str, combine: Combine = "last") -> StreamingQuery:
    """Run to the end of the input. Each micro-batch writes the keys that changed to path/batch=N; read_table() folds them."""
    q = upserts(rows, combine).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: _put(df, n, path)).start()
    q.awaitTermination()
    return q


def read_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(key, value, n) after the last batch: the newest base, older than `before`, and the at most COMPACT batches since."""
    base = [b for b in _folders(spark, path, "base") if before is None or b < before][-1:]
    since = [b for b in _folders(spark, path, "batch") if not base or b > base[0]]
    parts = [spark.read.parquet(f"{path}/base={b}").withColumn("batch", F.lit(-1)) for b in base] + [spark.read.parquet(f"{path}/batch={b}").withColumn("batch", F.lit(b)) for b in since]
    if not parts:
        return spark.createDataFrame([], "key long, value long, n long")
    rows = reduce(DataFrame.unionByName, parts)
    # a key stands once in a batch; n grows, so it orders a key's rows as the batch does
    return rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"), F.max("n").alias("n"))


def run_with_lookups(rows: DataFrame, requests: DataFrame, path: str, checkpoint: str, combine: Combine = "last") -> DataFrame:
    """As run_to_table, and after each micro-batch requests(id, key) are looked up in the table so far: (batch, id, value), below path/found."""
    spark = rows.sparkSession

    def write(changed: DataFrame, batch: int) -> None:
        _put(changed, batch, f"{path}/table")
        hits = lookup(requests, read_table(spark, f"{path}/table").select("key", "value"))
        hits.write.mode("overwrite").parquet(f"{path}/found/batch={batch}")

    upserts(rows, combine).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/found").parquet(f"{path}/found/batch=*").select("batch", "id", "value")
