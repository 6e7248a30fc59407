"""Foreign-key joins: semi-join counts, materialised joins, and joins by radix partition.

The build side's duplicates fold to one row a key first (last wins), so a probe row matches at most once and a hot build key
is one row in a join's hash table. Strategy is left to Catalyst and adaptive execution unless asked for: `strategy` gives the
planner a hint, and "broadcast" is taken only where the build side, before it folds, has at most `broadcast_rows` rows
(one count, which Parquet answers from its footers); beyond that the join is planned without it.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import radix
from .kv import upsert

Strategy = Literal["auto", "broadcast", "shuffle_hash", "merge"]
BROADCAST_ROWS = 1_000_000


def _hinted(build: DataFrame, folded: DataFrame, strategy: Strategy, broadcast_rows: int) -> DataFrame:
    if strategy == "broadcast":
        return F.broadcast(folded) if build.count() <= broadcast_rows else folded
    return folded if strategy == "auto" else folded.hint(strategy)


def matched(probe: DataFrame, build: DataFrame, strategy: Strategy = "auto", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Probe rows whose key the build side has."""
    keys = build.select("key").distinct()
    return probe.join(_hinted(build, keys, strategy, broadcast_rows), "key", "left_semi")


def unmatched(probe: DataFrame, build: DataFrame) -> DataFrame:
    """Probe rows whose key the build side lacks (an extension: the complement of matched)."""
    return probe.join(build.select("key").distinct(), "key", "left_anti")


def found(probe: DataFrame, build: DataFrame, strategy: Strategy = "auto") -> DataFrame:
    """One row: found, the number of probe rows with a match."""
    return matched(probe, build, strategy).agg(F.count("*").alias("found"))


def materialize(probe: DataFrame, build: DataFrame, strategy: Strategy = "auto", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k, v1, v2): probe(key, value) with the build side's last value; build(key, value, seq)."""
    last = upsert(build, "last").withColumnRenamed("value", "v2")
    return probe.select("key", F.col("value").alias("v1")).join(_hinted(build, last, strategy, broadcast_rows), "key").select(F.col("key").alias("k"), "v1", "v2")


def hit_rate(probe: DataFrame, build: DataFrame) -> DataFrame:
    """One row: hit_rate, the share of probe rows with a match; null without rows. Keys are counted before the join, so a hot key is one row."""
    keys = build.select("key").distinct().withColumn("hit", F.lit(1))
    per = probe.groupBy("key").agg(F.count("*").alias("n")).join(keys, "key", "left")
    return per.agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n").cast("double")).alias("hit_rate"))


def radix_histogram(rows: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """(p, cnt): rows a radix partition."""
    return rows.groupBy(radix(F.col(key), bits).alias("p")).agg(F.count("*").alias("cnt"))


def radix_partition(rows: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """Rows with their partition number p."""
    return rows.withColumn("p", radix(F.col(key), bits))


def radix_join(probe: DataFrame, build: DataFrame, bits: int = 10) -> DataFrame:
    """(p, found): matches a radix partition. Both sides are dealt by (p, key), each once: the probe side as counts of its keys (a hot key is
    a row a task), the build side as distinct keys; partitions are joined by hash and their matches added up."""
    n = radix_partition(probe.select("key"), bits).groupBy("p", "key").agg(F.count("*").alias("n"))
    keys = radix_partition(build.select("key"), bits).groupBy("p", "key").agg(F.lit(1).alias("one"))
    return n.join(keys.hint("shuffle_hash"), ["p", "key"]).groupBy("p").agg(F.sum("n").alias("found"))


def write_partitioned(rows: DataFrame, name: str, bits: int, path: str | None = None) -> DataFrame:
    """rows as table `name` in 2^bits buckets of the key, each sorted: the scatter phase, done once for any number of joins. Two tables of as many
    buckets join on the key without a shuffle."""
    w = rows.write.mode("overwrite").bucketBy(1 << bits, "key").sortBy("key")
    (w.option("path", path) if path else w).saveAsTable(name)
    return rows.sparkSession.table(name)


def join_files(spark, path_r: str, path_s: str, delimiter: str = "|") -> DataFrame:
    """(k, v1, v2) of two delimiter-separated relation files; in R the larger value of a repeated key stays."""
    from ..sources.text import read_relation

    r, s = read_relation(spark, path_r, delimiter), read_relation(spark, path_s, delimiter)
    return materialize(s, r.withColumn("seq", F.col("value")))  # equal seqs are equal values
