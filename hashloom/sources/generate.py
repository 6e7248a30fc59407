"""Seeded data without input: counters, uniform and Zipf keys, join relations.

A row's draw depends on the seed and the row's number alone, not on the partition that makes it, so any number of partitions gives the same
data and a lost task makes the same rows again. Ranges, keys and draws are column expressions; only the rejection sampler is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import GOLDEN, multiply_wrap


def counter(spark: SparkSession, n: int, start: int = 0, parts: int | None = None) -> DataFrame:
    """(key): start, start + 1, ..."""
    return spark.range(start, start + n, 1, parts).select(F.col("id").alias("key")) if parts else spark.range(start, start + n).select(F.col("id").alias("key"))


def repeated(spark: SparkSession, value, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(value).alias("key"))


def draw64(row: Column, seed: int, stream: int = 0) -> Column:
    """64 hashed bits of a row."""
    return F.xxhash64(row, F.lit(seed).cast("long"), F.lit(stream).cast("long"))


def draw_unit(row: Column, seed: int, stream: int = 0) -> Column:
    """A double in [0, 1)."""
    return F.shiftrightunsigned(draw64(row, seed, stream), 11).cast("double") * F.lit(2.0**-53)


def uniform_keys(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(row, key): keys uniform over all 64-bit numbers but 0."""
    key = draw64(F.col("id"), seed)
    return spark.range(n).select(F.col("id").alias("row"), F.when(key == 0, F.lit(1)).otherwise(key).alias("key"))


def hashed_sequence(spark: SparkSession, n: int) -> DataFrame:
    """(row, key): row times the multiplier, wrapped."""
    return spark.range(n).select(F.col("id").alias("row"), multiply_wrap(F.col("id")).alias("key"))


def xorwow(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(row, key): 32-bit draws, in distribution."""
    return spark.range(n).select(F.col("id").alias("row"), F.shiftrightunsigned(draw64(F.col("id"), seed, 9), 32).alias("key"))


def _unit(rows: np.ndarray, seed: int, tries: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) by row, seed and try."""
    x = rows.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64((seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1)) + tries.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def zipf_ranks(rows: np.ndarray, n: int, exponent: float, seed: int) -> np.ndarray:
    """Ranks 1..n with probability as rank^-exponent: draws under the curve x^-exponent are inverted and those outside the steps drawn again."""
    if exponent <= 0 or n < 1:
        raise ValueError("exponent must be above 0 and n at least 1")
    flat = abs(exponent - 1) < 1e-9
    area = (lambda x: np.log(x)) if flat else (lambda x: np.expm1((1 - exponent) * np.log(x)) / (1 - exponent))
    back = (lambda a: np.exp(a)) if flat else (lambda a: np.exp(np.log1p(np.maximum((1 - exponent) * a, -1 + 1e-300)) / (1 - exponent)))
    low, high = area(1.5) - 1.0, area(n + 0.5)
    out, left, t = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
    while len(left):
        a = low + _unit(rows[left], seed, np.full(len(left), t)) * (high - low)
        k = np.clip(np.rint(back(a)), 1, n)
        ok = a >= area(k + 0.5) - k**-exponent
        out[left[ok]] = k[ok].astype(np.int64)
        left, t = left[~ok], t + 1
    return out


def zipf(spark: SparkSession, rows: int, n: int, exponent: float, seed: int = 0) -> DataFrame:
    """(row, rank): ranks from 1."""
    if exponent <= 0:
        raise ValueError("exponent must be above 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(zipf_ranks(b.column(0).to_numpy(), n, exponent, seed))], names=["row", "rank"])

    return spark.range(rows).mapInArrow(run, "row long, rank long")


def zipf_by_table(spark: SparkSession, rows: int, n: int, exponent: float, seed: int = 0) -> DataFrame:
    """(row, rank): ranks from 0, by binary search in the cumulative distribution. The table of n numbers is made in each task, so n is for memory to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.cumsum(np.arange(1, n + 1, dtype=np.float64) ** -exponent)
        table /= table[-1]
        for b in batches:
            u = _unit(b.column(0).to_numpy(), seed, np.zeros(len(b), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(np.searchsorted(table, u), n - 1))], names=["row", "rank"])

    return spark.range(rows).mapInArrow(run, "row long, rank long")


def skewed(spark: SparkSession, rows: int, n: int, theta: float, seed: int = 0) -> DataFrame:
    """(row, rank) with ranks from 0: theta -1 counts up, 0 is uniform, (0, 1) is Zipf, 40 and more is constant 0; what lies between is refused."""
    if theta == -1:
        return spark.range(rows).select(F.col("id").alias("row"), F.pmod("id", F.lit(n)).alias("rank"))
    if theta == 0:
        return spark.range(rows).select(F.col("id").alias("row"), F.floor(draw_unit(F.col("id"), seed) * n).cast("long").alias("rank"))
    if theta >= 40:
        return spark.range(rows).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("rank"))
    if not 0 < theta < 1:
        raise ValueError("theta must be -1, 0, in (0, 1), or at least 40")
    return zipf(spark, rows, n, theta, seed).select("row", (F.col("rank") - 1).alias("rank"))


def zipf_keys(spark: SparkSession, rows: int, n: int, exponent: float, seed: int = 0) -> DataFrame:
    """(row, key): max(1, rank times the multiplier), unsigned and wrapped."""
    key = multiply_wrap(F.col("rank"))
    return zipf(spark, rows, n, exponent, seed).select("row", F.when(key == 0, F.lit(1)).otherwise(key).alias("key"))


def join_relations(spark: SparkSession, r_rows: int, s_rows: int, skew: float = 0.0, hit_rate: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Build side R(row, key) and probe side S(row, key). A probe row is a hit with probability hit_rate and then copies a key of R: any (skew below 0.1) or by a
    Zipf rank; a miss draws a key of its own. A sparse S (under a hundredth of R) draws from as many of R's first rows as it has hundreds."""
    r = uniform_keys(spark, r_rows, seed)
    width = r_rows if s_rows * 100 >= r_rows else max(1, s_rows // 100)
    if skew < 0.1:
        s = spark.range(s_rows).select(F.col("id").alias("row"), F.floor(draw_unit(F.col("id"), seed, 1) * width).cast("long").alias("pick"))
        miss = multiply_wrap(F.col("row") + (seed + 1))
    else:
        s = zipf(spark, s_rows, width, skew, seed + 1).select("row", (F.col("rank") - 1).alias("pick"))
        miss = multiply_wrap(F.col("pick") + 1)
    # R's key is a function of its row, so a hit needs no join
    key = draw64(F.col("pick"), seed)
    hit = draw_unit(F.col("row"), seed, 2) < hit_rate
    return r, s.select("row", F.when(hit, F.when(key == 0, F.lit(1)).otherwise(key)).otherwise(miss).alias("key"))


def with_constant(df: DataFrame, value: int) -> DataFrame:
    """df with the same value in every row."""
    return df.withColumn("value", F.lit(value).cast("long"))


def relation_pair(spark: SparkSession, n: int, ratio: int, seed: int = 0, r_value=lambda k: F.floor(k / 2).cast("long"), s_value=lambda k: k * 2) -> tuple[DataFrame, DataFrame]:
    """R: keys 0..n-1 in random order with r_value of the key; S: each key `ratio` times with s_value."""
    r = spark.range(n).select(F.col("id").alias("key"), r_value(F.col("id")).alias("value"))
    s = spark.range(n * ratio).select(F.pmod("id", F.lit(n)).alias("key"), F.col("id").alias("row"))
    return shuffled(r, ["key"], seed), shuffled(s.select("row", "key", s_value(F.col("key")).alias("value")), ["row"], seed + 1).drop("row")


def bernoulli(df: DataFrame, rate: float, by: list[str], seed: int = 0) -> DataFrame:
    """A sample that keeps each row with probability `rate`, drawn from the columns `by`, which tell rows apart: the same rows however they are partitioned."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    return df.where(draw_unit(F.xxhash64(*by), seed, 4) < rate)


def shuffled(df: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """df in a random order, drawn from the columns `by`, which tell rows apart."""
    return df.orderBy(draw64(F.xxhash64(*by), seed, 6), *by)


def operations(keys: DataFrame, p_read: float, seed: int = 0) -> DataFrame:
    """(seq, op, key, value): first a write of every key, then one operation a key, a read with probability p_read. keys(row, key), rows from 0."""
    first = keys.select(F.col("row").alias("seq"), F.lit("w").alias("op"), "key", F.col("key").alias("value"))
    n = keys.count()
    then = keys.select((F.col("row") + n).alias("seq"), F.when(draw_unit(F.col("row"), seed, 3) < p_read, F.lit("r")).otherwise(F.lit("w")).alias("op"), "key", F.col("key").alias("value"))
    return first.unionByName(then)
