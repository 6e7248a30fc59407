"""Statistics of keys and frequencies."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.generate import draw_unit


def skewness(x: Column) -> Column:
    """Population skewness; 0 where all values are equal."""
    return F.coalesce(F.skewness(x), F.lit(0.0))


def collision_rate(df: DataFrame, key: str) -> DataFrame:
    """One row: 1 - distinct / rows."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg((F.lit(1.0) - F.count("*") / F.sum("n").cast("double")).alias("collision_rate"))


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt)."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"))


def _ranked(freq: DataFrame) -> DataFrame:
    """(cnt, keys, rank_from, sum_before): keys of equal counts are told by their number alone, so ranks need one row a distinct count, not one a key.

    The window is one task, over a bounded number of rows: D distinct counts need at least D^2 / 2 rows under them, so 10^13 rows have at most 4.5 million."""
    by = freq.groupBy("cnt").agg(F.count("*").alias("keys"))
    w = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    return by.select("cnt", "keys", (F.coalesce(F.sum("keys").over(w), F.lit(0)) + 1).alias("rank_from"), F.coalesce(F.sum(F.col("keys") * F.col("cnt")).over(w), F.lit(0)).alias("sum_before"))


def frequency_cdf(freq: DataFrame) -> DataFrame:
    """(key, cnt, rk, cum): rank by (cnt desc, key) and running sum of counts.

    The keys are sorted into ranges of about equal size, which are written to the shared folder; ranks and sums run within a range, and a row a range
    tells what lies before it. So a count that most keys have is split like any other."""
    at = f"{shared_dir(freq.sparkSession)}/hashloom/ranges-{uuid.uuid4().hex}"
    freq.select("key", "cnt").repartitionByRange(F.desc("cnt"), "key").withColumn("range", F.spark_partition_id()).write.parquet(at)
    rows = freq.sparkSession.read.parquet(at)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("cnt").alias("s"))
    per = per.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    w = Window.partitionBy("range").orderBy(F.desc("cnt"), "key")
    own = rows.select("key", "cnt", "range", F.row_number().over(w).alias("pos"), F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return own.join(per, "range").select("key", "cnt", (F.col("pos") + F.col("n")).cast("bigint").alias("rk"), (F.col("upto") + F.col("s")).cast("bigint").alias("cum"))


_HEAD = 64


def _sum_to(m: Column, f, f1, f3, antiderivative) -> Column:
    """Sum of f(1) ... f(m): from a table up to _HEAD, beyond it by the Euler-Maclaurin formula, whose next term is below 1e-13. f, its first and third derivative and its antiderivative
    take a number or a Column (through the module of functions that they are given)."""
    head = [0.0]
    for r in range(1, _HEAD + 1):
        head.append(head[-1] + f(math, float(r)))
    tail = lambda mod, x: antiderivative(mod, x) + f(mod, x) / 2 + f1(mod, x) / 12 - f3(mod, x) / 720
    x = m.cast("double")
    far = F.lit(head[-1] - tail(math, float(_HEAD))) + tail(F, x)
    return F.when(m <= _HEAD, F.get(F.array(*[F.lit(h) for h in head]), m.cast("int"))).otherwise(far)


def _sum_log(m: Column) -> Column:
    return _sum_to(m, lambda k, x: k.log(x), lambda k, x: 1 / x, lambda k, x: 2 / (x * x * x), lambda k, x: x * k.log(x) - x)


def _sum_log2(m: Column) -> Column:
    return _sum_to(
        m, lambda k, x: k.log(x) * k.log(x), lambda k, x: 2 * k.log(x) / x, lambda k, x: (4 * k.log(x) - 6) / (x * x * x),
        lambda k, x: x * k.log(x) * k.log(x) - 2 * x * k.log(x) + 2 * x,
    )


def _runs(freq: DataFrame) -> DataFrame:
    """A row a distinct count: keys, cnt, and sums of ln(rank) and its square over the run of ranks that its keys have."""
    a, b = F.col("rank_from") - 1, F.col("rank_from") + F.col("keys") - 1
    return _ranked(freq).select("keys", "cnt", (_sum_log(b) - _sum_log(a)).alias("x"), (_sum_log2(b) - _sum_log2(a)).alias("xx"))


def zipf_slope(freq: DataFrame) -> DataFrame:
    """One row: slope, minus the slope of ln(cnt) on ln(rank). It needs a row a distinct count: keys of one count take a run of ranks, over which the sums of logarithms are known."""
    y, n = F.log(F.col("cnt").cast("double")), F.col("keys").cast("double")
    s = _runs(freq).agg(F.sum(n).alias("n"), F.sum("x").alias("x"), F.sum(n * y).alias("y"), F.sum("xx").alias("xx"), F.sum(F.col("x") * y).alias("xy"))
    top, bottom = F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    return s.select(F.when(F.col("n") > 1, -top / bottom).alias("slope"))


def cdf_batches(freq: DataFrame, step: float = 0.01) -> DataFrame:
    """(pct_keys, pct_values), in percent: counts from the largest, a row each time a batch reaches `step` of all values; a last, smaller batch gives none.

    The batches reset as they fill, which is sequential; it runs in one task over one row a distinct count (bounded as in _ranked)."""
    import pandas as pd

    ahead = _ranked(freq).select("cnt", "keys")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cnt", ascending=False)
        n, total = int(pdf["keys"].sum()), int((pdf["keys"] * pdf["cnt"]).sum())
        need, out, seen, keys_seen, batch = step * total, [], 0, 0, 0
        for cnt, keys in zip(pdf["cnt"].tolist(), pdf["keys"].tolist(), strict=True):
            while keys:
                # keys of this count until the batch is full
                take = min(keys, max(1, math.ceil((need - batch) / cnt)))
                batch, seen, keys_seen, keys = batch + take * cnt, seen + take * cnt, keys_seen + take, keys - take
                if batch >= need:
                    out.append((100 * keys_seen / n, 100 * seen / total))
                    batch = 0
        return pd.DataFrame(out, columns=["pct_keys", "pct_values"])

    return ahead.groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: fold(pdf), "pct_keys double, pct_values double")


def code_histogram(df: DataFrame, code: str, bins: int, low: float, high: float) -> DataFrame:
    """(bucket, cnt): codes in equal bins, fullest first."""
    return df.groupBy(F.width_bucket(F.col(code).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "bucket")


def expected_overflow(balls: int, bins: int, capacity: int) -> float:
    """Balls that find their bin full, if bins hold `capacity`: expected number, by the Poisson approximation."""
    mean, p, out, k = balls / bins, math.exp(-balls / bins), 0.0, 0
    while k <= capacity + 20 * (1 + math.sqrt(mean)) + mean:
        if k > capacity:
            out += (k - capacity) * p
        k += 1
        p *= mean / k
    return out * bins


def simulated_overflow(spark: SparkSession, balls: int, bins: int, capacity: int, seed: int = 0) -> DataFrame:
    """One row: overflow, the balls that find their bin full when each ball picks one of `bins` at random."""
    per = spark.range(balls).groupBy(F.floor(draw_unit(F.col("id"), seed, 5) * bins).alias("bin")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.greatest(F.col("n") - capacity, F.lit(0))), F.lit(0)).alias("overflow"))


def zipf_likelihood_exponent(freq: DataFrame, ranks: int) -> float:
    """Exponent that makes the counts likeliest under a Zipf law over `ranks` ranks. Two sums leave the executors; the rest is one variable over a vector of `ranks` numbers."""
    import numpy as np

    n, s = _runs(freq).agg(F.sum(F.col("keys") * F.col("cnt")), F.sum(F.col("cnt") * F.col("x"))).first()
    log_r = np.log(np.arange(1, ranks + 1, dtype=np.float64))
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        w = np.exp(-mid * log_r)
        lo, hi = (mid, hi) if (w @ log_r) / w.sum() > s / n else (lo, mid)
    return (lo + hi) / 2


def throughput(rows: DataFrame) -> DataFrame:
    """(ops, seconds) of shards as one row: total ops, longest and mean time, operations a second."""
    return rows.agg(F.sum("ops").alias("ops"), F.max("seconds").alias("longest_s"), F.avg("seconds").alias("mean_s"), (F.sum("ops") / F.max("seconds")).alias("ops_per_s"))
