"""Line, row and relation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import before, leading_integer

RELATION = "key long, value long"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines ended by a line feed; empty lines are rows, a carriage return stays. Spark splits the files."""
    return spark.read.option("lineSep", "\n").text(path)


def read_relation(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """(key, value) of a headerless delimiter-separated file; what is no number reads as 0."""
    s = F.split(F.col("value"), _literal(delimiter))
    return read_lines(spark, path).select(leading_integer(s[0]).alias("key"), leading_integer(F.coalesce(F.get(s, 1), F.lit(""))).alias("value"))


def _literal(delimiter: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in delimiter)


def keyed_rows(lines: DataFrame, delimiter: str = ",", line: str = "value") -> DataFrame:
    """(key, line): the first field as a number (0 if it is none) and the whole line."""
    return lines.select(leading_integer(before(F.col(line), delimiter)).alias("key"), F.col(line).alias("line"))


def read_keyed_rows(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return keyed_rows(read_lines(spark, path), delimiter)


def write_relation(df: DataFrame, path: str, delimiter: str = "|") -> None:
    df.select("key", "value").write.mode("overwrite").option("sep", delimiter).csv(path)


def with_part(df: DataFrame, num_parts: int, row_id: str, n_rows: int) -> DataFrame:
    """df with part_id: n_rows div num_parts rows each, the remainder in the last; row_id counts from 0."""
    if num_parts < 1:
        raise ValueError("num_parts must be at least 1")
    q = n_rows // num_parts
    part: Column = F.least(F.call_function("div", F.col(row_id), F.lit(q).cast("long")), F.lit(num_parts - 1).cast("long")).cast("int") if q else F.lit(num_parts - 1)
    return df.withColumn("part_id", part)


def from_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """An in-memory scan."""
    return spark.createDataFrame(rows, schema)


def cached(spark: SparkSession, path: str, make, **params) -> DataFrame:
    """make() written as Parquet below path under a name of its parameters, and read from there the next time. An unfinished write is made anew."""
    name = "_".join(f"{k}={params[k]}" for k in sorted(params)) or "data"
    at = f"{path.rstrip('/')}/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_cdf(curve: DataFrame, path: str) -> None:
    """The cumulative curve (pct_keys, pct_values) as CSV with a header."""
    curve.select(F.col("pct_keys").alias("% of keys"), F.col("pct_values").alias("% of values")).write.mode("overwrite").csv(path, header=True)


def write_frequencies(freq: DataFrame, path: str) -> None:
    """(key, cnt) as CSV with a header, in no order."""
    freq.select("key", "cnt").write.mode("overwrite").csv(path, header=True)


def write_numbers(df: DataFrame, column: str, path: str) -> None:
    """One column of 64-bit numbers (k-mer codes, Zipf samples, keys) as Parquet."""
    df.select(F.col(column).cast("long").alias("key")).write.mode("overwrite").parquet(path)
