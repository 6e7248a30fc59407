"""k-mers of DNA-like text as column expressions: two bits a base (A=0, C=1, G=2, T=3), first base most significant.

Only the letters ACGTacgt are bases. Case is folded by a table of these eight letters, not by Unicode rules, under which other
characters would turn into bases. Rows of k-mers come from pieces of a read of at most PIECE windows, so a read as long as a
chromosome never stands as one array of windows. Counts group by the k-mer's text (at most 32 bytes): its code would have to be
computed once a window, and so is computed once a distinct k-mer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
MAX_K = 32
PIECE = 8192


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie in 1..{MAX_K}, not {k}")
    return k


def _folded(seq: Column) -> Column:
    return F.translate(seq, "acgt", BASES)


def _runs(seq: Column, k: int) -> Column:
    return F.filter(F.split(_folded(seq), "[^ACGT]+"), lambda r: F.length(r) >= k)


def _windows(run: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (k - 1)), lambda i: F.substring(run, i, F.lit(k)))


def kmer_array(seq: Column, k: int) -> Column:
    """All windows of k bases, in order; any character that is no base splits the read. Null gives null."""
    check_k(k)
    return F.flatten(F.transform(_runs(seq, k), lambda r: _windows(r, k)))


def kmer_pieces(seq: Column, k: int, piece: int = PIECE) -> Column:
    """The read's runs of bases in pieces of at most `piece` windows each; neighbours overlap by k - 1 bases, so each window is in one."""
    check_k(k)
    cut = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (k - 1), F.lit(piece)), lambda i: F.substring(r, i, F.lit(piece + k - 1)))
    return F.flatten(F.transform(_runs(seq, k), cut))


def encode(kmer: Column) -> Column:
    """Code as the two's-complement bits of the unsigned 64-bit number; upper or lower case."""
    return F.conv(F.translate(_folded(kmer), BASES, "0123"), 4, -10).cast("bigint")


def unsigned(code: Column) -> Column:
    """The bits of a long read as an unsigned number."""
    return F.when(code >= 0, code.cast("decimal(20,0)")).otherwise(code.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)"))


def decode(code: Column, k: int) -> Column:
    """The k-mer of a code, in upper case."""
    return F.translate(F.lpad(F.conv(unsigned(code).cast("string"), 10, 4), check_k(k), "0"), "0123", BASES)


def unsigned_order(code: Column) -> Column:
    """A signed key that sorts as the unsigned code does."""
    return code.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def is_base(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit("^[ACGTacgt]$")), F.lit(False))


def expected_count(length: Column, k: int) -> Column:
    """Windows of k in a run of that length."""
    return F.greatest(length - (k - 1), F.lit(0))


def last_n(seq: Column) -> Column:
    """0-based place of the last N, or -1."""
    at = F.locate("N", F.reverse(F.translate(seq, "n", "N")))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(seq) - at)


def kmers(df: DataFrame, seq: str, k: int, keep: list[str] | None = None) -> DataFrame:
    """One row a k-mer: kmer, code and the kept columns."""
    kept = list(keep or [])
    pieces = df.select(*kept, F.explode(kmer_pieces(F.col(seq), k)).alias("__piece"))
    rows = pieces.select(*kept, F.explode(_windows(F.col("__piece"), k)).alias("kmer"))
    return rows.withColumn("code", encode(F.col("kmer")))


def kmer_counts(df: DataFrame, seq: str, k: int) -> DataFrame:
    """(kmer, code, cnt)."""
    counts = kmers(df, seq, k).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return counts.select("kmer", encode(F.col("kmer")).alias("code"), "cnt")


def register(spark: SparkSession) -> None:
    """SQL functions: kmers(seq, k), the array of windows, and kmer_code(kmer). Their bodies are SQL, so the optimizer sees through them."""
    fold = "translate(seq, 'acgt', 'ACGT')"
    windows = f"flatten(transform(filter(split({fold}, '[^ACGT]+'), r -> length(r) >= k), r -> transform(sequence(1, length(r) - k + 1), i -> substring(r, i, k))))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS ARRAY<STRING> RETURN CASE WHEN k BETWEEN 1 AND {MAX_K} THEN {windows} ELSE raise_error('k must lie in 1..{MAX_K}') END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_code(kmer STRING) RETURNS BIGINT RETURN CAST(conv(translate(kmer, 'ACGTacgt', '01230123'), 4, -10) AS BIGINT)")


def kmer_distinct(df: DataFrame, seq: str, k: int) -> DataFrame:
    """Total k-mers, distinct ones, and distinct ones whose code is not 0 (the table's fill)."""
    c = kmer_counts(df, seq, k)
    return c.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"), F.count("*").alias("n_distinct"), F.count_if(F.col("code") != 0).alias("fill"))


def kmer_top(df: DataFrame, seq: str, k: int, limit: int = 20) -> DataFrame:
    """The most frequent k-mers; equal counts by larger unsigned code first."""
    return kmer_counts(df, seq, k).orderBy(F.desc("cnt"), F.desc(unsigned_order(F.col("code")))).limit(limit)
