"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are the runs of `words` words (split at white space) that end at each of its words, padded at the
start, so a text of n words has n and even the shortest texts share what they share. The sketch is the K least distinct
64-bit shingle hashes, ascending. Sketches merge across parts by union; they estimate resemblance, containment and the
number of distinct shingles.

Defined results: null is the empty text; word-less texts have the empty sketch, like one another fully and others not at
all; equal texts have equal fingerprints; texts of any length are sketched whole; documents with equal doc_id are ordered by
a hash of their text, then by the text; a null doc_id comes last in descending order; repeated rows each get a row; a single
document is its own successor; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import slice_of
from .common import persist_table

WORDS = 5
K = 128
ROWS_A_RANGE = 1500
MOST_CUTS = 4096


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """df with the bottom-k sketch of a text column. Word hashes are a column of their own, so that shingles read them and don't hash words again."""
    tmp = f"__{out}_hashes"
    hashes = F.transform(F.filter(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn(tmp, F.concat(F.array_repeat(F.lit(0).cast("long"), words - 1), hashes))
    n = F.size(tmp) - (words - 1)
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(tmp), i + j) for j in range(words)]))
    least = F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)
    return df.withColumn(out, F.when(n > 0, least).otherwise(F.array().cast("array<long>"))).drop(tmp)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness of the shingle sets: the share of the merged sketch that is in both. Exact while the union has at most k."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def encode(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _ranges(df: DataFrame) -> DataFrame:
    """df(key, h, ...) with `range`, which ascends with (key, h) and cuts rows into parts of about ROWS_A_RANGE.

    Keys are cut at their quantiles (MOST_CUTS at most, by binary search), what lies between two cuts in equal steps; a key that fills
    several quantiles by itself gets a slice of its own, which is cut in equal steps of h. So neither many rows nor one hot key make a large part."""
    rows = df.count()
    cuts = max(1, min(MOST_CUTS, rows // ROWS_A_RANGE))
    if cuts == 1:
        return df.withColumn("range", F.lit(0).cast("long"))
    found = df.agg(F.percentile_approx("key", [i / cuts for i in range(1, cuts)], 20 * cuts)).first()[0]
    steps = max(1, rows // cuts // ROWS_A_RANGE)
    hot = {k: n for k, n in Counter(found).items() if n > 1}
    at = sorted({*found, *(max(k - 1, -(2**63)) for k in hot)})
    df, slice_ = df.withColumn("__slice", slice_of(F.col("key"), at)), F.col("__slice")
    part = lambda x, lo, hi, n: F.least(F.floor((x.cast("double") - lo) / (hi - lo) * n), n - 1).cast("long")
    ends = F.array(*[F.lit(float(c)) for c in [-(2.0**63), *at, 2.0**63]])
    lo, hi = F.get(ends, slice_), F.get(ends, slice_ + 1)
    inner = part(F.col("key"), lo, F.greatest(hi, lo + 1), F.lit(steps)) if steps > 1 else F.lit(0).cast("long")
    sub = inner
    if hot:
        own = F.create_map(*[F.lit(x) for k, n in hot.items() for x in (at.index(k), n * steps)])[slice_]
        sub = F.when(own.isNotNull(), part(F.col("h"), F.lit(-(2.0**63)), F.lit(2.0**63), own)).otherwise(inner)
    return df.withColumn("range", F.shiftleft(slice_.cast("long"), 40) + sub).drop("__slice")


def _next_in_descending(df: DataFrame, carry) -> DataFrame:
    """df(key, text, ...) with carry(df)'s columns and next_<c> for each of them and the text: of the row that follows in descending (key, h, text), after the last the first.

    Each range also gets a copy of the first row of the range that follows, so every row finds its successor within its own range: one
    shuffle of texts. Firsts are found by their numbers before any text is compared."""
    df = _ranges(df.withColumn("h", F.xxhash64("text")))
    keys = df.select("range", "key", "h")
    tops = keys.groupBy("range").agg(F.max("key").alias("key"))
    tops = keys.join(tops, ["range", "key"]).groupBy("range", "key").agg(F.max("h").alias("h"))
    # (one row a range)
    tops = persist_table(tops.withColumn("ahead", F.lag("range").over(Window.orderBy("range"))).withColumn("last", F.max("range").over(Window.partitionBy())), "fp-tops")
    # in descending order a range's successor is the next lower one, so its first row goes to the next higher
    up = tops.select(F.col("ahead").alias("range"), F.col("range").alias("to")).where("range is not null").unionByName(tops.where("ahead is null").select(F.col("last").alias("range"), F.col("range").alias("to")))
    firsts = df.join(tops.select("range", "key", "h"), ["range", "key", "h"]).groupBy("range", "key", "h").agg(F.max("text").alias("text"))
    firsts = firsts.join(up, "range").select(F.col("to").alias("range"), "key", "h", "text")
    rest = [c for c in df.columns if c not in ("range", "key", "h", "text")]
    firsts = firsts.select("range", "key", "h", "text", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest], F.lit(1).alias("copy"))
    both = carry(df.withColumn("copy", F.lit(0)).unionByName(firsts))
    names = ["text", *[c for c in both.columns if c not in df.columns and c != "copy"]]
    w = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.desc("h"), F.desc("text"))
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in names]).where("copy = 0").drop("copy", "range", "h")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, text, sketch) for each row; a null text is empty."""
    return with_sketch(_texts(docs), "text", "sketch", words, k)


def edited_fingerprints(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch): edited has its last third of code points replaced by the start of the next document, in descending doc_id."""
    base = _texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    # a text is sketched once; its predecessor gets the sketch with the text
    df = _next_in_descending(base, lambda df: with_sketch(df, "text", "sketch", words, k))
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    m = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - m), F.substring("next_text", F.lit(1), m)))
    return with_sketch(df, "edited", "edited_sketch", words, k).drop("text", "next_text", "key")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
