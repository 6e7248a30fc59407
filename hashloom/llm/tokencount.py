"""Exact token counts of a corpus for every context limit, from a histogram of encoded lengths.

Each whole text is encoded once by a byte-level BPE; documents are then counted by length (partial counts before the shuffle), and
suffix sums over the written histogram answer, for every limit L: documents and tokens at or above L, tokens kept if texts are cut
at L, and any quantile. Suffix sums run in two levels, within blocks of BLOCK lengths and over block totals, so no task holds
more than a block or one row a block (the longest text's tokens over BLOCK, at most 2^31 / BLOCK).

Defined results: a null text is empty; empty texts have length 0 and are counted; repeated rows count each; lengths that tie are
one row; texts of any length are encoded whole; an empty table gives an empty histogram, and answers of null. doc_id and other
columns do not matter to the histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, persist_table, row_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are split before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = 5000
BLOCK = 1024
LIMITS = [1 << k for k in range(7, 21)]
QUANTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_SPACE)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids. Very long runs of white space, which the pattern's matcher cannot hold, are cut out as the pattern would
    cut them (all but the last character, or all at the end) and merged on their own, which gives the same ids."""
    enc = encoding(path)
    out, at = [], 0
    for m in _SPACES.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += encoding(path, r"(?s).+").encode_ordinary(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def token_lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_chunks(b.column(1), 4 << 20):
                n = [len(encode(t, path)) if t else 0 for t in b.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.array(n, np.int64))], names=["doc_id", "n_tokens"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, "doc_id %s, n_tokens long" % docs.schema["doc_id"].dataType.simpleString())


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row a distinct length L = n_tokens, with n_docs of that length and for limit L: docs_from and tokens_from (texts of at least L), tokens_upto
    (texts of at most L), docs_upto, tokens_cut (tokens left when every text is cut at L), and total docs and tokens."""
    h = persist_table(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "tc-lengths")  # read twice below
    h = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t_after"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens", "tokens",
        (F.sum("n_docs").over(within) + F.col("d_after")).alias("docs_from"), (F.sum("tokens").over(within) + F.col("t_after")).alias("tokens_from"),
    )
    upto = F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")
    return out.select("n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"), upto.alias("tokens_upto"), (upto - F.col("tokens") + F.col("n_tokens") * F.col("docs_from")).alias("tokens_cut"), F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"))


def answers(histogram: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, argument, value) from the suffix sums: for each limit the tokens left when texts are cut there ("cut") and the texts that are at least as long
    ("docs_from"), and the length at each quantile (the least length that at least that share of documents has or is below). An empty histogram gives nulls."""
    # the row of the least length that reaches the limit tells what lies at or above it; without one nothing does
    reach = lambda L: F.min(F.when(F.col("n_tokens") >= L, F.struct("n_tokens", "docs_from", "tokens_from")))
    all_ = F.max("total_tokens")
    cut = lambda L: F.coalesce(all_ - reach(L)["tokens_from"] + L * reach(L)["docs_from"], all_)
    at = lambda q: F.min(F.when(F.col("docs_upto") >= F.lit(q) * F.col("total_docs"), F.col("n_tokens")))
    row = lambda kind, argument, value: F.struct(F.lit(kind).alias("kind"), F.lit(float(argument)).alias("argument"), value.cast("long").alias("value"))
    parts = [row("cut", L, cut(L)) for L in limits] + [row("docs_from", L, F.when(all_.isNotNull(), F.coalesce(reach(L)["docs_from"], F.lit(0)))) for L in limits]
    parts += [row("quantile", q, at(q)) for q in quantiles]
    return histogram.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram with its sums (kind length, argument the length), and answers for LIMITS and QUANTILES in column tokens_cut (cut), docs_from or n_tokens (quantile)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = persist_table(length_histogram(token_lengths(docs)), "tc-histogram")
    a = answers(h, LIMITS, QUANTILES)
    of = lambda kind, name: F.when(F.col("kind") == kind, F.col("value")).alias(name)
    told = a.select("kind", "argument", of("quantile", "n_tokens"), of("docs_from", "docs_from"), of("cut", "tokens_cut"))
    rows = h.select(F.lit("length").alias("kind"), F.col("n_tokens").cast("double").alias("argument"), *h.columns)
    return rows.unionByName(told, allowMissingColumns=True)
