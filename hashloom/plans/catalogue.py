"""Registered queries of the keyed-table engine over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, kmers
from ..operators import joins, kv, stats
from ..session import shared_dir, table
from ..sources import fastq, generate, ranges, text
from ..streaming import upserts

K = 3
HT_SIZE = 1 << 20
BITS = 10


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Probe rows."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("value"))


def _build(spark: SparkSession, d: str) -> DataFrame:
    """Build rows: orders above a price."""
    return table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"), F.col("o_orderkey").alias("seq"))


def kmer_count(spark, d):
    return kmers.kmer_counts(table(spark, d, "documents"), "text", K)


def kmer_topk(spark, d):
    return kmers.kmer_top(table(spark, d, "documents"), "text", K, 20)


def kmer_distinct(spark, d):
    return kmers.kmer_distinct(table(spark, d, "documents"), "text", K)


def kmer_long_reads(spark, d):
    return kmers.kmer_counts(table(spark, d, "pages").select(F.col("html").alias("text")), "text", 4)


def kmer_code_round_trip(spark, d):
    c = kmers.kmer_counts(table(spark, d, "documents"), "text", 4)
    return c.select("kmer", kmers.decode(F.col("code"), 4).alias("decoded"), "code")


def kmer_code_histogram(spark, d):
    return stats.code_histogram(kmers.kmers(table(spark, d, "documents"), "text", K), "code", 16, 0, 64)


def upsert_last(spark, d):
    return kv.upsert(_orders(spark, d), "last")


def insert_first(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return kv.upsert(rows, "first")


def upsert_count(spark, d):
    return kv.upsert(_orders(spark, d), "count")


def upsert_merge(spark, d):
    old = kv.upsert(_orders(spark, d).where("value % 2 = 0"), "last")
    return kv.merge(old, _orders(spark, d).where("value % 2 = 1"), "last")


def kv_lookup(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"))
    return kv.lookup(requests, kv.upsert(_orders(spark, d), "last"))


def kv_partition_lookup(spark, d):
    rows = _orders(spark, d).withColumn("part_id", hashing.radix(F.col("key"), 4))
    tables = rows.groupBy("part_id", "key").agg(kv.combiner("last").alias("value"))
    requests = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key")).withColumn("part_id", hashing.radix(F.col("key"), 4))
    return kv.partition_lookup(requests, tables)


def kv_direct_index(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") - 1).cast("long").alias("value"))
    return kv.direct_index(parts)


def kv_fill(spark, d):
    return kv.table_stats(_orders(spark, d), HT_SIZE)


def kv_upsert_find(spark, d):
    return kv.upsert_then_find(table(spark, d, "events").select(F.col("user_id").alias("key")), 2, 3)


def kv_upsert_find_zipf(spark, d):
    """Upsert and lookup of Zipf keys; which ranks come up is the draw's business, so the number of distinct keys is held against what n draws
    are to give, within six deviations (of independent ranks, which is more than the true one)."""
    n, ranks, exponent = table(spark, d, "events").count(), 1000, 0.9
    got = kv.upsert_then_find(generate.zipf_keys(spark, n, ranks, exponent, 7).select("key"), 1, 2)
    share = np.arange(1, ranks + 1) ** -exponent
    missed = (1 - share / share.sum()) ** n  # the chance that a rank never comes up
    mean, slack = float(ranks - missed.sum()), 6 * float(np.sqrt((missed * (1 - missed)).sum()))
    return got.select("inserted", "found", F.col("fill").between(mean - slack, mean + slack).alias("fill_ok"))


def kv_upsert_find_uniform(spark, d):
    """Upsert and lookup of uniform 64-bit keys, which a few thousand draws never repeat."""
    return kv.upsert_then_find(generate.uniform_keys(spark, table(spark, d, "events").count(), 7).select("key"), 2, 1)


def kv_upsert_find_sequential(spark, d):
    return kv.upsert_then_find(generate.counter(spark, table(spark, d, "events").count()), 1, 1)


def kv_upsert_find_hashed(spark, d):
    """Upsert and lookup of multiples of the hash multiplier, key 0 among them."""
    return kv.upsert_then_find(generate.hashed_sequence(spark, table(spark, d, "events").count()).select("key"), 1, 3)


def kv_direct_upsert(spark, d):
    """Order statuses by customer in a table addressed by position; status F (0) leaves its place empty."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.col("o_orderkey")).cast("long").alias("value"), F.col("o_orderkey").alias("seq"))
    places = kv.direct_upsert(rows, 1 << 40)
    requests = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"))
    return kv.direct_lookup(requests, places)


def kv_dump(spark, d):
    return kv.dump_lines(kv.upsert(_orders(spark, d), "last"))


def kv_routed_upsert(spark, d):
    return kv.routed_upsert(_orders(spark, d), 8).select("key", "value")


def kv_routed_lookup(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"))
    return kv.routed_lookup(requests, kv.routed_upsert(_orders(spark, d), 8), 8)


def hashjoin_found(spark, d):
    return joins.found(_lines(spark, d), _build(spark, d))


def hashjoin_found_broadcast(spark, d):
    return joins.found(_lines(spark, d), _build(spark, d), "broadcast")


def hashjoin_found_merge(spark, d):
    return joins.found(_lines(spark, d), _build(spark, d), "merge")


def hashjoin_materialize(spark, d):
    return joins.materialize(_lines(spark, d), _build(spark, d))


def hashjoin_duplicates(spark, d):
    probe = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"))
    return joins.materialize(probe, _orders(spark, d), "shuffle_hash")


def hashjoin_unmatched(spark, d):
    return joins.unmatched(_lines(spark, d), _build(spark, d)).groupBy("key").agg(F.count("*").alias("cnt"))


def hit_rate(spark, d):
    return joins.hit_rate(_lines(spark, d), _build(spark, d))


def radix_histogram(spark, d):
    return joins.radix_histogram(_lines(spark, d), BITS)


def radix_join(spark, d):
    return joins.radix_join(_lines(spark, d), _build(spark, d), BITS)


def key_skewness(spark, d):
    return table(spark, d, "lineitem").agg(stats.skewness(F.col("l_quantity")).alias("skewness"))


def freq_cdf(spark, d):
    return stats.frequency_cdf(stats.frequencies(table(spark, d, "events"), "user_id"))


def cdf_batches(spark, d):
    return stats.cdf_batches(stats.frequencies(table(spark, d, "events"), "user_id"))


def zipf_slope(spark, d):
    return stats.zipf_slope(stats.frequencies(table(spark, d, "events"), "user_id"))


def collision_rate(spark, d):
    return stats.collision_rate(table(spark, d, "events"), "user_id")


def mixed_read_write(spark, d):
    return kv.mixed_ops(_op_log(spark, d), ["ts", "event_id"]).drop("ts")


def mixed_read_write_counts(spark, d):
    return kv.mixed_counts(_op_log(spark, d), seq=["ts", "event_id"])


def _op_log(spark, d):
    """Events as an operation log in the order of time and id: even ids write their id, odd ones read."""
    return table(spark, d, "events").select("ts", "event_id", F.when(F.pmod("event_id", F.lit(2)) == 0, "w").otherwise("r").alias("op"), F.col("user_id").alias("key"), F.col("event_id").alias("value"))


def csv_first_field(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value"))
    return text.keyed_rows(lines, "|")


def scalar_functions(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hashing.multiply_wrap(k).alias("hashed"), hashing.next_pow2(k).alias("pow2"), hashing.fast_range(k, 1000).alias("ranged"), hashing.radix(k, 6).alias("digit"), hashing.round_up(k, 64).alias("up"), hashing.round_down(k, 64).alias("down"))


def span_parts(spark, d):
    parts = table(spark, d, "part")
    n = parts.count()
    return text.with_part(parts.select((F.col("p_partkey") - 1).alias("row_id")), 7, "row_id", n).groupBy("part_id").agg(F.count("*").alias("cnt"))


def relation_files(spark, d):
    """Join of two relation files, written from orders and lineitem."""
    root = f"{_scratch(spark)}/relations-{uuid.uuid4().hex}"
    text.write_relation(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), f"{root}/r")
    text.write_relation(_lines(spark, d), f"{root}/s")
    return joins.join_files(spark, f"{root}/r", f"{root}/s")


def fastq_kmers(spark, d):
    """Documents written as FASTQ and read back by the data source, then counted."""
    root = f"{_scratch(spark)}/fastq-{uuid.uuid4().hex}"
    reads = table(spark, d, "documents").select(F.col("doc_id").alias("seq_no"), F.col("doc_id").cast("string").alias("header"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "N").alias("seq"))
    body = F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    reads.select(body.alias("value")).write.text(root)
    return kmers.kmer_counts(fastq.read_fastq(spark, root), "seq", K)


def stream_upsert(spark, d):
    """Orders streamed into a table that must equal the batch upsert."""
    root = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    _orders(spark, d).repartition(3).write.parquet(f"{root}/in")
    upserts.run_to_table(upserts.read_rows(spark, f"{root}/in"), f"{root}/table", f"{root}/state")
    return upserts.read_table(spark, f"{root}/table")


def gen_zipf(spark, d):
    """What holds of any Zipf draw: rows, ranks from 1 to 1000, the first rank's share within a tenth of its due, and a fitted exponent within 0.15 of the true one."""
    n = table(spark, d, "events").count()
    freq = stats.frequencies(generate.zipf(spark, n, 1000, 1.1, 7), "rank")
    top = 1 / sum(r**-1.1 for r in range(1, 1001))
    got = freq.agg(F.sum("cnt").alias("n"), F.min("key").alias("least"), (F.max("key") <= 1000).alias("in_range"), F.max_by("key", "cnt").alias("most_frequent"), (F.abs(F.max("cnt") / F.sum("cnt").cast("double") / top - 1) < 0.1).alias("top_ok"))
    return got.withColumn("exponent_ok", F.lit(abs(stats.zipf_likelihood_exponent(freq, 1000) - 1.1) < 0.15))


def gen_uniform(spark, d):
    """What holds of any uniform draw: rows, no key 0, no key twice, and each sixteenth of the 64-bit range with about its share."""
    n = table(spark, d, "events").count()
    keys = generate.uniform_keys(spark, n, 7)
    per = keys.groupBy("key").agg(F.count("*").alias("c")).groupBy(F.shiftrightunsigned("key", 60).alias("part")).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.count_if(F.col("key") == 0).alias("zeros"))
    return per.select("part", F.col("n").between(n // 16 - 5 * int(n**0.5), n // 16 + 5 * int(n**0.5)).alias("share_ok"), (F.col("n") == F.col("distinct")).alias("no_repeats"), "zeros")


def gen_join(spark, d):
    """Generated join relations: rows of both sides, and whether the hit rate is within 0.02 of the one asked for, for uniform and skewed probes."""
    n = table(spark, d, "orders").count()
    out = None
    for skew in (0.0, 0.8):
        r, s = generate.join_relations(spark, n, 2 * n, skew, 0.7, 7)
        one = joins.hit_rate(s, r).select(F.lit(skew).alias("skew"), F.lit(r.count()).cast("long").alias("r_rows"), F.lit(s.count()).cast("long").alias("s_rows"), (F.abs(F.col("hit_rate") - 0.7) < 0.02).alias("rate_ok"))
        out = one if out is None else out.unionByName(one)
    return out


def gen_relations(spark, d):
    """A relation pair joined: every key of R, `ratio` times, with both values."""
    r, s = generate.relation_pair(spark, table(spark, d, "orders").count(), 3, 7)
    return joins.materialize(s, r.withColumn("seq", F.col("value")))


def kmer_sample(spark, d):
    """A quarter of the k-mers, drawn by document and k-mer: whether its share of each k-mer's documents is near a quarter."""
    rows = kmers.kmers(table(spark, d, "documents"), "text", K, ["doc_id"]).select("doc_id", "code").distinct()
    kept = generate.bernoulli(rows, 0.25, ["doc_id", "code"], 7).withColumn("kept", F.lit(1))
    both = rows.join(kept, ["doc_id", "code"], "left")
    return both.agg(F.count("*").alias("rows"), (F.abs(F.count("kept") / F.count("*").cast("double") - 0.25) < 0.05).alias("share_ok"), F.count_if(F.col("code").between(0, 4**K - 1)).alias("valid"))


def kmer_sql_function(spark, d):
    """k-mers through the registered SQL functions."""
    kmers.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("kmer_documents")
    return spark.sql(f"SELECT kmer, kmer_code(kmer) AS code, count(*) AS cnt FROM (SELECT explode(windows) AS kmer FROM (SELECT kmers(text, {K}) AS windows FROM kmer_documents)) GROUP BY kmer")


def cdf_csv(spark, d):
    """The cumulative curve written as CSV and read back with its header."""
    at = f"{_scratch(spark)}/cdf-{uuid.uuid4().hex}"
    text.write_cdf(cdf_batches(spark, d), at)
    return spark.read.csv(at, header=True, schema="`% of keys` double, `% of values` double").toDF("pct_keys", "pct_values")


def ranged_lines(spark, d):
    """A relation file read in ranges whose ends a callback moves to line ends, with 1, 2 and 7 ranges."""
    at = f"{_scratch(spark)}/ranges-{uuid.uuid4().hex}"
    text.write_relation(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")).coalesce(1), at)
    parse = lambda raw: [tuple(map(int, line.split(b"|"))) for line in raw.split(b"\n") if line]
    out = None
    for n in (1, 2, 7):
        one = ranges.read_ranges(spark, at, n, parse, "key long, value long").agg(F.lit(n).cast("long").alias("parts"), F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("value").alias("vals"))
        out = one if out is None else out.unionByName(one)
    return out


def fastq_broken(spark, d):
    """Reads between lines that are no records, read in 1, 2 and 7 ranges."""
    at = f"{_scratch(spark)}/broken-{uuid.uuid4().hex}"
    seq = F.translate(F.lpad(F.conv(F.col("o_orderkey").cast("string"), 10, 4), 20, "0"), "0123", "ACGT")
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.lit("\nnot a record")).otherwise(F.lit(""))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("@"), F.col("o_orderkey").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("@"), F.lit(20)), bad))
    body = F.coalesce(body, F.concat(F.lit("@"), F.col("o_orderkey").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("+"), F.lit(20)), bad))
    table(spark, d, "orders").select(body.alias("value")).coalesce(1).write.text(at)
    out = None
    for n in (1, 2, 7):
        one = fastq.read_fastq(spark, at, num_parts=n).select(F.lit(n).cast("long").alias("parts"), F.col("header").cast("long").alias("id"), kmers.encode(F.col("seq")).alias("code"))
        out = one if out is None else out.unionByName(one)
    return out


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hashloom"


_KMERS = """
WITH r AS (SELECT unnest(regexp_split_to_array(translate({col}, 'acgt', 'ACGT'), '[^ACGT]+')) AS r FROM {table}),
w AS (SELECT unnest(list_transform(generate_series(1, length(r) - {k} + 1), lambda i: substr(r, i, {k}))) AS kmer FROM r WHERE length(r) >= {k}),
c AS (SELECT kmer, CAST(list_sum(list_transform(generate_series(1, {k}), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * (1 << (2 * ({k} - i))))) AS BIGINT) AS code, count(*) AS cnt FROM w GROUP BY kmer)
"""


def _kmers_sql(tail: str, k: int = K, col: str = "text", name: str = "documents") -> str:
    return _KMERS.format(k=k, col=col, table=name) + tail


_LAST = "SELECT o_custkey AS key, arg_max(o_orderkey, o_orderkey) AS value FROM orders GROUP BY o_custkey"
_BUILD = "SELECT * FROM orders WHERE o_totalprice > 150000"
_FREQ = "SELECT user_id AS key, count(*) AS cnt FROM events GROUP BY user_id"
_FOUND = f"SELECT count(*) AS found FROM lineitem WHERE EXISTS (SELECT 1 FROM ({_BUILD}) b WHERE b.o_orderkey = l_orderkey)"
_LOG = "SELECT ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'w' ELSE 'r' END AS op, user_id AS key, event_id AS value FROM events"
_READ = f"""WITH l AS ({_LOG}), s AS (SELECT event_id, op, key, last_value(CASE WHEN op = 'w' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value FROM l)"""

_CDF = f"""WITH RECURSIVE f AS ({_FREQ}), o AS MATERIALIZED (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, key) AS rk FROM f), t AS (SELECT count(*) AS n, sum(cnt) AS total FROM f),
b(rk, batch, seen, done) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), false
  UNION ALL
  SELECT o.rk, CASE WHEN b.done THEN 0 ELSE b.batch END + o.cnt, b.seen + o.cnt, (CASE WHEN b.done THEN 0 ELSE b.batch END + o.cnt) >= 0.01::DOUBLE * t.total
  FROM b JOIN o ON o.rk = b.rk + 1, t
)
SELECT 100 * rk / n::DOUBLE AS pct_keys, 100 * seen / total::DOUBLE AS pct_values FROM b, t WHERE done"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kmer_count, kmer_topk, kmer_distinct, kmer_long_reads, kmer_code_round_trip, kmer_code_histogram, kmer_sample, kmer_sql_function, fastq_kmers, fastq_broken, ranged_lines,
        upsert_last, insert_first, upsert_count, upsert_merge, kv_lookup, kv_partition_lookup, kv_direct_index, kv_direct_upsert, kv_fill, kv_upsert_find, kv_upsert_find_zipf, kv_upsert_find_uniform, kv_upsert_find_sequential, kv_upsert_find_hashed, kv_dump, kv_routed_upsert, kv_routed_lookup,
        hashjoin_found, hashjoin_found_broadcast, hashjoin_found_merge, hashjoin_materialize, hashjoin_duplicates, hashjoin_unmatched, hit_rate, radix_histogram, radix_join, relation_files,
        key_skewness, freq_cdf, cdf_batches, cdf_csv, zipf_slope, collision_rate, mixed_read_write, mixed_read_write_counts, csv_first_field, scalar_functions, span_parts, stream_upsert,
        gen_zipf, gen_uniform, gen_join, gen_relations,
    )
}

_SQL = {
    "cdf_batches": _CDF,
    "cdf_csv": _CDF,
    "kmer_sql_function": _kmers_sql("SELECT kmer, code, cnt FROM c"),
    "kmer_sample": _KMERS.format(k=K, col="text", table="documents").split("r AS (")[0] + f"""d AS (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'acgt', 'ACGT'), '[^ACGT]+')) AS r FROM documents),
      w AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, length(r) - {K} + 1), lambda i: substr(r, i, {K}))) AS kmer FROM d WHERE length(r) >= {K})
      SELECT count(*) AS rows, true AS share_ok, count(*) AS valid FROM w""",
    "gen_zipf": "SELECT count(*) AS n, CAST(1 AS BIGINT) AS least, true AS in_range, CAST(1 AS BIGINT) AS most_frequent, true AS top_ok, true AS exponent_ok FROM events",
    "gen_uniform": "SELECT i AS part, true AS share_ok, true AS no_repeats, CAST(0 AS BIGINT) AS zeros FROM range(16) t(i)",
    "gen_join": "SELECT skew, (SELECT count(*) FROM orders) AS r_rows, (SELECT 2 * count(*) FROM orders) AS s_rows, true AS rate_ok FROM (VALUES (0.0::DOUBLE), (0.8::DOUBLE)) t(skew)",
    "gen_relations": "SELECT i AS k, 2 * i AS v1, i // 2 AS v2 FROM range((SELECT count(*) FROM orders)) t(i), range(3)",
    "kv_upsert_find_zipf": "SELECT count(*) AS inserted, 2 * count(*) AS found, true AS fill_ok FROM events",
    "kv_upsert_find_uniform": "SELECT 2 * count(*) AS inserted, count(*) AS found, count(*) AS fill FROM events",
    "kv_upsert_find_sequential": "SELECT count(*) AS inserted, count(*) AS found, count(*) - 1 AS fill FROM events",
    "kv_upsert_find_hashed": "SELECT count(*) AS inserted, 3 * count(*) AS found, count(*) - 1 AS fill FROM events",
    "kv_direct_upsert": "SELECT event_id AS id, v AS value FROM events JOIN (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey END, o_orderkey) AS v FROM orders GROUP BY o_custkey) t ON o_custkey = user_id WHERE v <> 0",
    "kv_routed_lookup": f"SELECT event_id AS id, t.value FROM events JOIN ({_LAST}) t ON t.key = user_id",
    "ranged_lines": "SELECT parts, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS vals FROM orders, (VALUES (CAST(1 AS BIGINT)), (2), (7)) p(parts) GROUP BY parts",
    "fastq_broken": "SELECT parts, o_orderkey AS id, o_orderkey AS code FROM orders, (VALUES (CAST(1 AS BIGINT)), (2), (7)) p(parts)",
    "kmer_count": _kmers_sql("SELECT kmer, code, cnt FROM c"),
    "fastq_kmers": _kmers_sql("SELECT kmer, code, cnt FROM c"),
    "kmer_topk": _kmers_sql("SELECT kmer, code, cnt FROM c ORDER BY cnt DESC, code DESC LIMIT 20"),
    "kmer_distinct": _kmers_sql("SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total, count(*) AS n_distinct, count(*) FILTER (WHERE code <> 0) AS fill FROM c"),
    "kmer_long_reads": _kmers_sql("SELECT kmer, code, cnt FROM c", 4, "html", "pages"),
    "kmer_code_round_trip": _kmers_sql("SELECT kmer, kmer AS decoded, code FROM c", 4),
    "kmer_code_histogram": _kmers_sql("SELECT code // 4 + 1 AS bucket, CAST(sum(cnt) AS BIGINT) AS cnt FROM c GROUP BY 1"),
    "upsert_last": _LAST,
    "kv_routed_upsert": _LAST,
    "insert_first": "SELECT o_custkey AS key, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey",
    "upsert_count": "SELECT o_custkey AS key, count(*) AS value FROM orders GROUP BY o_custkey",
    "upsert_merge": "SELECT o_custkey AS key, coalesce(max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END), max(o_orderkey)) AS value FROM orders GROUP BY o_custkey",
    "kv_lookup": f"SELECT event_id AS id, t.value FROM events JOIN ({_LAST}) t ON t.key = user_id",
    "kv_partition_lookup": f"SELECT event_id AS id, t.value FROM events JOIN ({_LAST}) t ON t.key = user_id",
    "kv_direct_index": "SELECT p_partkey AS key, CAST(p_size - 1 AS BIGINT) AS value FROM part WHERE p_size <> 1",
    "kv_fill": f"SELECT count(DISTINCT o_custkey) FILTER (WHERE o_custkey <> 0) AS fill, count(DISTINCT o_custkey) AS n_distinct, max(o_orderkey) AS max_value, CAST({HT_SIZE} AS BIGINT) AS capacity, count(DISTINCT o_custkey) FILTER (WHERE o_custkey <> 0) / CAST({HT_SIZE} AS DOUBLE) AS load_factor FROM orders",
    "kv_upsert_find": "SELECT 2 * count(*) AS inserted, 3 * count(*) AS found, count(DISTINCT user_id) FILTER (WHERE user_id <> 0) AS fill FROM events",
    "kv_dump": f"SELECT '{{' || key || ': ' || value || '}}' AS value FROM ({_LAST})",
    "hashjoin_found": _FOUND,
    "hashjoin_found_broadcast": _FOUND,
    "hashjoin_found_merge": _FOUND,
    "hashjoin_materialize": f"SELECT l_orderkey AS k, l_partkey AS v1, b.v2 FROM lineitem JOIN (SELECT o_orderkey, arg_max(o_custkey, o_orderkey) AS v2 FROM ({_BUILD}) GROUP BY o_orderkey) b ON b.o_orderkey = l_orderkey",
    "hashjoin_duplicates": f"SELECT user_id AS k, event_id AS v1, t.value AS v2 FROM events JOIN ({_LAST}) t ON t.key = user_id",
    "hashjoin_unmatched": f"SELECT l_orderkey AS key, count(*) AS cnt FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ({_BUILD}) b WHERE b.o_orderkey = l_orderkey) GROUP BY l_orderkey",
    "hit_rate": f"SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM ({_BUILD}) b WHERE b.o_orderkey = l_orderkey) THEN 1.0::DOUBLE ELSE 0.0 END) AS hit_rate FROM lineitem",
    "radix_histogram": f"SELECT l_orderkey & {2**BITS - 1} AS p, count(*) AS cnt FROM lineitem GROUP BY 1",
    "radix_join": f"SELECT l_orderkey & {2**BITS - 1} AS p, count(*) AS found FROM lineitem WHERE EXISTS (SELECT 1 FROM ({_BUILD}) b WHERE b.o_orderkey = l_orderkey) GROUP BY 1",
    "relation_files": "SELECT l_orderkey AS k, l_partkey AS v1, o.v2 FROM lineitem JOIN (SELECT o_orderkey, max(o_custkey) AS v2 FROM orders GROUP BY o_orderkey) o ON o.o_orderkey = l_orderkey",
    "freq_cdf": f"SELECT key, cnt, row_number() OVER w AS rk, CAST(sum(cnt) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM ({_FREQ}) WINDOW w AS (ORDER BY cnt DESC, key)",
    "collision_rate": "SELECT 1.0::DOUBLE - count(DISTINCT user_id) / CAST(count(*) AS DOUBLE) AS collision_rate FROM events",
    "mixed_read_write": _READ + " SELECT event_id, key, value FROM s WHERE op = 'r'",
    "mixed_read_write_counts": _READ + " SELECT count(*) FILTER (WHERE op = 'r') AS n_reads, count(*) FILTER (WHERE op = 'w') AS n_writes, count(value) FILTER (WHERE op = 'r') AS n_found FROM s",
    "csv_first_field": "SELECT c_custkey AS key, c_custkey || '|' || c_name || '|' || c_mktsegment AS line FROM customer",
    "scalar_functions": """SELECT l_orderkey, l_linenumber,
      CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hashed,
      CASE WHEN l_orderkey <= 1 THEN 1 ELSE CAST(pow(2, length(ltrim(bin(l_orderkey - 1), '0'))) AS BIGINT) END AS pow2,
      ((l_orderkey & 4294967295) * 1000) >> 32 AS ranged, l_orderkey & 63 AS digit, (l_orderkey + 63) // 64 * 64 AS up, l_orderkey // 64 * 64 AS down
      FROM (SELECT *, (CAST(l_orderkey AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS h FROM lineitem)""",
    "span_parts": "WITH n AS (SELECT count(*) AS n FROM part) SELECT CAST(least((p_partkey - 1) // (n // 7), 6) AS INTEGER) AS part_id, count(*) AS cnt FROM part, n GROUP BY 1",
    "stream_upsert": "SELECT o_custkey AS key, max(o_orderkey) AS value, count(*) AS n FROM orders GROUP BY o_custkey",
    "key_skewness": "SELECT coalesce((avg(q * q * q) - 3 * avg(q) * avg(q * q) + 2 * pow(avg(q), 3)) / pow(avg(q * q) - pow(avg(q), 2), 1.5), 0) AS skewness FROM (SELECT l_quantity AS q FROM lineitem)",
    "zipf_slope": f"SELECT -regr_slope(ln(cnt), ln(rk)) AS slope FROM (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, key) AS rk FROM ({_FREQ}))",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
