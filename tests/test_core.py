"""Golden inputs of the keyed table, k-mers, joins, statistics, sources and generators."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from hashloom.functions import hashing, kmers
from hashloom.operators import joins, kv, stats
from hashloom.plans import catalogue
from hashloom.sources import fastq, generate, ranges, text
from hashloom.streaming import upserts

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(df):
    return tuple(df.first())


@pytest.mark.parametrize(
    ("seq", "k", "want"),
    [
        ("AGGAGGTAA", 4, "AGGA GGAG GAGG AGGT GGTA GTAA"),
        ("AGGAGGTAA", 8, "AGGAGGTA GGAGGTAA"),
        ("AGGNNAGGTANA", 4, "AGGT GGTA"),
        ("AGGNNAGGTANA", 8, ""),
        ("acgtACGT", 4, "ACGT CGTA GTAC TACG ACGT"),
        ("", 3, ""),
    ],
)
def test_kmers(spark, seq, k, want):
    got = spark.createDataFrame([(seq,)], "s string").select(kmers.kmer_array(F.col("s"), k).alias("a")).first()["a"]
    assert got == want.split()


def test_only_eight_letters_are_bases(spark):
    """Characters that Unicode rules would fold onto bases split the read like any other."""
    texts = ["A\u1e97G\u1e9aC", "A\ufb05CG", "a\u0131CG\u212aT", "ACgt"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(kmers.kmer_array(F.col("s"), 2)).collect()]
    assert got == [[], ["CG"], ["CG"], ["AC", "CG", "GT"]]
    kmers.register(spark)
    assert spark.sql("SELECT kmers('A\ufb05CGn', 2), kmer_code('aggt')").first()[:] == (["CG"], 43)


def test_long_reads_come_in_pieces(spark):
    read = "".join("ACGT"[(i * i // 7) % 4] for i in range(2000)) + "N" + "ACG" * 50
    df = spark.createDataFrame([(read,)], "s string")
    for piece in (1, 10, 1993, 5000):
        got = df.select(F.explode(kmers.kmer_pieces(F.col("s"), 8, piece)).alias("p")).collect()
        assert [r["p"][i : i + 8] for r in got for i in range(len(r["p"]) - 7)] == df.select(kmers.kmer_array(F.col("s"), 8)).first()[0]
    kmers.PIECE, old = 64, kmers.PIECE
    assert sum(r["cnt"] for r in kmers.kmer_counts(df, "s", 8).collect()) == 1993 + 143
    kmers.PIECE = old


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Hash aggregates for the core operator, joins on folded build sides, no hot count, no routing of raw rows."""
    ops = spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id").alias("value"), F.col("id").alias("seq"))
    for combine in ("last", "first", "count"):
        assert "SortAggregate" not in plan(kv.upsert(ops, combine)) and "HashAggregate" in plan(kv.upsert(ops, combine))
    assert plan(kv.upsert(ops)).count("Exchange") == 1
    for df in (joins.matched(ops, ops), joins.unmatched(ops, ops)):
        assert plan(df).count("HashAggregate") == 2
    assert plan(joins.radix_join(ops, ops, 4)).count("ShuffledHashJoin") == 1 and "Join" not in plan(stats.zipf_slope(stats.frequencies(ops, "key")))
    routed = plan(kv.routed_upsert(ops, 8))
    assert "partial_max_by" in routed and "REPARTITION" not in routed
    log = ops.withColumn("op", F.lit("w"))
    assert "BroadcastNestedLoop" not in plan(kv.mixed_counts(log)) and "Cartesian" not in plan(kv.mixed_counts(log))


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    ops = spark.range(1000).select((F.col("id") * 3).alias("key"), F.col("id").alias("value"), F.col("id").alias("seq"))
    r, s = (joins.write_partitioned(ops.where(c), f"radix_{n}", 3, str(tmp_path / n)) for n, c in (("r", "value < 500"), ("s", "value >= 400")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = s.join(r, "key")
        assert both.count() == 100 and "Exchange" not in plan(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE radix_r")
        spark.sql("DROP TABLE radix_s")


def test_kmer_codes(spark):
    df = spark.createDataFrame([("AGGT",), ("T" * 32,), ("A" * 32,), ("G" + "C" * 31,)], "k string").withColumn("c", kmers.encode(F.col("k")))
    got = {r["k"]: r["c"] for r in df.collect()}
    assert got["AGGT"] == 43 and got["T" * 32] == -1 and got["A" * 32] == 0
    back = df.where("length(k) = 32").select("k", kmers.decode(F.col("c"), 32).alias("d")).collect()
    assert all(r["k"] == r["d"] for r in back)
    top = kmers.kmer_top(spark.createDataFrame([("T" * 32 + "N" + "A" * 32,)], "s string"), "s", 32, 2).collect()
    assert [r["kmer"][0] for r in top] == ["T", "A"]  # unsigned order
    with pytest.raises(ValueError):
        kmers.check_k(33)


def test_base_predicates(spark):
    df = spark.createDataFrame([("A",), ("n",), ("t",)], "b string")
    assert [r[0] for r in df.select(kmers.is_base(F.col("b"))).collect()] == [True, False, True]
    df = spark.createDataFrame([("ACGNA",), ("ACG",)], "b string")
    assert [r[0] for r in df.select(kmers.last_n(F.col("b"))).collect()] == [3, -1]


def test_wrapping_arithmetic(spark):
    xs = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for r in df.select("x", hashing.multiply_wrap(F.col("x")).alias("y")).collect():
        assert r["y"] % 2**64 == r["x"] * hashing.GOLDEN % 2**64
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 1024, 1025)], "v long").select(hashing.next_pow2(F.col("v"))).collect()]
    assert got == [1, 1, 2, 4, 1024, 2048]


def test_keyed_table(spark):
    ops = spark.createDataFrame([(12, 128, 0), (23, 256, 1), (12, 1025, 2), (23, 4097, 3), (0, 5, 4)], "key long, value long, seq long")
    ask = spark.createDataFrame([(123, 12), (321, 23), (7, 99), (8, 0), (9, 0)], "id long, key long")
    assert rows(kv.lookup(ask, kv.upsert(ops))) == [(8, 5), (9, 5), (123, 1025), (321, 4097)]
    assert rows(kv.upsert(ops, "first")) == [(0, 5), (12, 128), (23, 256)]
    assert rows(kv.upsert(ops, "count")) == [(0, 1), (12, 2), (23, 2)]
    squares = spark.range(1024).select(F.col("id").alias("key"), (F.col("id") * F.col("id")).alias("value"), F.col("id").alias("seq"))
    got = kv.lookup(spark.range(1024).select((F.col("id") * 2).alias("id"), F.col("id").alias("key")), kv.upsert(squares))
    assert rows(got) == [(2 * i, i * i) for i in range(1024)]
    keys = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "key long, value long")
    assert one(kv.fill(keys)) == (1, 2)
    assert one(kv.table_stats(keys, 5)) == (1, 2, 3, 8, 0.125)
    assert rows(kv.merge(kv.upsert(ops), spark.createDataFrame([(12, 1, 0)], "key long, value long, seq long"))) == [(0, 5), (12, 1), (23, 4097)]
    assert rows(kv.dump_lines(kv.upsert(ops)))[0] == ("{0: 5}",)
    with pytest.raises(ValueError):
        kv.upsert(ops, "sum")


def test_ties_and_nulls(spark):
    same = spark.createDataFrame([(1, 5, 0), (1, 9, 0), (2, None, 1), (2, 3, 0), (None, 4, 0), (None, 6, 1)], "key long, value long, seq long")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in kv.upsert(same, ties=True).collect()), key=key) == [(1, 9), (2, None), (None, 6)]
    assert sorted((tuple(r) for r in kv.upsert(same, "first", ties=True).collect()), key=key) == [(1, 5), (2, 3), (None, 4)]


def test_lookups_by_place_owner_and_callback(spark, tmp_path):
    ops = spark.createDataFrame([(0, 5, 0), (3, 7, 1), (3, 0, 2), (9, 1, 3)], "key long, value long, seq long")
    ask = spark.createDataFrame([(10, 0), (11, 3), (12, 9), (13, 4)], "id long, key long")
    assert rows(kv.direct_lookup(ask, kv.direct_upsert(ops, 10))) == [(10, 5), (12, 1)]
    with pytest.raises(Exception, match="no such place: 9"):
        kv.direct_upsert(ops, 9).collect()
    assert rows(kv.routed_lookup(ask, kv.routed_upsert(ops, 3), 3)) == [(10, 5), (11, 0), (12, 1)]
    out = str(tmp_path)
    kv.lookup_each(ask, kv.upsert(ops), lambda r: open(f"{out}/{r['id']}", "w").write(str(r["value"])))
    assert {n: open(f"{out}/{n}").read() for n in os.listdir(out)} == {"10": "5", "11": "0", "12": "1"}
    assert one(kv.upsert_then_find(ask.select("key"), 0, 2)) == (0, 0, 0)
    assert one(kv.upsert_then_find(spark.createDataFrame([(0,), (1,), (1,)], "key long"), 2, 3)) == (6, 9, 1)


def test_sliced_logs(spark):
    """However a log is sliced, reads see the same; a key's writes of null are no writes."""
    log = spark.range(600).select(
        F.floor(F.col("id") / 3).alias("at"), F.col("id").alias("seq"), F.when(F.xxhash64("id") % 3 == 0, "w").otherwise("r").alias("op"),
        F.when(F.col("id") % 50 == 7, None).otherwise(F.xxhash64("id", F.lit(1)) % 4).alias("key"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("value"),
    )
    want = sorted(map(str, kv.mixed_ops(log, ["at", "seq"], slices=1).collect()))
    counts = one(kv.mixed_counts(log, ["at", "seq"], slices=1))
    for n in (2, 7, 100):
        assert sorted(map(str, kv.mixed_ops(log, ["at", "seq"], slices=n).collect())) == want
        assert one(kv.mixed_counts(log, ["at", "seq"], slices=n)) == counts
    assert kv.mixed_ops(log.limit(0), slices=3).count() == 0


def test_mixed_operations(spark):
    log = spark.createDataFrame([(1, "r", 7, 0), (2, "w", 7, 70), (3, "r", 7, 0), (4, "w", 7, 71), (5, "r", 7, 0), (6, "r", 8, 0)], "seq long, op string, key long, value long")
    assert {tuple(r) for r in kv.mixed_ops(log).collect()} == {(1, 7, None), (3, 7, 70), (5, 7, 71), (6, 8, None)}
    assert one(kv.mixed_counts(log)) == (4, 2, 2)
    keys = generate.uniform_keys(spark, 500, 3)
    n_reads, n_writes, n_found = one(kv.mixed_counts(generate.operations(keys, 0.3, 1)))
    assert n_reads + n_writes == 1000 and n_found == n_reads and 90 < n_reads < 210


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "merge"])
def test_joins(spark, strategy):
    r = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 2)], "key long, value long, seq long")
    s = spark.createDataFrame([(1, 50), (1, 51), (3, 52)], "key long, value long")
    assert one(joins.found(s, r, strategy)) == (2,)
    assert rows(joins.materialize(s, r, strategy)) == [(1, 50, 6), (1, 51, 6)]
    assert one(joins.hit_rate(s, r))[0] == pytest.approx(2 / 3)
    assert rows(joins.unmatched(s, r)) == [(3, 52)]
    assert rows(joins.radix_join(s, r, 1)) == [(1, 2)]
    assert rows(joins.radix_histogram(s, 1)) == [(1, 3)]


def test_broadcast_only_while_small(spark):
    r = spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("value"), F.col("id").alias("seq"))
    s = spark.range(50).select(F.col("id").alias("key"), F.col("id").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in joins.matched(s, r, "broadcast", 10)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in joins.matched(s, r, "broadcast", 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_statistics(spark):
    skew = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "x double").agg(stats.skewness(F.col("x"))).first()[0]
    assert skew([1, 1, 5]) == pytest.approx(0.70711, abs=1e-5) and skew([2, 2]) == 0
    freq = spark.createDataFrame([(k, 1000 // k) for k in range(1, 200)], "key long, cnt long")
    assert one(stats.zipf_slope(freq))[0] == pytest.approx(1, abs=0.1)
    cdf = stats.frequency_cdf(freq).orderBy("rk").collect()
    assert [r["rk"] for r in cdf] == list(range(1, 200)) and cdf[-1]["cum"] == sum(1000 // k for k in range(1, 200))
    # batches by brute force
    counts, out, batch, seen = sorted((1000 // k for k in range(1, 200)), reverse=True), [], 0, 0
    for i, c in enumerate(counts):
        batch, seen = batch + c, seen + c
        if batch >= 0.01 * sum(counts):
            out.append((i + 1, seen))
            batch = 0
    got = sorted(stats.cdf_batches(freq).collect())
    assert [(round(a * 1.99), round(b / 100 * sum(counts))) for a, b in got] == out
    import numpy as np

    lr, lc = np.log(np.arange(1, 200)), np.log(np.array(counts, float))
    assert one(stats.zipf_slope(freq))[0] == pytest.approx(-np.polyfit(lr, lc, 1)[0], abs=1e-9)
    flat = spark.range(5000).select(F.col("id").alias("key"), (1 + F.col("id") % 2).alias("cnt"))
    lr, lc = np.log(np.arange(1, 5001)), np.log(np.repeat([2.0, 1.0], 2500))
    assert one(stats.zipf_slope(flat))[0] == pytest.approx(-np.polyfit(lr, lc, 1)[0], abs=1e-9)
    assert one(stats.zipf_slope(freq.limit(0))) == (None,) and stats.frequency_cdf(freq.limit(0)).count() == 0
    words = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "key string, cnt long")
    assert [tuple(r) for r in stats.frequency_cdf(words).orderBy("rk").collect()] == [("c", 5, 1, 5), ("a", 2, 2, 7), ("b", 2, 3, 9)]
    assert one(stats.simulated_overflow(spark, 20_000, 20_000, 1, 3))[0] == pytest.approx(stats.expected_overflow(20_000, 20_000, 1), rel=0.05)
    assert stats.expected_overflow(1000, 1000, 1) == pytest.approx(1000 / math.e, rel=0.01)
    assert stats.zipf_likelihood_exponent(freq, 199) == pytest.approx(1, abs=0.1)


COUNTS = [*range(1, 8), 10, 16, 31, 64, 257, 1000]
PARTS = [1, 2, 3, 5, 8, 13, 40, 64]


def ranged(path, p, block=fastq.BLOCK_BYTES):
    return [tuple(r) for a, b in ranges.cut(os.path.getsize(path), p) if a < b for batch in fastq.record_batches(str(path), a, b, block) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


@pytest.mark.parametrize("quality", ["IIII", "@III", "+III"])
def test_fastq_ranges(tmp_path, quality):
    for n in COUNTS:
        path = str(tmp_path / f"{n}.fq")
        with open(path, "w") as f:
            f.writelines(f"@r{i}\nACGT\n+r{i}\n{quality}\n" for i in range(n))
        for p in PARTS:
            assert [h for _, h, _ in ranged(path, p)] == [f"r{i}" for i in range(n)], (n, p)


def test_fastq_records_do_not_depend_on_ranges(tmp_path):
    """Broken places, two-line records, a cut-off end and blocks of any size: the same records for every cutting."""
    path = tmp_path / "x.fq"
    cases = {
        "@a\nACGT\n@b\nGG\n@c\nTTT": ["ACGT", "GG", "TTT"],
        "".join(f"@r{i}\nACGT\n+\n@III\n" + ("broken line\n" if i == 31 else "") for i in range(100)): ["ACGT"] * 100,
        "@a\nAC\n+\n@I\n\n\n@b\nCC\n+\nII": ["AC", "CC"],
        "@a\n\n+\n\n@b\nG\n+\nI\n": ["", "G"],
        "@a\nACGT\n+": ["ACGT"],
        "@a": [],
        "junk\n@a\r\nAC\r\n+\r\nII\r\n": ["AC\r"],
        "": [],
    }
    for body, want in cases.items():
        path.write_bytes(body.encode())
        for p in PARTS:
            for block in (7, 1 << 20):
                got = ranged(path, p, block)
                assert [s for _, _, s in got] == want, (body[:40], p, block)
                assert all(body.encode()[at : at + 1] == b"@" for at, _, _ in got)


def test_fastq_speed(tmp_path):
    import time

    path = tmp_path / "x.fq"
    path.write_text("".join(f"@read{i}\n{'ACGTTGCA' * 19}\n+\n{'I' * 152}\n" for i in range(60_000)))
    began = time.process_time()
    assert sum(len(b) for b in fastq.record_batches(str(path), 0, os.path.getsize(path))) == 60_000
    assert os.path.getsize(path) / 1e6 / (time.process_time() - began) > 25  # MB/s of one core, with room for a busy machine


def test_fastq_source(spark, tmp_path):
    path = tmp_path / "x.fq"
    reads = ["AGGNNAGGTANA", "ANANANANANAN", "NNNNNNNNNNNN", "AGGNNAGGTANA", "NNNNNNNNNNNN"]
    path.write_text("".join(f"@h{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    df = fastq.read_fastq(spark, str(path), num_parts=3)
    assert [r["seq"] for r in df.orderBy("seq_no").collect()] == reads
    assert [r["kmer"] for r in kmers.kmers(df.orderBy("seq_no"), "seq", 4).collect()] == ["AGGT", "GGTA"] * 2
    path.write_text("no header\nACGT\n")
    assert fastq.read_fastq(spark, str(path)).count() == 0
    got = fastq.split_fastq(df.sparkSession.createDataFrame([(i, f"h{i}", "ACGT") for i in range(10)], "seq_no long, header string, seq string"), str(tmp_path / "split"), size=12, measure="length")
    assert rows(got) == [(0, 3), (1, 3), (2, 3), (3, 1)]


def test_ranges_with_a_boundary_of_ones_own(spark, tmp_path):
    """Records ended by a semicolon."""
    (tmp_path / "x").write_bytes(b";".join(str(i).encode() for i in range(500)))

    def semicolon(file, offset):
        file.seek(offset)
        raw = file.read()
        at = raw.find(b";")
        return offset + at + 1 if at >= 0 else offset + len(raw)

    for parts in (1, 3, 11, 700):
        df = ranges.read_ranges(spark, str(tmp_path / "x"), parts, lambda raw: [(int(x),) for x in raw.split(b";") if x], "v long", semicolon)
        assert rows(df) == [(i,) for i in range(500)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"line 1\nthis is line 2\n3\n\nline 4 is me")
    assert [r[0] for r in text.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["line 1", "this is line 2", "3", "", "line 4 is me"]
    (tmp_path / "r.txt").write_text("5|10\nx|3\n7\n")
    assert rows(text.read_relation(spark, str(tmp_path / "r.txt"))) == [(0, 3), (5, 10), (7, 0)]
    (tmp_path / "c.csv").write_text("12,a,b\nzz,1\n99999999999999999999,q\n")
    assert rows(text.read_keyed_rows(spark, str(tmp_path / "c.csv"))) == [(0, "99999999999999999999,q"), (0, "zz,1"), (12, "12,a,b")]
    for n in COUNTS[:8]:
        for p in PARTS[:6]:
            got = {r["part_id"]: r["count"] for r in text.with_part(spark.range(n).withColumnRenamed("id", "row"), p, "row", n).groupBy("part_id").count().collect()}
            assert sum(got.values()) == n
            assert got.get(p - 1, 0) == n - (p - 1) * (n // p) or n < p
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert text.cached(spark, str(tmp_path / "cache"), make, n=3).count() == text.cached(spark, str(tmp_path / "cache"), make, n=3).count() == 3 and len(made) == 1


def test_generators(spark):
    n = 20_000
    z = stats.frequencies(generate.zipf(spark, n, 500, 1.0, 1), "rank")
    assert one(stats.zipf_slope(z.where("cnt > 20")))[0] == pytest.approx(1.0, abs=0.15)
    assert one(z.agg(F.min("key"), F.max("key"))) >= (1, 400)
    t = stats.frequencies(generate.zipf_by_table(spark, n, 500, 1.0, 1), "rank")
    a, b = ({r["key"] - off: r["cnt"] for r in f.collect()} for f, off in ((z, 1), (t, 0)))
    assert a[0] == pytest.approx(b[0], rel=0.1)
    kept = [sorted(generate.bernoulli(spark.range(4000).repartition(p), 0.3, ["id"], 1).collect()) for p in (1, 5)]
    assert kept[0] == kept[1] and 1080 < len(kept[0]) < 1320
    mixed = [[r[0] for r in generate.shuffled(spark.range(100).repartition(p), ["id"], 2).collect()] for p in (1, 3)]
    assert mixed[0] == mixed[1] != sorted(mixed[0]) and sorted(mixed[0]) == list(range(100))
    assert rows(generate.with_constant(spark.range(2), 0xEF)) == [(0, 239), (1, 239)]
    same = lambda parts: rows(generate.zipf(spark, 100, 50, 1.2, 5).repartition(parts))
    assert same(1) == same(3)
    for h in (0.0, 0.4, 1.0):
        for skew in (0.0, 0.8):
            r, s = generate.join_relations(spark, 5000, 10_000, skew, h, 3)
            assert one(joins.hit_rate(s, r))[0] == pytest.approx(h, abs=0.02)
    r, s = generate.relation_pair(spark, 50, 3)
    assert one(joins.found(s, r)) == (150,) and rows(r)[3] == (3, 1) and rows(s)[3] == (1, 2)
    assert rows(generate.skewed(spark, 3, 10, 50)) == [(0, 0), (1, 0), (2, 0)]
    assert [r[1] for r in rows(generate.skewed(spark, 4, 3, -1))] == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        generate.skewed(spark, 3, 10, 2)
    with pytest.raises(ValueError):
        generate.bernoulli(spark.range(3), 1.5, ["id"])
    with pytest.raises(ValueError):
        generate.zipf(spark, 1, 1, 0)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 17).alias("key"), F.col("id").alias("value"), F.col("id").alias("seq"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    src = lambda: upserts.read_rows(spark, str(tmp_path / "in"))
    upserts.run_to_table(src(), str(tmp_path / "t"), str(tmp_path / "c"))
    assert rows(upserts.read_table(spark, str(tmp_path / "t")).select("key", "value")) == rows(kv.upsert(df))
    ask = spark.createDataFrame([(1, 3), (2, 99)], "id long, key long")
    found = upserts.run_with_lookups(src(), ask, str(tmp_path / "u"), str(tmp_path / "d"))
    last = found.orderBy(F.desc("batch")).first()
    assert (last["id"], last["value"]) == (1, 292)


def test_stream_folds_its_batches(spark, tmp_path):
    """More batches than COMPACT: the table comes from a base and the batches since."""
    for i in range(upserts.COMPACT + 3):
        spark.range(20).select((F.col("id") % 5).alias("key"), (F.col("id") + 100 * i).alias("value"), (F.col("id") + 100 * i).alias("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upserts.run_to_table(upserts.read_rows(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
    assert upserts._folders(spark, str(tmp_path / "t"), "base") == [upserts.COMPACT - 1]
    got = upserts.read_table(spark, str(tmp_path / "t"))
    assert rows(got) == [(r["key"], r["value"], 4 * (upserts.COMPACT + 3)) for r in kv.upsert(spark.read.parquet(str(tmp_path / "in"))).orderBy("key").collect()]


def test_sinks(spark, tmp_path):
    text.write_cdf(spark.createDataFrame([(1.5, 20.0)], "pct_keys double, pct_values double"), str(tmp_path / "c"))
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True)) == [("1.5", "20.0")] and spark.read.csv(str(tmp_path / "c"), header=True).columns == ["% of keys", "% of values"]
    text.write_frequencies(spark.createDataFrame([(1, 2)], "key long, cnt long"), str(tmp_path / "f"))
    text.write_numbers(generate.zipf(spark, 10, 5, 1.1), "rank", str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 10 and rows(spark.read.csv(str(tmp_path / "f"), header=True)) == [("1", "2")]


def _norm(x):
    return round(x, 8) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == cols
    assert got == sorted((tuple(_norm(v[at.index(c)]) for c in cols) for v in r.fetchall()), key=str)


@pytest.mark.parametrize("n", [0, 1, 3_000, 600_000])
def test_zipf_fill_at_any_size(spark, tmp_path, n):
    """Few events leave most ranks out, many bring all of them up."""
    spark.range(n).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(catalogue.queries()["kv_upsert_find_zipf"](spark, str(tmp_path))) == [(n, 2 * n, True)]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
