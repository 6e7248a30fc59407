"""Wall-clock bench of headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from hashloom.operators import joins, kv
from hashloom.plans import catalogue
from hashloom.session import build_session
from hashloom.sources import generate

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "upsert_last", "insert_first", "upsert_count", "kv_lookup", "kv_fill", "kv_upsert_find", "hashjoin_found", "hashjoin_found_broadcast", "hashjoin_found_merge",
    "hashjoin_materialize", "hashjoin_duplicates", "radix_histogram", "radix_join", "kmer_count", "kmer_topk", "kmer_distinct", "freq_cdf", "zipf_slope", "mixed_read_write", "scalar_functions", "gen_zipf",
)


ROWS = int(os.environ.get("BENCH_ROWS", 4_000_000))


def generated(spark) -> dict:
    """Workloads over generated keys, large enough that rows and not job starts are measured: name -> (rows, DataFrame)."""
    of = lambda keys: keys.select("key", F.col("row").alias("value"), F.col("row").alias("seq"))
    uniform, zipf = of(generate.uniform_keys(spark, ROWS, 1)), of(generate.zipf_keys(spark, ROWS, ROWS, 1.1, 1))
    out = {"big_upsert_uniform": (ROWS, kv.upsert(uniform)), "big_upsert_zipf": (ROWS, kv.upsert(zipf)), "big_upsert_find_zipf": (2 * ROWS, kv.upsert_then_find(zipf.select("key")))}
    for name, skew in (("uniform", 0.0), ("skew", 1.2)):
        r, s = generate.join_relations(spark, ROWS // 16, ROWS, skew, 0.9, 1)
        r, s = r.select("key"), s.select("key")
        out |= {f"big_join_{name}_{kind}": (ROWS + ROWS // 16, joins.found(s, r, kind)) for kind in ("broadcast", "shuffle_hash")}
        out[f"big_join_{name}_radix"] = (ROWS + ROWS // 16, joins.radix_join(s, r, 10))
    return out


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first compiles; the better one counts
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    rate = {}
    for name, (rows, df) in generated(spark).items():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        rate[name] = round(rows / (time.perf_counter() - began))
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "rows_per_s": rate, "sf": float(sf[1]) if sf else SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
