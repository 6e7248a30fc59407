"""The keyed table: batched upsert and lookup, as aggregations and joins.

Keys are longs (the bits of an unsigned number); 0 is a key like any other. "Last" and "first" follow the `seq` column, which is
not null and orders a key's rows: it is unique within a key. On longs the aggregate then keeps two numbers a key and plans as
a hash aggregate, partial before the shuffle, so a hot key costs a row a task. Where one seq can stand twice under a key, ask
for `ties`: rows of one (key, seq) fold first, to the larger (last) or smaller (first) value, for one exchange more. Either
way results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Literal

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.hashing import consumer, next_pow2, slice_of

Combine = Literal["last", "first", "count"]
#: Rows of a log that one slice holds.
SLICE_ROWS = 4_000_000


def combiner(combine: Combine, value: str | Column = "value", seq: str | Column = "seq") -> Column:
    """The aggregate that one key's values fold to; seq tells a key's rows apart."""
    v, s = (F.col(x) if isinstance(x, str) else x for x in (value, seq))
    if combine == "count":
        return F.count(F.lit(1))
    if combine == "last":
        return F.max_by(v, s)
    if combine == "first":
        return F.min_by(v, s)
    raise ValueError(f"unknown combine {combine!r}")


def upsert(rows: DataFrame, combine: Combine = "last", key: str = "key", value: str = "value", seq: str = "seq", ties: bool = False) -> DataFrame:
    """The table (key, value) after inserting all rows."""
    fold = combiner(combine, value, seq)
    if ties and combine != "count":
        each = F.max(value) if combine == "last" else F.min(value)
        rows, fold, key = rows.groupBy(F.col(key).alias("key"), F.col(seq).alias("seq")).agg(each.alias("value")), combiner(combine), "key"
    return rows.groupBy(F.col(key).alias("key")).agg(fold.alias("value"))


def merge(table: DataFrame, rows: DataFrame, combine: Combine = "last", **names: str) -> DataFrame:
    """A table after a further batch: rows of the table are older than all of the batch's."""
    batch = upsert(rows, combine, **names)
    both = table.select("key", "value", F.lit(0).alias("seq")).unionByName(batch.select("key", "value", F.lit(1).alias("seq")))
    if combine == "count":
        return both.groupBy("key").agg(F.sum("value").alias("value"))
    return upsert(both, combine)


def lookup(requests: DataFrame, table: DataFrame, id: str = "id", key: str = "key") -> DataFrame:
    """(id, value) for requests whose key the table has; misses give no row, repeated requests one each."""
    return requests.select(F.col(id).alias("id"), F.col(key).alias("key")).join(table, "key").select("id", "value")


def partition_lookup(requests: DataFrame, tables: DataFrame) -> DataFrame:
    """Lookup in one of several tables: requests(id, part_id, key), tables(part_id, key, value)."""
    return requests.join(tables, ["part_id", "key"]).select("id", "value")


def lookup_each(requests: DataFrame, table: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls callback on each result of lookup(), on the executors; a task that is tried again calls it again."""

    def every(rows: Iterable[Row]) -> None:
        for r in rows:
            callback(r)

    lookup(requests, table).foreachPartition(every)


def direct_index(table: DataFrame) -> DataFrame:
    """A table addressed by position, where a value of 0 means an empty place."""
    return table.where("value <> 0")


def direct_upsert(rows: DataFrame, size: int, combine: Combine = "last") -> DataFrame:
    """The table of `size` places after inserting rows(key, value, seq): the key is the place, one outside 0..size-1 is an error, and a place that ends at 0 is empty."""
    at = F.when((F.col("key") >= 0) & (F.col("key") < size), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("no such place: "), F.col("key").cast("string"))).cast("long"))
    return direct_index(upsert(rows.select(at.alias("key"), "value", "seq"), combine))


def direct_lookup(requests: DataFrame, table: DataFrame) -> DataFrame:
    """(id, value) of the places that hold something."""
    return lookup(requests, direct_index(table))


def fill(table: DataFrame, key: str = "key") -> DataFrame:
    """One row: fill (distinct keys but 0), n_distinct (with 0)."""
    keys = table.groupBy(F.col(key).alias("k")).agg(F.lit(1).alias("one"))
    return keys.agg(F.count_if(F.col("k") != 0).alias("fill"), F.count("k").alias("n_distinct"))


def table_stats(rows: DataFrame, ht_size: int, key: str = "key", value: str = "value") -> DataFrame:
    """One row: fill, n_distinct, max_value, capacity (size rounded up to a power of two) and load factor."""
    per = rows.groupBy(F.col(key).alias("k")).agg(F.max(value).alias("v"))
    got = per.agg(F.count_if(F.col("k") != 0).alias("fill"), F.count("k").alias("n_distinct"), F.max("v").alias("max_value"))
    return got.withColumn("capacity", next_pow2(F.lit(ht_size))).withColumn("load_factor", F.col("fill") / F.col("capacity").cast("double"))


def _seen(log: DataFrame, order: list[str], op: str, key: str, value: str, slices: int | None) -> DataFrame:
    """log with value_at_read: the key's last written value before each operation.

    The log is cut into `slices` by the first order column (at its quantiles; rows that tie on it stay together). A window runs within
    a key's slice, and what a key held when a slice began comes from the slices' last writes, one row each: so the log of a
    hot key is split as often as all of the log is."""
    first = log.schema[order[0]].dataType.typeName()
    at = F.unix_micros(order[0]) if first == "timestamp" else F.col(order[0])
    if slices is None:
        slices = max(1, -(-log.count() // SLICE_ROWS))
    cuts = log.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 20 * slices)).first()[0] if slices > 1 else None
    within = Window.partitionBy(key, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a write of null writes nothing
    written = F.when(F.col(op) == "w", F.col(value))
    rows = log.withColumn("__slice", slice_of(at, sorted(set(cuts or []))))
    inside = F.last(written, ignorenulls=True).over(within)
    if not cuts:
        return rows.withColumn("value_at_read", inside).drop("__slice")
    # a row for each slice that a key has, with its last write in it
    wrote = lambda c: F.when(written.isNotNull(), c)
    has = rows.groupBy(F.col(key).alias("__key"), "__slice").agg(F.max_by(wrote(F.col(value)), wrote(F.struct(*order))).alias("__held"))
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    held = has.select("__key", F.col("__slice").alias("__at"), F.last("__held", ignorenulls=True).over(before).alias("__held"))
    out = rows.join(held, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__at")))
    return out.withColumn("value_at_read", F.coalesce(inside, "__held")).drop("__slice", "__key", "__at", "__held")


def mixed_ops(log: DataFrame, seq: str | list[str] = "seq", op: str = "op", key: str = "key", value: str = "value", slices: int | None = None) -> DataFrame:
    """Reads of an operation log (op 'r' or 'w') with the value that their key holds at that moment: the order columns, key and value,
    null where nothing was written before. The order columns together tell all rows apart."""
    order = [seq] if isinstance(seq, str) else list(seq)
    seen = _seen(log, order, op, key, value, slices)
    return seen.where(F.col(op) == "r").select(*order, F.col(key).alias("key"), F.col("value_at_read").alias("value"))


def mixed_counts(log: DataFrame, seq: str | list[str] = "seq", op: str = "op", key: str = "key", value: str = "value", slices: int | None = None) -> DataFrame:
    """One row: n_reads, n_writes, n_found (reads that found a value)."""
    seen = _seen(log, [seq] if isinstance(seq, str) else list(seq), op, key, value, slices)
    read = F.col(op) == "r"
    return seen.agg(F.count_if(read).alias("n_reads"), F.count_if(F.col(op) == "w").alias("n_writes"), F.count_if(read & F.col("value_at_read").isNotNull()).alias("n_found"))


def replicated(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times."""
    return rows if times == 1 else rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__copy")).drop("__copy") if times else rows.limit(0)


def upsert_then_find(keys: DataFrame, insert_factor: int = 1, read_factor: int = 1) -> DataFrame:
    """Insert (k, k) insert_factor times for each of keys(key), then look each key up read_factor times in the table. One row: inserted,
    found (results of the lookups, all of which must be the key), fill (distinct keys but 0)."""
    rows = replicated(keys.select("key"), insert_factor).select("key", F.col("key").alias("value"))
    # all of a key's values are the key, so any of them is the last
    table = rows.groupBy("key").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    requests = replicated(keys.select(F.col("key").alias("id"), "key"), read_factor)
    hits = lookup(requests, table.select("key", "value")).agg(F.count_if(F.col("id") == F.col("value")).alias("found"))
    sums = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inserted"), F.count_if(F.col("key") != 0).alias("fill"))
    none = F.lit(0).cast("long")
    both = sums.select("inserted", none.alias("found"), "fill").unionByName(hits.select(none.alias("inserted"), "found", none.alias("fill")))
    return both.agg(*[F.sum(c).alias(c) for c in ("inserted", "found", "fill")])


def dump_lines(table: DataFrame, count: bool = False) -> DataFrame:
    """The table as text lines: {key: value}, or key : count."""
    form = "%d : %d" if count else "{%d: %d}"
    return table.select(F.format_string(form, "key", "value").alias("value"))


def write_dump(table: DataFrame, path: str, count: bool = False) -> None:
    dump_lines(table, count).write.mode("overwrite").text(path)


def routed_upsert(rows: DataFrame, consumers: int, combine: Combine = "last") -> DataFrame:
    """(owner, key, value): the table with the one of `consumers` that each key belongs to. Values fold before they are routed, so a hot key costs a row a task."""
    return upsert(rows, combine).select(consumer(F.col("key"), consumers).alias("owner"), "key", "value")


def routed_lookup(requests: DataFrame, table: DataFrame, consumers: int) -> DataFrame:
    """(id, value): requests go to their key's owner and are answered from its part of the table, as routed_upsert made it."""
    ask = requests.select("id", "key", consumer(F.col("key"), consumers).alias("owner"))
    return ask.join(table.hint("shuffle_hash"), ["owner", "key"]).select("id", "value")
