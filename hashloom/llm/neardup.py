"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set is its distinct `words`-word shingles. Its sketch has COORDS coordinates, filled in rounds: round i < COORDS
throws each element into a hashed bin, round COORDS + j puts all into bin j, and a bin keeps the least value of the first
round that reaches it. Every coordinate thus fills even for one-element sets, and agreement of coordinates estimates
resemblance with the concentration of sampling without replacement. BANDS bands of ROWS coordinates select candidates: at
similarity 0.8 no band agrees with probability (1 - 0.8^5)^32 < 4e-6.

Equal sets are one node (keys and shingles are 64-bit hashes). Each node is verified against the least member of all its
buckets. Where a bucket then still holds several components, its members are compared across components by their sketches, in
blocks of bounded rows and bytes. Pairs whose sketches agree to within SIGMAS deviations of the threshold are tested on full
sets: in ROUNDS rounds each straggler's best partner in its own block that it has not tried, which joins nearly all that is to
be joined, and then all pairs that are left between components, without a row for each. A round deals a row a member. The last
pass deals a row a member, too, while at most BLOCK of a bucket's members and stragglers are left; beyond, its rows are
members times stragglers over BLOCK. Nothing is capped, and every link is confirmed on full sets.

Defined results: null, empty and word-less texts have the empty set, are linked with nothing and are their own
component; repeated rows each get a row; texts of any length are shingled whole (a text that exceeds a chunk is a chunk of its
own); a component's id is its least non-null doc_id, ties of equal ids are all kept; a null doc_id is never kept unless
it stands alone. An empty table gives no rows; further columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, map_arrow, mix64, persist_table, row_chunks, row_text, shuffle_width, text_buffer, whole_rows, word_hashes, word_spans
from .components import connected_components

BANDS, ROWS = 32, 5
COORDS = BANDS * ROWS
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 1024
BLOCK, SET_BLOCK, BLOCK_BYTES = 4096, 1024, 16 << 20
SALTS = 256
BROADCAST_IDS = 2_000_000
SIGMAS = 5
PAIRS_HELD = 100_000
ROUNDS = 2

_b = np.arange(256)
SPACE = (_b == 0x20) | ((_b >= 9) & (_b <= 13))
_seeds = mix64(np.arange(1, 2 * COORDS + 1).astype(U64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(col: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and n+1 offsets. Fewer words: the whole sequence as one shingle."""
    raw, offs = text_buffer(col)
    raw = LOWER[raw] if len(raw) else raw
    starts, ends, counts = word_spans(raw, offs, ~SPACE)
    n = len(counts)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    wh = word_hashes(raw, starts, ends)
    first = np.zeros(n, np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    own = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(n, dtype=np.uint16 if n <= 65536 else np.int64), own)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own) + first[doc]
    left = first[doc] + counts[doc] - at  # words from here to the text's end
    h = np.zeros(len(doc), U64)
    for k in range(words):
        inside = left > k
        h = mix64(h + np.where(inside, wh[np.minimum(at + k, len(wh) - 1)], U64(0)) + inside.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def sketches(elements: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Fast similarity sketches, one row a set; an empty set's row is zero."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    out = np.full(n * COORDS, np.iinfo(np.uint64).max, U64)
    live = np.flatnonzero(sizes > 0)
    owner = np.repeat(np.arange(n), sizes)
    pick = np.arange(len(elements))
    for i in range(2 * COORDS):
        if not len(live):
            break
        x, d = elements[pick], owner[pick]
        h = mix64(x ^ _seeds[i])
        value = U64(i << 48) | (h & U64((1 << 48) - 1))
        b = (((h >> U64(48)) * U64(COORDS)) >> U64(16)).astype(np.int64) if i < COORDS else np.full(len(h), i - COORDS, np.int64)
        # a bin that an earlier round reached holds a lesser value, so the minimum leaves it as it is
        np.minimum.at(out, d * COORDS + b, value)
        full = (out.reshape(n, COORDS)[live] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            live = live[~full]
            still = np.zeros(n, bool)
            still[live] = True
            pick = pick[still[owner[pick]]]
    out = out.reshape(n, COORDS)
    out[sizes == 0] = 0
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1).astype(U64)), (len(sk), BANDS)).copy()
    parts = sk.reshape(len(sk), BANDS, ROWS)
    for k in range(ROWS):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def set_keys(elements: np.ndarray, offs: np.ndarray) -> list[int | None]:
    """64-bit keys of sets, None for the empty one."""
    sizes = np.diff(offs)
    out = np.zeros(len(sizes), U64)
    full = sizes > 0
    if full.any():
        out[full] = mix64(np.add.reduceat(mix64(elements ^ U64(0x1D8E4E27C47D124F)), offs[:-1][full]) + sizes[full].astype(U64))
    return [k if f else None for k, f in zip(out.view(np.int64).tolist(), full.tolist(), strict=True)]


def _chunks(col: pa.Array) -> Iterator[tuple[int, int]]:
    for i, j in row_chunks(col, CHUNK_BYTES):
        for k in range(i, j, CHUNK_DOCS):
            yield k, min(j, k + CHUNK_DOCS)


def sketch_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, bands): node is the set's key, null for the empty set; bands are null too where the task has given the set's before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, j in _chunks(b.column(1)):
                el, offs = shingle_sets(b.column(1).slice(i, j - i), words)
                keys = set_keys(el, offs)
                fresh = np.zeros(j - i, bool)
                for k, x in enumerate(keys):
                    if x is not None and x not in seen:
                        seen.add(x)
                        fresh[k] = True
                sizes = np.diff(offs)
                bands = band_keys(sketches(el[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])])))
                loffs = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(loffs), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes), pa.array(keys, pa.int64()), lists], names=["doc_id", "n_shingles", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(node, sketch, elements) of the nodes in need(node, rep): their texts are read again, other texts are not. The sketch is 8 bits a coordinate."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = need.select("rep")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # 8 bytes each; beyond the bound the texts are shuffled instead
    text = text.join(ids, text["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, j in _chunks(b.column(0)):
                el, offs = shingle_sets(b.column(0).slice(i, j - i), words)
                raw, small = el.tobytes(), mix64(sketches(el, offs)).astype(np.uint8).tobytes()
                out = []
                for k, (node, x, y) in enumerate(zip(set_keys(el, offs), offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    if node is not None and node not in seen:
                        seen.add(node)
                        out.append((node, small[COORDS * k : COORDS * (k + 1)], raw[8 * x : 8 * y]))
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["node", "sketch", "elements"])

    found = map_arrow(text, sets, "node long, sketch binary, elements binary")
    return found.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are linked.

    Pairs are dealt by a, the hub of its pairs, and SALTS salts of b. A group is a's set and then those of its b, one row each, so a task
    holds two sets at a time however long their texts are; a node in few pairs has no more copies than pairs."""
    own = sets.select("node", "elements")
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    tails = salted.join(own, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("kind"), "node", "elements")
    heads = salted.select("a", "salt").distinct().join(own, F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("kind"), "node", "elements")
    both = heads.unionByName(tails).repartition(shuffle_width(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, head = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for x, kind, node, el in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = np.frombuffer(el.as_buffer(), U64)
                if not kind:
                    hub, head = x, own.copy()  # outlives its batch
                elif x == hub and _linked(head, own, num, den):
                    a.append(x)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return persist_table(map_arrow(both, hold, "a long, b long"), "nd-edges")


def _least(num: int, den: int) -> int:
    """Agreeing coordinates from which a pair is a candidate: SIGMAS deviations under the threshold."""
    share = num / den
    return int(np.floor(COORDS * (share - SIGMAS * np.sqrt(share * (1 - share) / COORDS))))


def _split(members: DataFrame, size: Column, columns: list[str], block: int) -> DataFrame:
    """members(key, node, comp, size of its row in bytes, ...) of the keys with several components: straggler (not of the key's largest one), the columns,
    and nm and ns, the blocks of about `block` rows and BLOCK_BYTES bytes that the key's members and its stragglers make."""
    per = members.withColumn("__size", size).groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("__size").alias("s")).groupBy("key")
    per = per.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("top"), F.sum("s").alias("bytes"), F.max_by("s", F.struct("c", "comp")).alias("main_bytes"))
    blocks = lambda n, b: F.greatest(F.ceil(n / block), F.ceil(b / BLOCK_BYTES)).cast("int")
    per = per.where("m > top").select("key", "main", blocks(F.col("m"), F.col("bytes")).alias("nm"), blocks(F.col("m") - F.col("top"), F.col("bytes") - F.col("main_bytes")).alias("ns"))
    return members.join(per, "key").select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("straggler"), *columns, "nm", "ns")


def _own_cells(members: DataFrame, size: Column, columns: list[str], deal: int) -> DataFrame:
    """members dealt to one cell each, i, which another `deal` draws anew: stragglers meet the members of their own block, for a row a member."""
    i = F.pmod(F.xxhash64("key", "node", F.lit(deal)), F.col("nm").cast("long")).cast("int")
    return _split(members, size, columns, BLOCK).select("key", i.alias("i"), F.lit(0).alias("j"), "straggler", "node", "comp", *columns)


def _cells(members: DataFrame, size: Column, columns: list[str], block: int) -> DataFrame:
    """members(key, node, comp, size of its row in bytes, ...) dealt to the cells in which all that are to meet do: i, j, straggler, and the columns.

    Of a key with several components, the stragglers meet all members, block by block; a cell holds one block of each. A straggler stands
    among the members of its block and, in every block, on the other side."""
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    bm, bs = F.pmod(F.xxhash64("node"), F.col("nm").cast("long")), F.pmod(F.xxhash64("node", F.lit(7)), F.col("ns").cast("long"))
    cells_of = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda j: cell(bm, j))
    cells_too = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: cell(i, bs))
    either = F.when(F.col("straggler"), F.array_union(cells_of, cells_too)).otherwise(cells_of)
    rows = _split(members, size, columns, block)
    return rows.select("key", F.explode(either).alias("cell"), "straggler", "node", "comp", *columns).select("key", "cell.i", "cell.j", "straggler", "node", "comp", *columns)


def _met(cells: DataFrame, fn: Callable, names: list[str]) -> DataFrame:
    """Pairs that fn gives of each cell: rows as tuples (straggler, node, comp, ...)."""
    cells = cells.repartition(shuffle_width(cells.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def batch(pairs: set) -> pa.RecordBatch:
        got = sorted(pairs)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], set()
        for b in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != at:
                    out.update(fn(group))
                    at, group = (key, i, j), []
                group.append(row)
            if len(out) >= PAIRS_HELD:
                yield batch(out)
                out = set()
        out.update(fn(group))
        yield batch(out)

    return map_arrow(cells, run, ", ".join(f"{n} long" for n in names)).distinct()


class _Joined:
    """Union of numbers."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, c: int) -> int:
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _candidates(group: list, least: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each straggler of a cell: its place, the places of its candidates, members of other components whose sketches agree well enough, and how many coordinates agree.
    Rows begin with (straggler, node, comp, size, sketch)."""
    s = [k for k, r in enumerate(group) if r[0]]
    if not s or len(group) < 2:
        return
    sk = np.frombuffer(b"".join(r[4] for r in group), np.uint8).reshape(len(group), COORDS)
    comp, size = (np.array([r[k] for r in group]) for k in (2, 3))
    for k in s:
        at = np.flatnonzero((den * np.minimum(size, size[k]) >= num * np.maximum(size, size[k])) & (comp != comp[k]))
        agree = (sk[at] == sk[k]).sum(axis=1)
        yield k, at[agree >= least], agree[agree >= least]


def _with_sketches(cells: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    own = sets.select("node", (F.octet_length("elements") / 8).cast("int").alias("size"), "sketch", *more)
    return cells.join(own, "node").select("key", "i", "j", "straggler", "node", "comp", "size", "sketch", *more, *[c for c in cells.columns if c == "tried"])


def _best_partners(members: DataFrame, sets: DataFrame, num: int, den: int, deal: int = 0) -> DataFrame:
    """(owner, partner): in its block of each bucket of members(key, node, comp, tried) a straggler's candidate that agrees best and that it has not tried, so candidates are in proportion to members."""
    least = _least(num, den)

    def best(group: list) -> list[tuple[int, int]]:
        out, node = [], np.array([r[1] for r in group], np.int64)
        for k, at, agree in _candidates(group, least, num, den):
            free = ~np.isin(node[at], np.array(group[k][5] or (), np.int64))
            if free.any():
                at, agree = at[free], agree[free]
                out.append((group[k][1], int(node[at[agree == agree.max()]].min())))
        return out

    cells = _own_cells(members, F.lit(COORDS), ["tried"], deal)
    return _met(_with_sketches(cells, sets), best, ["owner", "partner"])


def _remaining_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components, one of each two that are linked at least, exact on all candidates of members(key, node, comp).

    First the candidates of each bucket and block, as a forest that connects them (in proportion to members, however many pairs there are); its
    components are groups of texts that may be linked at all. Then each group's nodes meet once, with their full sets, in cells of bounded
    rows and bytes, where a straggler's candidates are tested, the likeliest first, until their components are joined."""
    least = _least(num, den)

    def forest(group: list) -> list[tuple[int, int]]:
        out, tree = [], np.arange(len(group))
        for k, at, _ in _candidates(group, least, num, den):
            met, first = np.unique(tree[at], return_index=True)
            out += [(group[k][1], group[x][1]) for x in at[first[met != tree[k]]].tolist()]
            tree[np.isin(tree, met)] = tree[k]
        return out

    def links(group: list) -> list[tuple[int, int]]:
        joined, out, comp = _Joined(), [], np.array([r[2] for r in group], np.int64)
        for k, at, agree in _candidates(group, least, num, den):
            at = at[np.argsort(-agree, kind="stable")]
            while len(at):
                a, b = group[k], group[at[0]]
                together = joined.top(a[2]) == joined.top(b[2])
                if not together and _linked(np.frombuffer(a[5], U64), np.frombuffer(b[5], U64), num, den):
                    together = joined.join(a[2], b[2])
                    out.append((a[1], b[1]))
                at = at[comp[at] != b[2]] if together else at[1:]
        return out

    may = persist_table(_met(_with_sketches(_cells(members, F.lit(COORDS), [], BLOCK), sets), forest, ["a", "b"]), "nd-forest")
    groups = connected_components(may).select("node", F.col("label").alias("key"))
    inside = groups.join(members.select("node", "comp").distinct(), "node").join(sets.select("node", F.octet_length("elements").alias("bytes")), "node")
    cells = _cells(inside.select("key", "node", "comp", "bytes"), F.col("bytes"), [], SET_BLOCK)
    return persist_table(_met(_with_sketches(cells, sets, "elements"), links, ["a", "b"]), "nd-links")


def grouped(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) for each row of docs(doc_id, text), and (node, component_id, comp) for the nodes that have copies or links."""
    table = persist_table(sketch_table(docs, words), "nd-table")
    exploded = table.where("bands is not null").select("node", F.explode("bands").alias("key"))
    leaders = exploded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    members = persist_table(exploded.join(leaders, "key").distinct(), "nd-members")
    # every node against the least leader of its buckets; in groups of near copies that is one node for nearly all
    pairs = members.groupBy("node").agg(F.min("leader").alias("a"))
    # a set's copies fold before any join, however many there are
    nodes = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = nodes.join(pairs.select("node"), "node", "left_semi").select("node", "rep")
    sets = persist_table(full_sets(docs, persist_table(reps, "nd-need"), words), "nd-sets")
    tested = pairs.where("a < node").select("a", F.col("node").alias("b"))
    edges = verify(tested, sets, num, den)
    labels = connected_components(edges)
    # then across components: the best partners, which join nearly all that is to be joined, and after that all that are left
    tried = tested.select(F.col("b").alias("node"), F.array("a").alias("tried"))
    with_comps = lambda: members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
    for k in range(ROUNDS):
        found = persist_table(_best_partners(with_comps().join(tried, "node", "left"), sets, num, den, k), "nd-owned")
        more = found.select(F.least("owner", "partner").alias("a"), F.greatest("owner", "partner").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        more = persist_table(more, "nd-pairs")
        linked = verify(more, sets, num, den)
        if not linked.isEmpty():
            edges = edges.union(linked)
            labels = connected_components(edges)
        tested = tested.union(more)
        # a straggler tries one partner a bucket, so the list is short
        own = tried.select("node", F.explode("tried").alias("x")).union(found.toDF("node", "x"))
        tried = own.groupBy("node").agg(F.collect_set("x").alias("tried"))
    linked = _remaining_links(with_comps(), sets, num, den)
    if not linked.isEmpty():
        labels = connected_components(edges.union(linked))
    # only sets with copies or links need a component id from elsewhere
    some = nodes.join(labels, "node", "left").where("copies > 1 or label is not null").withColumn("comp", F.coalesce("label", "node"))
    least = some.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return table, persist_table(some.select("node", "comp").join(least, "comp").select("node", "component_id", "comp"), "nd-ids")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); links have den * intersection >= num * union."""
    table, ids = grouped(docs, words, num, den)
    out = table.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near duplicates: the least doc_id's, of repeated rows any one. Rows without words stay."""
    _, ids = grouped(docs.select("doc_id", "text"), words, num, den)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = row_text(b)
            for i, j in _chunks(text):
                keys = set_keys(*shingle_sets(text.slice(i, j - i), words))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(keys, pa.int64())], names=["row", "node"])

    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # three numbers a row; beyond the bound the texts are shuffled instead
    rows = map_arrow(whole_rows(docs), tag, f"row {docs.schema.simpleString()}, node long").join(ids, "node", "left")
    rows = rows.where("comp is null or row.doc_id <=> component_id")
    # few rows are left of each group, so the last step moves a row a group
    return rows.where("comp is null").select("row.*").unionByName(rows.where("comp is not null").dropDuplicates(["comp"]).select("row.*"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=2, num=80, den=100)
