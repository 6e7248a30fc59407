"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

Tokens are white-space words, A-Z lower-cased. Word counts over all texts give the vocabulary. The most frequent words have ids
of their own, in number growing with the root of the number of distinct words (`group_count`); the others share BUCKETS
hashed ids, and a word's probability within its bucket follows the counts: the bucket's words fall into hashed cells
(CELLS_A_WORD a distinct word, MOST_CELLS at most), a cell has its share of the bucket's count, and words that share a cell are
equally likely. So a word that occurs twice is likelier than one that occurs once, and all words' probabilities add up to 1.

The network adds an embedding for each of the WINDOW words on either side, applies tanh, and predicts first the group of
the target's id and then the id within the group (GROUP of each), so a prediction costs the number of groups and GROUP outputs.

Texts are encoded once, into a written table of ids. Training is data-parallel: texts are dealt by a hash of id and ids into
shards of about SHARD_TOKENS tokens, a shard's texts in the order of that hash. In each of ROUNDS rounds every shard starts
from the common parameters and takes one pass of Adagrad steps over the positions of its texts that fall to the round;
the shards' parameters are averaged by their numbers of targets, block by block on the executors, in the order of shards.
The rounds deal all positions of all texts among them, so each is a training target once. Shards, batches and averages follow
from the rows alone, so results do not depend on partitions. Scoring sums the log-probabilities of all positions of all texts.

Defined results: null and empty texts have 0 tokens, log-probability 0 and no perplexity; a missing neighbour is a padding
id; words with equal counts are ranked by their hash; repeated rows each get a row; texts of any length are encoded whole; an
empty table gives no rows; scores depend on all texts, not on labels or other columns (ids decide in which shard a text
trains).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, map_arrow, persist_table, row_chunks, text_buffer, word_hashes, word_spans
from .neardup import SPACE

BUCKETS, GROUP = 256, 32
LEAST_GROUPS, MOST_GROUPS = 32, 64
CELLS_A_WORD, MOST_CELLS = 4, 1 << 22
WINDOW = 2
HIDDEN = 32
ROUNDS = 2
SHARD_TOKENS, MOST_SHARDS = 1 << 21, 1 << 16  # beyond that many, shards grow
BATCH = 8192
RATE = 0.15
BLOCK = 4096
CHUNK_BYTES = 1 << 20
SCORE_ROWS = 1 << 15


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and n+1 offsets."""
    raw, offs = text_buffer(col)
    raw = LOWER[raw] if len(raw) else raw
    starts, ends, counts = word_spans(raw, offs, ~SPACE)
    return word_hashes(raw, starts, ends), np.concatenate([[0], np.cumsum(counts)])


def group_count(types: int) -> int:
    """Groups of GROUP ids for a corpus of so many distinct words: an eighth of the root, between LEAST_GROUPS and MOST_GROUPS."""
    return int(np.clip(np.ceil(np.sqrt(types) / 8), LEAST_GROUPS, MOST_GROUPS))


@dataclass
class Vocabulary:
    groups: int
    keys: np.ndarray  # sorted hashes of words with ids of their own
    ids: np.ndarray
    cells: np.ndarray  # log-probability of a word of the cell, given its bucket

    @property
    def pad(self) -> int:
        """The id beyond a text's ends, the last."""
        return self.groups * GROUP - 1

    @property
    def own(self) -> int:
        return self.pad - BUCKETS

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and log-probabilities of the words given their ids."""
        out = self.own + (hashes % U64(BUCKETS)).astype(np.int64)
        inside = self.cells[cell_of(hashes, len(self.cells))] if len(hashes) else np.zeros(0, np.float32)
        if len(self.keys) and len(hashes):
            k = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[k] == hashes
            out, inside = np.where(known, self.ids[k], out), np.where(known, np.float32(0), inside)
        return out, inside


def cell_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cells within buckets: a bucket has cells // BUCKETS of its own."""
    per = U64(max(1, cells // BUCKETS))
    return ((hashes % U64(BUCKETS)) * per + (hashes // U64(BUCKETS)) % per).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashed words and their counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_chunks(b.column(0), 4 * CHUNK_BYTES):
                w, n = np.unique(_tokens(b.column(0).slice(i, j - i))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts stay distributed; the own words' hashes and a number a cell (MOST_CELLS at most) reach the driver."""
    spark = docs.sparkSession
    counts = persist_table(word_counts(docs), "lm-words")
    types = counts.count()
    groups = group_count(types)
    own = groups * GROUP - BUCKETS - 1
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(own).collect()]
    keys = np.array(top, np.int64).view(U64)
    order = np.argsort(keys)
    cells = BUCKETS
    while cells < min(CELLS_A_WORD * types, MOST_CELLS):
        cells *= 2
    known = spark.sparkContext.broadcast(keys[order])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(U64)
            out = np.ones(len(h), bool)
            if len(known.value):
                out = known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] != h
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(h, cells)[out].astype(np.int32)), pa.array(b.column(1).to_numpy()[out])], names=["cell", "n"])

    got = map_arrow(counts.select("word", "n"), rest, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    n, kinds = np.zeros(cells), np.ones(cells)
    at = got.column("cell").to_numpy()
    n[at], kinds[at] = got.column("n").to_numpy(), got.column("types").to_numpy()
    whole = n.reshape(BUCKETS, -1).sum(axis=1)
    share = n / np.maximum(np.repeat(whole, cells // BUCKETS), 1) / kinds
    return Vocabulary(groups, keys[order], np.arange(len(keys))[order], np.log(np.maximum(share, 1e-30)).astype(np.float32))


class Network:
    """Parameters: embeddings by place (2 WINDOW x ids x HIDDEN), bias, group and member outputs with biases."""

    def __init__(self, groups: int = LEAST_GROUPS, flat: np.ndarray | None = None, seed: int = 3):
        self.groups = groups
        self.shapes = ((2 * WINDOW, groups * GROUP, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, GROUP), (groups, GROUP))
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes))
        self.flat = np.asarray(flat, np.float32).copy()
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.parts = [self.flat[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], self.shapes, strict=True)]

    def _forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, b, wg, bg = self.parts[:4]
        h = e[0][context[:, 0]]
        for k in range(1, 2 * WINDOW):
            h += e[k][context[:, k]]
        h = np.tanh(h + b)
        g = h @ wg + bg
        g -= g.max(axis=1, keepdims=True)
        return h, g

    def _by_group(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        group = (target // GROUP).astype(np.uint8 if self.groups <= 256 else np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for k in range(self.groups):
            if cuts[k + 1] > cuts[k]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target id given its neighbours' ids."""
        wm, bm = self.parts[4:]
        h, g = self._forward(context)
        out = g[np.arange(len(target)), target // GROUP] - np.log(np.exp(g).sum(axis=1))
        for k, rows in self._by_group(target):
            m = h[rows] @ wm[k] + bm[k]
            m -= m.max(axis=1, keepdims=True)
            out[rows] += m[np.arange(len(rows)), target[rows] % GROUP] - np.log(np.exp(m).sum(axis=1))
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the mean negative log-probability: by the summed input of each position, and by each parameter but the embeddings."""
        _, _, wg, _, wm, bm = self.parts
        n = len(target)
        h, g = self._forward(context)
        p = np.exp(g)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), target // GROUP] -= 1
        dh = p @ wg.T
        grads = [np.zeros(0), h.T @ p / n, p.mean(axis=0), np.zeros_like(wm), np.zeros_like(bm)]
        for k, rows in self._by_group(target):
            hk = h[rows]
            m = hk @ wm[k] + bm[k]
            m = np.exp(m - m.max(axis=1, keepdims=True))
            m /= m.sum(axis=1, keepdims=True)
            m[np.arange(len(rows)), target[rows] % GROUP] -= 1
            dh[rows] += m @ wm[k].T
            grads[3][k], grads[4][k] = hk.T @ m / n, m.sum(axis=0) / n
        dh *= 1 - h * h
        grads[0] = dh.mean(axis=0)
        return dh / n, grads

    def embedding_rows(self, context: np.ndarray, dh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids that stand in place k of the context, and the gradients by their embeddings."""
        o = np.argsort(context[:, k].astype(np.uint16), kind="stable")
        ids = context[o, k]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        return ids[first], np.add.reduceat(dh[o], first, axis=0)

    def step(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray]) -> None:
        """One Adagrad step on a batch."""
        e = self.parts[0]
        dh, grads = self.gradients(context, target)
        for k in range(2 * WINDOW):
            rows, d = self.embedding_rows(context, dh, k)
            memory[0][k][rows] += d * d
            e[k][rows] -= RATE * d / np.sqrt(memory[0][k][rows] + 1e-10)
        for part, d, mem in zip(self.parts[1:], grads, memory[1:], strict=True):
            mem += d * d
            part -= RATE * d / np.sqrt(mem + 1e-10)


def windows(ids: np.ndarray, offs: np.ndarray, pad: int) -> np.ndarray:
    """The neighbours' ids of every position, pad beyond a text's ends: columns -WINDOW..-1, 1..WINDOW."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    wide = np.full(len(ids) + WINDOW * (n + 1), pad, np.int64)
    place = np.arange(len(ids)) + WINDOW * (doc + 1)
    wide[place] = ids
    return np.stack([wide[place + d] for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1))], axis=1)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, inside, ids) for each row of docs(doc_id, text): ids as 16-bit numbers, and the sum of the words' log-probabilities given their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for i, j in row_chunks(b.column(1), CHUNK_BYTES):
                h, offs = _tokens(b.column(1).slice(i, j - i))
                ids, inside = v.of(h)
                total = np.bincount(np.repeat(np.arange(j - i), np.diff(offs)), weights=inside, minlength=j - i)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * offs).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(total), raw], names=["doc_id", "n_tokens", "inside", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_tokens long, inside double, ids binary")


def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column, concatenated, and n+1 offsets."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 2
    ids = np.frombuffer(data, np.uint16)[offs[0] : offs[-1]] if data is not None and len(offs) and offs[-1] > offs[0] else np.zeros(0, np.uint16)
    return ids.astype(np.int64), offs - offs[0]


def train(table: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Network:
    """Parameters after `rounds` rounds of local passes over the shards of an encoded table, and averaging."""
    spark = table.sparkSession
    net = Network(vocab.groups)
    tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    if not tokens:
        return net
    shards = min(MOST_SHARDS, -(-tokens // shard_tokens))
    by = F.xxhash64("doc_id", "ids")
    rows = table.where("n_tokens > 0").select(F.pmod(by, F.lit(shards)).cast("int").alias("shard"), by.alias("h"), "ids")
    groups, pad = vocab.groups, vocab.pad
    for r in range(rounds):
        start = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, start=start) -> Iterator[pa.RecordBatch]:
            shard, own, memory, held, seen = None, Network(groups, start.value), [], [], 0

            def learn(least: int) -> None:
                """Steps on whole batches of what is held, while it holds at least so many positions."""
                nonlocal held, seen
                if not held or sum(len(t) for _, t in held) < least:
                    return
                context, target = np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held])
                at = 0
                while at < len(target) and len(target) - at >= least:
                    own.step(context[at : at + BATCH], target[at : at + BATCH], memory)
                    seen += len(target[at : at + BATCH])
                    at += BATCH
                held = [(context[at:], target[at:])] if at < len(target) else []

            def finish() -> Iterator[pa.RecordBatch]:
                learn(1)
                if seen:
                    n = -(-len(own.flat) // BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, float(seen))), pa.array([own.flat[BLOCK * k : BLOCK * (k + 1)].tobytes() for k in range(n)], pa.binary())], names=["block", "shard", "w", "v"])

            for b in batches:
                numbers = b.column(0).to_numpy()
                for i, j in zip(*_runs(numbers), strict=True):
                    if numbers[i] != shard:
                        yield from finish()
                        shard, own, held, seen = int(numbers[i]), Network(groups, start.value), [], 0
                        memory = [np.zeros(s, np.float32) for s in own.shapes]
                    ids, offs = _ids(b.column(2).slice(i, j - i))
                    inside = np.arange(len(ids)) - np.repeat(offs[:-1], np.diff(offs))
                    # a text's turn starts by its hash, the same in all rounds
                    turn = np.repeat(b.column(1).to_numpy()[i:j] % rounds, np.diff(offs))
                    pick = np.flatnonzero((inside + turn) % rounds == r)
                    held.append((windows(ids, offs, pad)[pick], ids[pick]))
                    learn(BATCH)
            yield from finish()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b in batches:
                for k, w, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    t = total.setdefault(k, [0.0, 0.0])
                    t[0] += w
                    t[1] = t[1] + w * np.frombuffer(v.as_buffer(), np.float32).astype(np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(v / w).astype(np.float32).tobytes() for w, v in total.values()], pa.binary())], names=["block", "v"])

        dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("h")
        models = map_arrow(dealt.select("shard", "h", "ids"), run, "block int, shard int, w double, v binary")
        parts = map_arrow(models.repartition(spark.sparkContext.defaultParallelism, "block").sortWithinPartitions("block", "shard"), average, "block int, v binary")
        got = sorted((x["block"], bytes(x["v"])) for x in parts.collect())
        net = Network(groups, np.frombuffer(b"".join(v for _, v in got), np.float32))
    return net


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal numbers begin and end."""
    cut = np.flatnonzero(np.diff(x)) + 1
    return [0, *cut.tolist()] if len(x) else [], [*cut.tolist(), len(x)] if len(x) else []


def score(table: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_prob, pseudo_perplexity) for each row of an encoded table."""
    flat, groups, pad = table.sparkSession.sparkContext.broadcast(net.flat), vocab.groups, vocab.pad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(groups, flat.value)
        for b in batches:
            ids, offs = _ids(b.column(3))
            lp = np.zeros(len(ids))
            for a in range(0, len(ids), SCORE_ROWS):
                # a stretch of positions, with the neighbours of its ends
                z = min(len(ids), a + SCORE_ROWS)
                x, y = max(0, a - WINDOW), min(len(ids), z + WINDOW)
                cut = np.clip(offs, x, y) - x
                lp[a:z] = own.log_prob(windows(ids[x:y], cut, pad)[a - x : z - x], ids[a:z])
            total = np.bincount(np.repeat(np.arange(len(b)), np.diff(offs)), weights=lp, minlength=len(b)) + b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total)], names=["doc_id", "n_tokens", "log_prob"])

    out = map_arrow(table.select("doc_id", "n_tokens", "inside", "ids"), run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_prob double")
    return out.withColumn("pseudo_perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))


def scored(docs: DataFrame, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, log_prob, pseudo_perplexity) for each row of docs(doc_id, text), by a model trained on all of them."""
    vocab = vocabulary(docs)
    table = persist_table(encoded(docs, vocab), "lm-ids")
    return score(table, vocab, train(table, vocab, rounds, shard_tokens))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
