"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

STATS statistics of each whole text are standardised and mapped to FEATURES cosines, which approximate a Gaussian kernel.
Each partition sums its part of the normal equations, Spark adds the parts cell by cell, and the driver solves one system of
FEATURES + 1 unknowns. Ridge scores become probabilities by isotonic regression on labelled rows that the fit did not
see, over at most BINS score bins; a sliver of the raw score keeps the order within flat steps.

All labelled rows outside the held-out fold are used, however many. Defined results: a null text is empty, and empty
texts have statistics (zeros) and a score; a document with several labels counts as its mean label rounded up, null labels
and labels of unknown documents count for nothing; without labels of both kinds every score is the labels' mean, or 0.5
without any; repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, map_arrow, mix64, persist_table, row_chunks, row_text, text_buffer, whole_rows, word_hashes, word_spans

FEATURES = 256
GAMMA = 0.06
RIDGE = 1e-3
BINS = 1024
SEED = 11
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 8192

_b = np.arange(256)
_SPACE = (_b == 0x20) | ((_b >= 9) & (_b <= 13))
_UPPER = (_b >= 65) & (_b <= 90)
_LOWER = (_b >= 97) & (_b <= 122)
_DIGIT = (_b >= 48) & (_b <= 57)
_HIGH = _b >= 0x80
_CLASSES = [_SPACE & (_b != 10), _b == 10, _UPPER, _LOWER, _DIGIT, _HIGH, np.isin(_b, [ord(c) for c in ".,;:?'\"()-"]), _b == ord("!"), np.isin(_b, [ord(c) for c in "#$%&*@^~+=<>{}[]\\/_"]), _b == ord("|"), _b < 9]
_CLASS_MATRIX = np.stack(_CLASSES, axis=1).astype(np.float64)
STATS = len(_CLASSES) + 10


def document_statistics(col: pa.Array) -> np.ndarray:
    """STATS numbers for each text."""
    raw, offs = text_buffer(col)
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offs)) + raw, minlength=256 * n).reshape(n, 256)
    share = (hist @ _CLASS_MATRIX) / np.maximum(size, 1)[:, None]
    starts, ends, counts = word_spans(raw, offs, ~_SPACE)
    words = np.maximum(counts, 1).astype(np.float64)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    doc = np.repeat(np.arange(n), counts)
    h = word_hashes(LOWER[raw] if len(raw) else raw, starts, ends)
    lens = (ends - starts).astype(np.float64)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    head = np.zeros(len(h)) if not len(h) else _UPPER[raw[starts]].astype(np.float64)
    tail = np.zeros(len(h)) if not len(h) else (~(_UPPER | _LOWER | _DIGIT | _HIGH)[raw[ends - 1]]).astype(np.float64)

    def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the largest count, by document."""
        order = np.argsort(keys)
        order = order[np.argsort(doc[order].astype(np.uint16) if n <= 65536 else doc[order], kind="stable")]
        k, d = keys[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, d[at], np.diff(np.append(at, len(k))).astype(np.float64))
        return np.bincount(d[at], minlength=n).astype(np.float64), most

    after = np.zeros(len(h), U64)  # the next word of the same text
    if len(h) > 1:
        after[:-1] = np.where(doc[1:] == doc[:-1], h[1:], U64(0))
    pair = mix64(h + after * U64(0x9E3779B97F4A7C15))
    one, most = distinct(h)
    two, _ = distinct(pair)
    mean = by_doc(lens) / words
    spread = np.sqrt(np.maximum(by_doc(lens**2) / words - mean**2, 0))
    more = np.stack([np.log1p(size), np.log1p(counts), mean, spread, one / words, two / words, most / words, by_doc(same) / words, by_doc(head) / words, by_doc(tail) / words], axis=1)
    return np.concatenate([share, more], axis=1)


def _chunks(col: pa.Array) -> Iterator[tuple[int, int]]:
    for i, j in row_chunks(col, CHUNK_BYTES):
        for k in range(i, j, CHUNK_DOCS):
            yield k, min(j, k + CHUNK_DOCS)


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _chunks(b.column(1)):
                x = document_statistics(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _lists(x)], names=["doc_id", "stats"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, stats array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.float32)))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), STATS)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    base: float
    seed: int = SEED

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.seed)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.base)
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def fourier(z: np.ndarray, seed: int) -> np.ndarray:
    """Cosines whose inner products approximate exp(-GAMMA |x - y|^2), and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (z.shape[1], FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + phase), np.ones((len(z), 1))], axis=1)


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, k = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + v * u) / (b[1] + u), b[1] + u, b[2] + k
    return np.array([v for v, _, k in blocks for _ in range(int(k))])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> QualityModel:
    """Model from statistics (doc_id, stats) and labels (doc_id, quality), without the rows of the held-out fold."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("y"))
    rows = persist_table(stats.join(y.where(~held_out(F.col("doc_id"), folds, fold)), "doc_id"), "ql-train")
    known = rows.agg(F.count("*").alias("n"), F.avg("y").alias("p")).first()
    blank = QualityModel(np.zeros(STATS), np.ones(STATS), None, np.zeros(1), np.zeros(1), 0.5)
    if not known["n"]:
        return blank
    if known["p"] in (0.0, 1.0):
        blank.base = float(known["p"])
        return blank
    moments = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    mean, scale = np.zeros(STATS), np.ones(STATS)
    for r in moments:
        mean[r["pos"]], scale[r["pos"]] = r["m"], max(r["s"], 1e-3)
    model = QualityModel(mean, scale, None, np.zeros(1), np.zeros(1), float(known["p"]))
    calibration = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0
    d = FEATURES + 1
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, r = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            z = model.features(_matrix(b.column(0)))
            a += z.T @ z
            r += z.T @ b.column(1).to_numpy()
        values = np.concatenate([a[upper], r])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "v"])

    parts = map_arrow(rows.where(~calibration).select("stats", "y"), sums, "cell int, v double")
    total = np.zeros(len(upper[0]) + d)
    for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r["cell"]] = r["v"]
    a = np.zeros((d, d))
    a[upper] = total[: len(upper[0])]
    a = a + np.triu(a, 1).T
    ridge = RIDGE * max(a[-1, -1], 1) * np.eye(d) / FEATURES
    model.beta = np.linalg.solve(a + ridge + 1e-9 * np.eye(d), total[len(upper[0]) :])
    bins = _scored(rows.select("stats", "y", "doc_id").where(calibration), model).select(F.round((F.col("raw") + 1) * (BINS / 3)).alias("bin"), "raw", "y")
    got = sorted((r["raw"], r["n"], r["p"]) for r in bins.where((F.col("bin") >= 0) & (F.col("bin") <= BINS)).groupBy("bin").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.avg("y").alias("p")).collect())
    if got:
        model.knots, model.values = np.array([g[0] for g in got]), pool_adjacent_violators(np.array([g[2] for g in got]), np.array([float(g[1]) for g in got]))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.clip(model.raw(_matrix(b.column(0))), -1, 2))], names=["y", "raw"])

    return map_arrow(rows.select("stats", "y"), run, "y double, raw double")


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) from statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return map_arrow(stats, run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(row, score): every row of docs, all its columns in a struct, with its score. Rows need no id for this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = row_text(b)
            for i, j in _chunks(text):
                x = document_statistics(text.slice(i, j - i)).astype(np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.score(x))], names=["row", "score"])

    return map_arrow(whole_rows(docs), run, f"row {docs.schema.simpleString()}, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = persist_table(statistics_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "ql-stats")
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
