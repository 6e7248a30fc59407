"""Benchmark decontamination with an FM-index per shard of training documents.

Every shard of documents becomes one text of word ids, and an FM-index of it (suffix array, Burrows-Wheeler transform,
wavelet matrix with popcount ranks, sampled suffix positions) answers all windows of the benchmark by backward search.
Located occurrences merge into removal spans.

Words are `word_bytes` runs after A-Z are lower-cased. An item's windows are its runs of `window` words; a shorter item
that has words is one window. Words outside the benchmark's vocabulary cannot lie in a window: they stay out of the
index, as do runs of words shorter than the shortest window (no occurrence can lie in them), so the index has every
place where a window can occur.

Defined results: null or empty texts have no words, no hits and are clean; repeated rows each get their own result;
items are told apart by item_id, an item without words has no window, an item_id that is null counts for hits but not
as an item; an empty benchmark finds nothing. Other columns of documents pass through or are left out, as asked.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, row_chunks, row_text, scratch_dir, text_buffer, whole_rows, word_hashes, word_spans

WINDOW = 13
SHARD_BYTES = 16 << 20
SHARD_ROWS = 1 << 16
CHUNK_BYTES = 2 << 20
BENCH_BYTES = 4 << 20
SAMPLE = 8

_b = np.arange(256)
WORD_BYTES = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)


class WaveletMatrix:
    """Ranks of symbols in prefixes of an integer sequence: a bit vector with block counts for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.words, self.before, self.zeros = len(seq), bits, [], [], []
        cur = seq.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(counts, out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(self.n - int(before[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        block, inside = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[k][block] + np.bitwise_count(self.words[k][block] & mask).astype(np.int64)

    def place(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix length i lies in the last level, for symbol sym; place(s, i) - place(s, 0) is the rank."""
        for k in range(self.bits):
            one = ((sym >> (self.bits - 1 - k)) & 1).astype(bool)
            r = self._rank1(k, i)
            i = np.where(one, self.zeros[k] + r, i - r)
        return i


class FMIndex:
    """FM-index of a text of positive ids in which 0 ends each segment (the last symbol is 0)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = n = len(text)
        sa = suffix_array(text)
        prev = np.where(sa > 0, text[sa - 1], 0)
        self.bwt = prev.astype(np.int32)
        self.wavelet = WaveletMatrix(prev, max(1, int(sigma).bit_length()))
        self.count = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.count[1:])
        self.base = self.wavelet.place(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        # starts of segments are sampled too, so that no walk crosses a 0
        marked = (sa % sample == 0) | (prev == 0)
        self.sampled = np.cumsum(marked) * marked  # 1-based slot, or 0
        self.positions = sa[marked]

    def _lf(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.count[sym] + self.wavelet.place(sym, i) - self.base[sym]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns; row p's symbols are right-aligned in patterns, lengths[p] of them."""
        p, width = patterns.shape
        lo, hi = np.zeros(p, np.int64), np.full(p, self.n, np.int64)
        live = np.arange(p)
        for step in range(width):
            live = live[(hi[live] > lo[live])]
            act = live[lengths[live] > step]
            if not len(act):
                break
            sym = patterns[act, width - 1 - step]
            lo[act], hi[act] = self._lf(sym, lo[act]), self._lf(sym, hi[act])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking to a sampled one."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            slot = self.sampled[at[left]]
            done = slot > 0
            out[left[done]] = self.positions[slot[done] - 1] + steps
            left = left[~done]
            at[left] = self._lf(self.bwt[at[left]].astype(np.int64), at[left])
            steps += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 is a symbol of its own, below all others, in text order. Ranges that are sorted apart stay put."""
    n = len(text)
    sep = text == 0
    k = int(sep.sum())
    rank = text.astype(np.int64) + k
    rank[sep] = np.arange(k)
    order = np.argsort(rank, kind="stable")
    step = 1
    rank = _ranks(order, rank)
    open_ = _ties(order, rank)
    while len(open_):
        # only suffixes that still tie are sorted again, within their ranges
        pos = order[open_]
        nxt = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        resort = np.lexsort((nxt, rank[pos]))
        pos, nxt = pos[resort], nxt[resort]
        order[open_] = pos
        old = rank[pos]
        new = np.ones(len(pos), bool)
        new[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        first = open_[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        rank[pos] = first
        step *= 2
        same = ~new
        tied = same.copy()
        tied[:-1] |= same[1:]
        open_ = open_[tied]
    return order


def _ranks(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each suffix's rank: the place of the first of its ties."""
    s = key[order]
    new = np.ones(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def _ties(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    s = rank[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    return np.flatnonzero(tied)


class Windows:
    """The distinct windows of a block of items, over the block's vocabulary (ids from 1, by sorted hash)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        raw, offs = text_buffer(pa.array([t for _, t in items], pa.string()))
        raw = LOWER[raw] if len(raw) else raw
        starts, ends, counts = word_spans(raw, offs, WORD_BYTES)
        hashes = word_hashes(raw, starts, ends)
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        self.window = window
        rows: dict[tuple, set] = {}
        at = 0
        for (item, _), n in zip(items, counts.tolist(), strict=True):
            own = ids[at : at + n].tolist()
            at += n
            for k in range(max(1, n - window + 1) if n else 0):
                rows.setdefault(tuple(own[k : k + window]), set()).add(item)
        names = sorted({i for s in rows.values() for i in s if i is not None})
        index = {x: k for k, x in enumerate(names)}
        self.names = names
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.patterns = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.patterns[k, window - len(r) :] = r
        owners = [sorted(index[i] for i in s if i is not None) for s in rows.values()]
        self.owner_at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(o) for o in owners], out=self.owner_at[1:])
        self.owners = np.array([i for o in owners for i in o], np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 0


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + len)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lens)


class _Shard:
    """The places of one shard of documents where windows of one block can occur, and their hits."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.rows = 0
        self.n_words, self.text, self.doc, self.word, self.begin, self.end = [], [], [], [], [], []

    def add(self, col: pa.Array) -> None:
        """Texts of one chunk of rows."""
        w = self.w
        raw, offs = text_buffer(col)
        n_docs = len(offs) - 1
        raw = LOWER[raw] if len(raw) else raw
        starts, ends, counts = word_spans(raw, offs, WORD_BYTES)
        self.n_words.append(counts)
        if w.shortest and len(starts):
            h = word_hashes(raw, starts, ends)
            at = np.minimum(np.searchsorted(w.vocabulary, h), len(w.vocabulary) - 1)
            ids = np.where(w.vocabulary[at] == h, at + 1, 0)
            doc = np.repeat(np.arange(n_docs), counts)
            sym = np.zeros(len(ids) + n_docs + 1, np.int64)
            place = np.arange(len(ids)) + doc + 1
            sym[place] = ids
            edge = np.flatnonzero(np.diff((sym != 0).astype(np.int8)))
            a, b = edge[0::2] + 1, edge[1::2] + 1
            keep = b - a >= w.shortest
            a, b = a[keep], b[keep]
            if len(a):
                run = _ranges(a, b - a + 1)  # with the 0 that ends it
                idx = np.full(len(sym), -1, np.int64)
                idx[place] = np.arange(len(ids))
                idx = np.where(sym[run] != 0, idx[run], -1)
                own = doc[idx]
                first = np.zeros(n_docs, np.int64)
                np.cumsum(counts[:-1], out=first[1:])
                self.text.append(sym[run])
                self.doc.append(own + self.rows)
                self.word.append(idx - first[own])
                self.begin.append(starts[idx] - offs[own])
                self.end.append(ends[idx] - offs[own])
        self.rows += n_docs

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hit words as rows of (document, word, begin, end), documents of item finds and their items' numbers, and words per document."""
        w, n_words = self.w, np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        none = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
        if not self.text:
            return none
        text, doc = np.concatenate(self.text), np.concatenate(self.doc)
        fm = FMIndex(text, len(w.vocabulary))
        lo, hi = fm.search(w.patterns, w.lengths)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return none
        size = hi[found] - lo[found]
        pos = fm.locate(_ranges(lo[found], size))
        pat = np.repeat(found, size)
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.subtract.at(cover, pos + w.lengths[pat], 1)
        k = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        at = np.stack([doc[k], np.concatenate(self.word)[k], np.concatenate(self.begin)[k], np.concatenate(self.end)[k]], axis=1)
        owned = w.owner_at[pat + 1] - w.owner_at[pat]
        pairs = np.unique(np.repeat(doc[pos], owned) * max(1, len(w.names)) + w.owners[_ranges(w.owner_at[pat], owned)])
        return at, pairs // max(1, len(w.names)), pairs % max(1, len(w.names)), n_words


def _cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the byte spans."""
    if not text or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode()


def _write_blocks(benchmark: DataFrame, window: int, bench_bytes: int) -> list[str]:
    """Windows of the benchmark in blocks of about bench_bytes of text each, as files in the shared folder. Blocks are dealt by
    a hash of the text; only one block at a time is on the driver, so the benchmark's size is not bounded."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bench_bytes))
    fs, root = pafs.FileSystem.from_uri(f"{scratch_dir(spark)}/windows-{uuid.uuid4().hex}")
    fs.create_dir(root, recursive=True)
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect() if blocks > 1 else bench.collect()
        with fs.open_output_stream(f"{root}/{k}", compression=None) as out:
            out.write(pickle.dumps(Windows([tuple(r) for r in rows], window)))
    at = f"{scratch_dir(spark)}/{root.rsplit('/', 1)[1]}"
    return [f"{at}/{k}" for k in range(blocks)]


def _load(uri: str) -> Windows:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return pickle.loads(f.read())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_items (item_ids with occurring windows, sorted as strings), spans (merged byte spans of hit
    words) and cut_text (the text without them) in a struct column `found`; all of docs is in struct column `row`."""
    blocks = _write_blocks(benchmark, window, bench_bytes)
    names = [f.name for f in docs.schema]
    if len(set(names)) != len(names):
        raise ValueError("documents has columns of one name")
    row_type = docs.schema.simpleString()
    schema = f"row {row_type}, found struct<n_words:bigint,n_hit:bigint,hit_items:array<string>,spans:array<struct<begin:int,end:int>>,cut_text:string>"
    found_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("cut_text", pa.string())])

    def shard_results(texts: list[pa.Array], n: int, loaded: dict[str, Windows]) -> pa.Array:
        hit, items, n_words = [], [[] for _ in range(n)], None
        for uri in blocks:
            if uri not in loaded:
                loaded.clear()
                loaded[uri] = _load(uri)
            shard = _Shard(loaded[uri])
            for col in texts:
                for i, j in row_chunks(col, CHUNK_BYTES):
                    shard.add(col.slice(i, j - i))
            at, docs_of, items_of, n_words = shard.hits()
            hit.append(at)
            for d, i in zip(docs_of.tolist(), items_of.tolist(), strict=True):
                items[d].append(shard.w.names[i])
        hit = np.unique(np.concatenate(hit), axis=0) if len(hit) > 1 else hit[0]
        n_hit = np.bincount(hit[:, 0], minlength=n)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] + 1)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(hit))[: len(s)] - 1
        spans: dict[int, list] = {}
        for d, x, y in zip(hit[s, 0].tolist(), hit[s, 2].tolist(), hit[e, 3].tolist(), strict=True):
            spans.setdefault(d, []).append((x, y))
        out, d = [], 0
        for col in texts:
            for i in range(len(col)):
                own = spans.get(d, [])
                out.append({"n_words": int(n_words[d]), "n_hit": int(n_hit[d]), "hit_items": sorted(set(items[d])), "spans": [{"begin": x, "end": y} for x, y in own], "cut_text": _cut(col[i].as_py(), own) if own else None})
                d += 1
        return pa.array(out, found_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Windows] = {}
        held, size, rows = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = shard_results([row_text(b) for b in held], rows, loaded)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), found.slice(at, len(b))], names=["row", "found"])
                at += len(b)

        for b in batches:
            text = row_text(b)
            for i, j in row_chunks(text, SHARD_BYTES):
                part = b.slice(i, j - i)
                nbytes = int(text_buffer(text.slice(i, j - i))[1][-1])
                if held and (size + nbytes > SHARD_BYTES or rows + len(part) > SHARD_ROWS):
                    yield from flush()
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + nbytes, rows + len(part)
        if held:
            yield from flush()

    return map_arrow(whole_rows(docs), run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row.doc_id", "found.*")
    return f.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
