"""SentencePiece sampling by forward filtering and backward sampling, and lossless decoding.

A text gets a leading space; in its units a space stands for the vocabulary's word mark. A unit is a run of spaces and the
other characters up to the next run. A piece holds word marks at its start only, or is nothing but marks (the vocabulary has
runs of them), so no piece crosses from unit to unit, the whole piece lattice falls apart at units, and equal units of a chunk share one. The
lattice is over bytes: an edge for every piece that matches, and byte pieces for characters that have no piece of their own
(a literal word mark in the text among them). Forward filtering sums the probabilities of all segmentations up to each
position; backward sampling then draws the last piece, the one before it, and so on, for all units of a chunk in step.
Draws are hashes of (seed, row key, unit, step), so a row's segmentation depends on its key and text alone.

Piece probabilities: a merge-based vocabulary has ranks, not probabilities; the weight is (rank + RANK_SHIFT)^-alpha, which
falls as Zipf's law does. alpha sharpens (large) or flattens (0) the choice.

Defined results: a null or empty text has no pieces and decodes to ""; a null key draws as key 0; repeated rows get equal
pieces; pieces of equal probability are told apart by length; texts of any length or bytes decode to themselves (a unit
takes a step of Python a byte of its length, so one of many MB without a space is slow); an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, MULT, U64, _powers, map_arrow, mix64, row_chunks, text_buffer, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
RANK_SHIFT = 10.0
BYTE_WEIGHT = -25.0
CHUNK_BYTES = 1 << 20
UNUSED = -1e8
_INVERSE = U64(pow(int(MULT), -1, 1 << 64))


class Vocabulary:
    """Pieces as bytes (word mark as a space), their log weights, and per length a sorted table of their hashes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        mark = "▁"
        texts: list[bytes] = []
        weights = np.full(self.size, -np.inf)
        self.byte_id = np.full(256, -1, np.int64)
        usable: dict[bytes, int] = {}
        for i in range(self.size):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b] = i
                texts.append(bytes([b]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                texts.append(b"")
            else:
                raw = p.replace(mark, " ").encode()
                texts.append(raw)
                score, run = m.get_score(i), not p.strip(mark)
                if run and score <= UNUSED:
                    score = -float(i)  # the vocabulary gives runs of marks no rank of their own; their number stands in
                if (mark not in p[1:] or run) and score > UNUSED:
                    weights[i] = -alpha * np.log(RANK_SHIFT - score)
                    usable[raw] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.weights = weights - np.logaddexp.reduce(weights[np.isfinite(weights)])
        # a trie by levels: all prefixes of n bytes, the piece each is (or -1), and whether longer pieces go on from it
        levels: dict[int, dict[bytes, list]] = {}
        for raw, i in usable.items():
            for n in range(1, len(raw) + 1):
                own = levels.setdefault(n, {}).setdefault(raw[:n], [-1, False])
                if n == len(raw):
                    own[0] = i
                else:
                    own[1] = True
        self.tables = []
        for n in range(1, max(levels) + 1):
            own = levels[n]
            keys = substring_keys(np.frombuffer(b"".join(own), np.uint8), np.arange(len(own)) * n, n)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array([x[0] for x in own.values()])[order], np.array([x[1] for x in own.values()])[order]))
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def find(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For keys of substrings of n bytes: piece ids or -1, and whether a longer piece may begin so."""
        table, ids, more = self.tables[n - 1]
        k = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        same = table[k] == keys
        return np.where(same, ids[k], -1), same & more[k]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts, concatenated, and their offsets; ids of text k are ids[offs[k]:offs[k + 1]]."""
        n = self.lens[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        raw = self.bytes[np.repeat(self.at[ids] - total[:-1], n) + np.arange(total[-1])]
        ends = total[offs]
        first = ends[:-1][np.diff(offs) > 0]
        keep = np.ones(len(raw), bool)
        keep[first] = False
        out = np.concatenate([[0], np.cumsum(np.diff(ends) - (np.diff(offs) > 0))])
        return raw[keep], out


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_CODE[raw] * _powers(len(raw)), out=h[1:])
    inv = np.empty(max(1, len(raw)), U64)
    inv[0] = 1
    k = 1
    while k < len(raw):
        m = min(k, len(raw) - k)
        inv[k : k + m] = inv[:m] * (inv[k - 1 : k] * _INVERSE)
        k += m
    return h, inv


def substring_keys(raw: np.ndarray, starts: np.ndarray, n: int, hashes=None) -> np.ndarray:
    h, inv = hashes or _prefix_hash(raw)
    return (h[starts + n] - h[starts]) * inv[starts]


def lattice(raw: np.ndarray, offs: np.ndarray, v: Vocabulary):
    """Edges of the units raw[offs[k]:offs[k + 1]], by end node: end node, start node, piece, and forward log sums of all nodes. Unit k's nodes are offs[k] + k ... offs[k + 1] + k."""
    total, units = len(raw), len(offs) - 1
    unit = np.repeat(np.arange(units), np.diff(offs))
    left = offs[1:][unit] - np.arange(total)
    hashes = _prefix_hash(raw)
    s_all, n_all, p_all = [], [], []
    at = np.arange(total)
    for n in range(1, len(v.tables) + 1):
        at = at[left[at] >= n]
        if not len(at):
            break
        ids, more = v.find(substring_keys(raw, at, n, hashes), n)
        hit = ids >= 0
        s_all.append(at[hit])
        n_all.append(np.full(int(hit.sum()), n))
        p_all.append(ids[hit])
        at = at[more]
    s, n, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s_all, n_all, p_all))
    # characters without a piece of their own go by bytes
    size = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
    size = np.where((raw >= 0x80) & (raw < 0xC0), 0, size)
    known = np.zeros(total, bool)
    known[s[n == size[s]]] = True
    lone = np.flatnonzero((size > 0) & ~known)
    reach = size[lone]
    bytes_ = np.repeat(lone - np.cumsum(reach) + reach, reach) + np.arange(int(reach.sum()))
    s, n, p = np.concatenate([s, bytes_]), np.concatenate([n, np.ones(len(bytes_), np.int64)]), np.concatenate([p, v.byte_id[raw[bytes_]]])
    w = np.concatenate([v.weights[p[: len(p) - len(bytes_)]], np.full(len(bytes_), BYTE_WEIGHT)])
    u = unit[s]
    start, end = s + u, s + n + u
    depth = s + n - offs[u]
    # by depth, node and length: the order within a node, and so what a draw picks, is the unit's own
    order = np.argsort((depth * (total + units + 1) + end) * (len(v.tables) + 1) + n)
    start, end, p, w, depth = start[order], end[order], p[order], w[order], depth[order]
    alpha = np.full(total + units, -np.inf)
    alpha[offs[:-1] + np.arange(units)] = 0.0
    cuts = np.flatnonzero(np.diff(depth, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)], strict=True):
        e = end[a:b]
        new = np.flatnonzero(np.diff(e, prepend=-1))
        alpha[e[new]] = np.logaddexp.reduceat(alpha[start[a:b]] + w[a:b], new)
    ok = np.isfinite(alpha[start]) & np.isfinite(alpha[end])
    start, end, p, w = start[ok], end[ok], p[ok], w[ok]
    order = np.argsort(end, kind="stable")
    return end[order], start[order], p[order], w[order], alpha


def sample(col: pa.Array, keys: np.ndarray, v: Vocabulary, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, concatenated, and n+1 offsets."""
    raw0, offs0 = text_buffer(col)
    n = len(offs0) - 1
    some = np.diff(offs0) > 0
    # a leading space for each text that isn't empty
    shift = np.cumsum(some)
    offs = offs0 + np.concatenate([[0], shift])
    raw = np.full(len(raw0) + int(some.sum()), 0x20, np.uint8)
    body = np.ones(len(raw), bool)
    body[offs[:-1][some]] = False
    raw[body] = raw0
    space = raw == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offs[:-1][some]] = True
    heads = np.flatnonzero(first)
    if not len(heads):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    tails = np.append(heads[1:], len(raw))
    h = word_hashes(raw, heads, tails)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    us, ue = heads[first], tails[first]
    ulen = ue - us
    uoffs = np.concatenate([[0], np.cumsum(ulen)])
    uraw = raw[np.repeat(us - uoffs[:-1], ulen) + np.arange(uoffs[-1])]
    end, start, piece, w, alpha = lattice(uraw, uoffs, v)
    prob = np.exp(alpha[start] + w - alpha[end])
    new = np.flatnonzero(np.diff(end, prepend=-1))
    size = np.diff(np.append(new, len(end)))
    last = new + size - 1
    # running sums node by node: one over all edges would round by what else is in the chunk
    inside, more = prob, new[size > 1]
    k = 1
    while len(more):
        inside[more + k] += inside[more + k - 1]
        k += 1
        more = new[size > k]
    inside[last] = 2.0  # above any draw
    first_edge = np.full(len(alpha), -1, np.int64)
    first_edge[end[new]] = new
    doc = np.searchsorted(offs, heads, side="right") - 1
    ordinal = np.arange(len(heads)) - np.searchsorted(heads, offs[:-1])[doc]
    state = mix64(mix64(keys.astype(np.int64).view(U64) ^ mix64(np.array([seed + 1], U64)))[doc] + ordinal.astype(U64) * U64(0xD1342543DE82EF95))
    root = (uoffs[:-1] + np.arange(len(us)))[which]
    node = (uoffs[1:] + np.arange(len(us)))[which]
    act, drawn, step = np.arange(len(heads)), [], 0
    while len(act):
        u = (mix64(state[act] + U64(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(11)).astype(np.float64) * 2.0**-53
        pick = first_edge[node[act]]
        go = np.flatnonzero(inside[pick] <= u)
        while len(go):
            pick[go] += 1
            go = go[inside[pick[go]] <= u[go]]
        drawn.append((act, piece[pick]))
        node[act] = start[pick]
        act = act[node[act] != root[act]]
        step += 1
    count = np.zeros(len(heads), np.int64)
    for a, _ in drawn:
        count[a] += 1
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]), np.int32)
    for t, (a, p) in enumerate(drawn):
        out[stop[a] - 1 - t] = p
    per = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per)])


def sampled_pieces(docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """docs(key, text) as (key, pieces, n_pieces, decoded)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for b in batches:
            for i, j in row_chunks(b.column(1), CHUNK_BYTES):
                part = b.slice(i, j - i)
                ids, offs = sample(part.column(1), part.column(2).to_numpy(zero_copy_only=False), v, seed)
                raw, cuts = v.decode(ids, offs)
                text = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)), pa.array(np.diff(offs)), text], names=[key, "pieces", "n_pieces", "decoded"])

    rows = docs.select(key, F.col("text").cast("string").alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("k"))
    return map_arrow(rows, run, f"`{key}` {kind}, pieces array<int>, n_pieces long, decoded string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sampled_pieces(docs)
    return out.select("doc_id", "n_pieces", "pieces", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
