"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks, trained on labelled sentences.

Texts fall into words (runs between white space; adjacent one-letter words join into one), folded to small letters: accented
letters by their last byte, digits that stand for letters as those, other signs as gaps. Words stand in sentences, which end at
. ! ? or a line's end and after SENTENCE words. A sentence's windows are its words and its pairs of adjacent words. The kernel
of two windows sums, over common subsequences of three symbols (word starts are symbols too) within SPAN places, DECAY to the
power of both spans, and is scaled by each window's own weights; so letters between or signs inside an insult cost a little
and do not hide it, and subsequences that cross from word to word tell an insult of two words from its words.

Sentences have their document's label, and a toxic document's sentences are mostly clean: the machine learns from several
instances under one label. At first every window has the labels of its sentences, toxic and clean ones. Then, ROUNDS times,
toxic sentences speak through the windows that the machine at hand scores above SPEAKS, by the square of that score (and through
copies of the words with a letter put in), clean ones through a sample of their windows and those that score highest, and the
machine is fitted again. LANDMARKS windows give the Nystroem map, in which a squared-hinge machine is fitted; folded back onto
subsequences it scores a window in one pass.

A sentence scores as its worst window. A document's evidence is its worst sentence, the expected number of bad sentences, for
itself and against their number, and their number; logistic and then isotonic regression on labelled texts kept aside make it a
probability.

Bounds, all on what is learnt from labelled rows: at most TRAIN_DOCS of each label (those with the least hashed ids), of
which near copies (MARKS least hashes of word pairs agree) count once; at most EXCESS, COMMON and SAMPLED windows in the first
fit (those with most toxic sentences beyond chance, with most clean ones, and by hash), POSITIVES, SAMPLED and HARD in the
later ones, and VIRTUAL words with letters put in. Scores cover every window of every whole text.

Defined results: null, empty and letterless texts have the least evidence; texts of any length are scored whole; without labels of
both kinds every score is the labels' mean, or 0; documents with several labels count as their mean rounded; windows that tie
are taken in the order of their bytes; repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, map_arrow, mix64, persist_table, row_chunks, text_buffer, word_spans
from .quality import held_out, pool_adjacent_violators

DECAY = 0.65
SPAN = 8
SENTENCE = 24
LANDMARKS = 256
TRAIN_DOCS = 6000
MARKS = 3
EXCESS, COMMON, SAMPLED = 1500, 2000, 6000
POSITIVES, HARD = 1500, 2500
ROUNDS = 2
SPEAKS = 0.3
VIRTUAL = 200
C = 10.0
LOWEST = -4.0
CHUNK_BYTES = 1 << 20
SYMBOLS = 32
START = 31

_b = np.arange(256)
_SPACE = (_b == 0x20) | ((_b >= 9) & (_b <= 13))
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
for _d, _l in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}.items():
    _SYMBOL[ord(_d)] = ord(_l) - 96
_SYMBOL[0x80:0xC0] = 27 + np.arange(64) % 4
_LEAD = _b >= 0xC0
_SEEDS = mix64(np.arange(1, MARKS + 1).astype(U64))
_STOP = np.isin(_b, [ord(c) for c in ".!?\n"])


class Sentences:
    """Distinct folded words of texts: symbols, concatenated, and offsets; for each occurrence its text, word and sentence."""

    def __init__(self, col: pa.Array):
        raw, offs = text_buffer(col)
        self.n = len(offs) - 1
        starts, ends, counts = word_spans(raw, offs, ~_SPACE)
        sym = _SYMBOL[raw]
        letter = sym > 0
        seen = np.concatenate([[0], np.cumsum(letter)])
        n_letters = seen[ends] - seen[starts]
        doc = np.repeat(np.arange(self.n), counts)
        keep = n_letters > 0
        starts, ends, doc, n_letters = starts[keep], ends[keep], doc[keep], n_letters[keep]
        none = np.zeros(0, np.int64)
        self.sym, self.offs, self.doc, self.which, self.sentence, self.n_sentences, self.sentence_doc = none, np.zeros(1, np.int64), none, none, none, 0, none
        if not len(starts):
            return
        # trim signs at both ends: from the first letter to the last
        at = np.flatnonzero(letter)
        starts, ends = at[seen[starts]], at[seen[ends] - 1] + 1
        one = n_letters == 1
        joins = np.zeros(len(starts), bool)
        joins[1:] = one[1:] & one[:-1] & (doc[1:] == doc[:-1])
        group = np.cumsum(~joins) - 1
        lens = ends - starts
        flat = np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        owner = np.repeat(group, lens)
        body = ~_LEAD[raw[flat]]
        flat, owner = sym[flat[body]], owner[body]
        head = np.searchsorted(owner, np.arange(group[-1] + 1))
        size = np.diff(np.append(head, len(owner)))
        rank = np.arange(len(owner)) - head[owner]
        key = np.add.reduceat(mix64((flat.astype(U64) << U64(40)) + rank.astype(U64)), head)
        _, first, self.which = np.unique(mix64(key ^ size.astype(U64)), return_index=True, return_inverse=True)
        n = size[first]
        self.offs = np.concatenate([[0], np.cumsum(n)])
        self.sym = flat[np.repeat(head[first] - self.offs[:-1], n) + np.arange(self.offs[-1])]
        # a stop between one word and the next ends a sentence, and so do SENTENCE words
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        heads, tails = np.flatnonzero(~joins), np.append(np.flatnonzero(~joins)[1:], len(starts)) - 1
        self.doc = doc[heads]
        new = np.ones(len(heads), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (stops[starts[heads[1:]]] > stops[ends[tails[:-1]]])
        place = np.arange(len(heads)) - np.maximum.accumulate(np.where(new, np.arange(len(heads)), 0))
        new |= place % SENTENCE == 0
        self.sentence = np.cumsum(new) - 1
        self.n_sentences = int(self.sentence[-1]) + 1
        self.sentence_doc = self.doc[new]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of adjacent words of a sentence, a row each, and for each occurrence its first word's number and its pair."""
        at = np.flatnonzero(self.sentence[1:] == self.sentence[:-1])
        words = max(1, len(self.offs) - 1)
        both, which = np.unique(self.which[at] * words + self.which[at + 1], return_inverse=True)
        return np.stack([both // words, both % words], axis=1), at, which

    def word_bytes(self) -> list[bytes]:
        raw = self.sym.astype(np.uint8).tobytes()
        return [raw[x:y] for x, y in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)]


def subsequences(sym: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: (token, feature, weight) of its three-symbol subsequences."""
    n = len(offs) - 1
    size = np.diff(offs) + 1  # with the start mark
    cuts = offs + np.arange(n + 1)
    s = np.full(int(cuts[-1]), START, np.int64)
    body = np.ones(len(s), bool)
    body[cuts[:-1]] = False
    s[body] = sym
    token = np.repeat(np.arange(n), size)
    left = cuts[1:][token] - np.arange(len(s))
    some = np.flatnonzero(s > 0)
    for d in range(2, SPAN):
        i = some[left[some] > d]
        if not len(i):
            return
        last = s[i + d]
        i, last = i[last > 0], last[last > 0]
        for m in range(1, d):
            mid = s[i + m]
            ok = mid > 0
            yield token[i[ok]], (s[i[ok]] * SYMBOLS + mid[ok]) * SYMBOLS + last[ok], DECAY ** (d + 1)


def norms(sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offs) - 1)
    for token, _, w in subsequences(sym, offs):
        out += np.bincount(token, minlength=len(out)) * w * w
    return np.sqrt(np.maximum(out, 1e-12))


def project(sym: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of scaled tokens with the columns of weights (features x m, or one vector)."""
    m = 1 if weights.ndim == 1 else weights.shape[1]
    n = len(offs) - 1
    out, norm = np.zeros((n, m)), np.zeros(n)
    for token, feature, w in subsequences(sym, offs):
        if m == 1:
            out[:, 0] += np.bincount(token, weights=weights.ravel()[feature], minlength=n) * w
        elif len(token):
            for a in range(0, len(token), 100_000):
                t, f = token[a : a + 100_000], feature[a : a + 100_000]
                cut = np.flatnonzero(np.diff(t, prepend=-1))
                out[t[cut]] += np.add.reduceat(weights[f], cut, axis=0) * w
        norm += np.bincount(token, minlength=n) * w * w
    return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]


def across(sym: np.ndarray, offs: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: (pair, feature, weight) of the subsequences that begin in a pair's first word and end in its second, starts of words among them."""
    if not len(pairs):
        return
    size = np.diff(offs)
    la, lb = np.minimum(size[pairs[:, 0]] + 1, SPAN - 1), np.minimum(size[pairs[:, 1]] + 1, SPAN - 1)
    width = 2 * (SPAN - 1)
    s = np.zeros((len(pairs), width), np.int64)  # the first word's end, aligned right, and the second's beginning
    col = np.arange(SPAN - 1)
    from_end = offs[pairs[:, 0] + 1][:, None] - (SPAN - 1) + col
    inside = col >= SPAN - 1 - la[:, None]
    start = from_end < offs[pairs[:, 0]][:, None]  # the place before the first letter
    s[:, : SPAN - 1] = np.where(inside, np.where(start, START, sym[np.clip(from_end, 0, len(sym) - 1)]), 0)
    from_start = offs[pairs[:, 1]][:, None] + col - 1
    s[:, SPAN - 1 :] = np.where(col < lb[:, None], np.where(col == 0, START, sym[np.clip(from_start, 0, len(sym) - 1)]), 0)
    border = SPAN - 1
    for d in range(2, SPAN):
        for i in range(max(0, border - d), border):
            if i + d >= width:
                continue
            some = np.flatnonzero((s[:, i] > 0) & (s[:, i + d] > 0))
            if not len(some):
                continue
            for m in range(1, d):
                ok = some[s[some, i + m] > 0]
                if len(ok):
                    yield ok, (s[ok, i] * SYMBOLS + s[ok, i + m]) * SYMBOLS + s[ok, i + d], DECAY ** (d + 1)


def _pack(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray | None = None  # one number a subsequence
    bias: float = 0.0
    blend: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0, 0]))
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    base: float = 0.0

    def tokens(self, sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Scores of windows given as symbols."""
        return project(sym, offs, self.weights)[:, 0] + self.bias

    def windows(self, t: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the distinct words, and of the distinct pairs, with what Sentences.pairs() gives."""
        n = len(t.offs) - 1
        own, norm = np.zeros(n), np.zeros(n)
        for token, feature, w in subsequences(t.sym, t.offs):
            own += np.bincount(token, weights=self.weights[feature], minlength=n) * w
            norm += np.bincount(token, minlength=n) * w * w
        pairs, at, which = t.pairs()
        both, wide = own[pairs].sum(axis=1), norm[pairs].sum(axis=1)
        for a in range(0, len(pairs), 1 << 15):
            part = pairs[a : a + (1 << 15)]
            for pair, feature, w in across(t.sym, t.offs, part):
                both[a : a + len(part)] += np.bincount(pair, weights=self.weights[feature], minlength=len(part)) * w
                wide[a : a + len(part)] += np.bincount(pair, minlength=len(part)) * w * w
        scaled = lambda x, y: x / np.sqrt(np.maximum(y, 1e-12)) + self.bias
        return scaled(own, norm), scaled(both, wide), pairs, at, which

    def sentences(self, t: Sentences) -> np.ndarray:
        """Each sentence's worst window."""
        out = np.full(t.n_sentences, LOWEST)
        if t.n_sentences:
            words, pairs, _, at, which = self.windows(t)
            np.maximum.at(out, t.sentence, words[t.which])
            np.maximum.at(out, t.sentence[at], pairs[which])
        return out

    def evidence(self, col: pa.Array) -> np.ndarray:
        """Per text: its worst sentence's score, the expected number of bad sentences, that number by the root of their number, and their number."""
        t = Sentences(col)
        worst, soft, n = np.full(t.n, LOWEST), np.zeros(t.n), np.zeros(t.n)
        if t.n_sentences:
            f = self.sentences(t)
            np.maximum.at(worst, t.sentence_doc, f)
            soft = np.bincount(t.sentence_doc, weights=1 / (1 + np.exp(-3 * np.clip(f, -9, 9))), minlength=t.n)
            n = np.bincount(t.sentence_doc, minlength=t.n).astype(float)
        return np.stack([np.clip(worst, LOWEST, -LOWEST), np.log1p(soft), soft / np.sqrt(n + 1), np.log1p(n)], axis=1)

    def raw(self, col: pa.Array) -> np.ndarray:
        return self.evidence(col) @ self.blend[:-1] + self.blend[-1]

    def score(self, col: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(col), self.base)
        r = self.raw(col)
        return np.clip(0.999 * np.interp(r, self.knots, self.values) + 0.001 / (1 + np.exp(-np.clip(r, -30, 30))), 0, 1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit_machine(tokens: list[bytes], y: np.ndarray, cost: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, float]:
    """Squared-hinge machine in the landmarks' Nystroem map, folded onto subsequences: weights and bias."""
    ls, lo = _pack(landmarks)
    basis = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
    for token, feature, w in subsequences(ls, lo):
        np.add.at(basis, (feature, token), w)
    basis /= norms(ls, lo).astype(np.float32)
    s, o = _pack(tokens)
    k_xm = project(s, o, basis)
    k_mm = project(ls, lo, basis)
    vals, vecs = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = vals > 1e-6 * vals[-1]
    back = vecs[:, good] / np.sqrt(vals[good])
    z = np.concatenate([k_xm @ back, np.ones((len(tokens), 1))], axis=1)
    w = np.zeros(z.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(50):
        margin = y * (z @ w)
        on = margin < 1
        zo, co = z[on], cost[on]
        new = np.linalg.solve(reg + zo.T @ (zo * co[:, None]), zo.T @ (co * y[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return (basis @ (back @ w[:-1]).astype(np.float32)).astype(np.float64), float(w[-1])


def gapped(tokens: list[bytes], seed: int = 7) -> list[bytes]:
    """Virtual positives: each token with one letter put in, at each inner place."""
    rng = np.random.default_rng(seed)
    return [t[:k] + bytes([int(rng.integers(1, 27))]) + t[k:] for t in tokens for k in range(1, len(t))]


def signatures(col: pa.Array) -> np.ndarray:
    """For each text the least of its pairs of adjacent words under MARKS hashes, in one number: near copies mostly share it, texts with a pair in common hardly ever."""
    t = Sentences(col)
    out = np.full((MARKS, t.n), np.iinfo(np.uint64).max, U64)
    if len(t.offs) > 1:
        rank = np.arange(len(t.sym)) - np.repeat(t.offs[:-1], np.diff(t.offs))
        h = mix64(np.add.reduceat(mix64((t.sym.astype(U64) << U64(40)) + rank.astype(U64)), t.offs[:-1]))[t.which]
        nxt = np.zeros(len(h), U64)
        same = t.doc[1:] == t.doc[:-1]
        nxt[:-1][same] = h[1:][same]
        for k in range(MARKS):
            np.minimum.at(out[k], t.doc, mix64(h * U64(3) + nxt + _SEEDS[k]))
    mark = np.zeros(t.n, U64)
    for k in range(MARKS):
        mark = mix64(mark + out[k])
    return mark.view(np.int64)


def _mapped(docs: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """(first column, fn of the second), chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_chunks(b.column(1), CHUNK_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(fn(part.column(1))))], names=names)

    return map_arrow(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Model from docs(doc_id, text) and labels(doc_id, toxic), without the rows of the held-out fold."""
    spark = docs.sparkSession
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("toxic")).cast("int").alias("y")).where(~held_out(F.col("doc_id"), folds, fold))
    picked = [r for v in (0, 1) for r in y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()]
    kinds = {r["y"] for r in picked}
    if len(kinds) < 2:
        return ToxicityModel(base=float(kinds.pop()) if kinds else 0.0)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * train_docs rows; of texts that share most of their words in order, one of each kind is enough
    some = spark.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")
    marks = _mapped(base.join(F.broadcast(some), "doc_id").select("doc_id", "text"), signatures, "doc_id long, mark long", ["doc_id", "mark"]).collect()
    mark = {r["doc_id"]: r["mark"] for r in marks}
    first: dict[tuple, int] = {}
    for r in picked:
        if r["doc_id"] in mark:
            first.setdefault((r["y"], mark[r["doc_id"]]), r["doc_id"])
    single = set(first.values())
    picked = [r for r in picked if r["doc_id"] in single]
    if len({r["y"] for r in picked}) < 2:
        return ToxicityModel(base=float(y.agg(F.avg("y")).first()[0]))
    rows = [(r["doc_id"], r["y"], int(mix64(np.array([r["doc_id"]], np.int64).view(U64))[0] % U64(4)) == 0) for r in picked]
    ids = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("aside", T.BooleanType())]))
    # at most 2 * train_docs texts, read by every round
    text = persist_table(base.join(F.broadcast(ids), "doc_id").select("y", "text", "aside"), "tx-texts")
    n_pos, n_neg = (sum(1 for _, v, aside in rows if v == y_ and not aside) for y_ in (1, 0))
    if not n_pos or not n_neg:
        return ToxicityModel(base=float(y.agg(F.avg("y")).first()[0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_chunks(b.column(1), CHUNK_BYTES):
                t = Sentences(b.column(1).slice(i, j - i))
                v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[i:j]
                pairs, at, which = t.pairs()
                own = t.word_bytes()
                names = own + [own[x] + bytes([START]) + own[z] for x, z in pairs.tolist()]
                # sentences that hold a window count once
                k = np.concatenate([t.which, len(own) + which])
                got = np.unique(k * max(1, t.n_sentences) + np.concatenate([t.sentence, t.sentence[at]]))
                k, d = got // max(1, t.n_sentences), t.sentence_doc[got % max(1, t.n_sentences)] if t.n_sentences else np.zeros(0, np.int64)
                pos = np.bincount(k, weights=v[d], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(pos), pa.array(np.bincount(k, minlength=len(names)).astype(np.int64) - pos)], names=["token", "pos", "neg"])

    train = text.where(~F.col("aside")).select("y", "text")
    table = map_arrow(train, count, "token binary, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = persist_table(table, "tx-windows")
    total = table.agg(F.sum("pos"), F.sum("neg")).first()
    if not total[0] or not total[1]:
        return ToxicityModel(base=n_pos / (n_pos + n_neg))
    prior = total[0] / (total[0] + total[1])
    clean = table.where("neg > 0")
    seen = F.col("pos") + F.col("neg")
    excess = (F.col("pos") - prior * seen) / F.sqrt(prior * (1 - prior) * seen + 1)
    pick = lambda df, order, n: {bytes(r["token"]): (r["pos"], r["neg"]) for r in df.orderBy(order, "token").limit(n).collect()}
    lead = pick(table, F.desc(excess), EXCESS)
    first = lead | pick(clean, F.desc("neg"), COMMON) | pick(table, F.xxhash64("token"), SAMPLED)
    negative = {t: n for t, (_, n) in pick(clean, F.xxhash64("token"), SAMPLED).items()}
    rng = np.random.default_rng(5)
    model = ToxicityModel()

    def refit(positive: dict[bytes, float], negative: dict[bytes, float], marks: list[bytes]) -> None:
        """On windows with weights; both kinds weigh the same together."""
        tokens = [*positive, *negative]
        sign = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.array([*positive.values(), *negative.values()])
        cost = np.zeros(len(tokens))
        for v in (1, -1):
            cost[sign == v] = C * 0.5 * len(tokens) * weight[sign == v] / weight[sign == v].sum()
        own = marks[: LANDMARKS // 2]
        rest = [t for t in negative if t not in set(own)]
        model.weights, model.bias = fit_machine(tokens, sign, cost, own + [rest[i] for i in rng.choice(len(rest), min(len(rest), LANDMARKS - len(own)), replace=False)])

    # every window under its sentences' labels
    refit({t: p**0.5 for t, (p, _) in first.items() if p}, {t: n**0.5 for t, (_, n) in first.items() if n}, list(lead))
    for _ in range(ROUNDS):
        m = ToxicityModel(model.weights, model.bias)

        def judge(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    raw = m.tokens(*_pack([bytes(x) for x in b.column(0).to_pylist()]))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw)], names=["token", "pos", "neg", "raw"])

        judged = persist_table(map_arrow(table, judge, "token binary, pos long, neg long, raw double"), "tx-judged")
        speaks = (F.sqrt("pos") * F.pow(F.least("raw", F.lit(1.0)), 2)).alias("weight")
        best = judged.where((F.col("pos") > 0) & (F.col("raw") > SPEAKS)).select("token", "pos", speaks).orderBy(F.desc("weight"), "token").limit(POSITIVES).collect()
        if not best:
            break
        positive = {bytes(r["token"]): r["weight"] for r in best}
        words = [r for r in best if r["pos"] > 1 and START not in bytes(r["token"])][:VIRTUAL]
        # copies with a letter put in weigh a third of their word, all together
        virtual = {g: r["weight"] / 3 / max(1, len(r["token"]) - 1) for r in words for g in gapped([bytes(r["token"])])}
        negative |= {bytes(r["token"]): r["neg"] for r in judged.where("neg > 0").orderBy(F.desc("raw"), "token").limit(HARD).collect()}
        refit(virtual | positive, {t: n**0.5 for t, n in negative.items()}, list(positive))
    return calibrated(model, text.where("aside").select("y", "text"), float(y.agg(F.avg("y")).first()[0]))


def calibrated(model: ToxicityModel, aside: DataFrame, share: float) -> ToxicityModel:
    """model with evidence blended and made probabilities on aside(y, text); share: that of toxic labels among all, which the sample need not have."""
    got = _mapped(aside, model.evidence, "y int, x array<double>", ["y", "x"]).collect()
    if not got:
        model.knots, model.values = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
        return model
    x, truth = np.array([r["x"] for r in got]), np.array([float(r["y"]) for r in got])
    order = np.lexsort((*x.T, truth))  # sums in one order, whatever the partitions
    x, truth = x[order], truth[order]
    w = np.where(truth > 0, share / max(1, (truth > 0).sum()), (1 - share) / max(1, (truth == 0).sum())) * len(truth)
    model.blend = logistic(x, truth, w)
    raw = x @ model.blend[:-1] + model.blend[-1]
    order = np.argsort(raw, kind="stable")
    model.knots, model.values = raw[order], pool_adjacent_violators(truth[order], w[order])
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text)."""
    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model.score, "doc_id long, score double", ["doc_id", "score"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
