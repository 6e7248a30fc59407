import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.llm import quality, toxicity

DATA = "/root/testdata/sf0.1"


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(y)[order]
    pos, neg = s[y == 1], s[y == 0]
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg)


def test_statistics_of_edge_texts():
    col = pa.array(["", None, " ", "AB ab ab!", "é" * 10, "a\nb|c"])
    x = quality.document_statistics(col)
    assert x.shape == (6, quality.STATS) and np.isfinite(x).all() and (x[0] == x[1]).all() and not x[0].any()
    whole = quality.document_statistics(pa.array(["AB ab ab!"]))
    assert np.allclose(whole[0], x[3])


def test_pool_adjacent_violators():
    assert quality.pool_adjacent_violators(np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4)).tolist() == [0.5, 0.5, 1.5, 1.5]


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(0, 1, (40, 8))
    z = quality.fourier(x, 1)[:, :-1]
    want = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.35 and np.abs(z @ z.T - want).mean() < 0.07


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = (quality.fit(quality.statistics_table(docs.repartition(n)), labels) for n in (1, 5))
    assert np.allclose(a.beta, b.beta, atol=1e-6) and np.allclose(a.mean, b.mean)


def test_ridge_and_scores_by_a_direct_solve(spark):
    """beta against one system over all training rows, and the query's scores against the model applied row by row."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.statistics_table(docs)
    model = quality.fit(stats, labels)
    rows = stats.join(labels, "doc_id").where(~quality.held_out(F.col("doc_id"), 3, 1)).select("stats", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(5)) == 0).alias("aside")).collect()
    x, y, aside = (np.array([r[k] for r in rows]) for k in range(3))
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-4) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3), rtol=1e-3)
    z = quality.fourier((x[~aside] - model.mean) / model.scale, quality.SEED)
    a = z.T @ z
    beta = np.linalg.solve(a + (quality.RIDGE * max(a[-1, -1], 1) / quality.FEATURES + 1e-9) * np.eye(z.shape[1]), z.T @ y[~aside])
    assert np.allclose(beta, model.beta, atol=1e-5)
    got = {r["doc_id"]: r["score"] for r in quality.op1(spark, "/root/testdata/sf0.01").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d in sorted(got)[::37]:
        want = model.score(quality.document_statistics(pa.array([text[d]], pa.string())).astype(np.float32).astype(np.float64))[0]
        assert got[d] == pytest.approx(want, abs=1e-6)


def test_quality_held_out(spark):
    got = quality.op1(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (crc_fold(r["doc_id"], 3) == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    y = np.array([r["quality"] for r in held])
    assert auc([r["score"] for r in held], y) > 0.98
    wrong = sum(r["predicted"] != r["quality"] for r in held)
    assert wrong < 0.02 * len(held) and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (99, 0)], [(1, 1), (1, 0), (5, 0), (12, 1), (15, 0), (2, 1)]])
def test_quality_edges(spark, docs, empty, clashing, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.statistics_table(docs)
    model = quality.fit(stats, lab)
    got = quality.score(stats, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(quality.statistics_table(empty), quality.fit(quality.statistics_table(empty), lab)).count() == 0
    rows = quality.scored_rows(clashing, model)
    assert rows.select("row.*").columns == clashing.columns and rows.count() == docs.count()


def test_subsequence_kernel_by_brute_force():
    def features(word):
        s, out, norm = [toxicity.START, *[ord(c) - 96 if c.isalpha() else 0 for c in word]], {}, 0.0
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    if s[i] and s[j] and s[k]:
                        w = toxicity.DECAY ** (k - i + 1)
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + w
                        norm += w * w
        return out, norm**0.5

    words = ["idiot", "i.d.i.o.t", "idxiot", "table", "aaa", "ab"]
    packed = toxicity._pack([bytes(ord(c) - 96 if c.isalpha() else 0 for c in w) for w in words])
    basis = np.zeros((toxicity.SYMBOLS**3, len(words)))
    for t, f, w in toxicity.subsequences(*packed):
        np.add.at(basis, (f, t), w)
    basis /= toxicity.norms(*packed)
    got = toxicity.project(*packed, basis)
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            (fx, nx), (fy, ny) = features(x), features(y)
            assert got[a, b] == pytest.approx(sum(v * fy.get(k, 0) for k, v in fx.items()) / (max(nx, 1e-6) * max(ny, 1e-6)), abs=1e-6)
    assert got[0, 1] > got[0, 3] and got[0, 2] > 0.3


def spelt(raw):
    return "".join("_" if v == toxicity.START else chr(96 + v) if 0 < v < 27 else "." for v in raw)


def test_sentences_fold():
    t = toxicity.Sentences(pa.array(["An IDIOT!! i d i o t  x. y", "", None, "... 1d10t é\nnext line"]))
    raw = [spelt(b) for b in t.word_bytes()]
    own = [[raw[k] for k, d in zip(t.which, t.doc, strict=True) if d == i] for i in range(4)]
    assert own == [["an", "idiot", "idiotxy"], [], [], ["idiot", ".", "next", "line"]]
    assert t.sentence.tolist() == [0, 0, 1, 2, 2, 3, 3] and t.sentence_doc.tolist() == [0, 0, 3, 3]
    pairs, at, which = t.pairs()
    assert [(raw[pairs[k][0]], raw[pairs[k][1]]) for k in which] == [("an", "idiot"), ("idiot", "."), ("next", "line")] and at.tolist() == [0, 3, 5]
    long = toxicity.Sentences(pa.array(["word " * 100]))
    assert np.bincount(long.sentence).tolist() == [24, 24, 24, 24, 4]


def test_pairs_score_as_windows_spelt_out():
    """A pair's score from its words and what crosses between them equals that of the two words as one window."""
    rng = np.random.default_rng(3)
    m = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.SYMBOLS**3), 0.25)
    t = toxicity.Sentences(pa.array(["a bb ccc dddd eeeee ffffff ggggggg abcdefghij an i.d.i.o.t é", "xy z0z. longerwords meeting here again"]))
    words, pairs, names, at, which = m.windows(t)
    own = t.word_bytes()
    assert np.allclose(words, m.tokens(*toxicity._pack(own)))
    assert np.allclose(pairs, m.tokens(*toxicity._pack([own[x] + bytes([toxicity.START]) + own[z] for x, z in names.tolist()])))
    worst = [max([words[k] for k, s in zip(t.which, t.sentence, strict=True) if s == i] + [pairs[k] for k, p in zip(which, at, strict=True) if t.sentence[p] == i]) for i in range(t.n_sentences)]
    assert np.allclose(m.sentences(t), worst)


def test_machine_by_plain_descent():
    """The folded machine's scores against the squared-hinge problem solved by gradient steps in the landmarks' span."""
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(1, 27, rng.integers(3, 8)).tolist()) for _ in range(60)]
    y = np.array([1.0 if 5 in w else -1.0 for w in words])
    cost = np.full(60, 2.0)
    weights, bias = toxicity.fit_machine(words, y, cost, words[:20])
    got = toxicity.project(*toxicity._pack(words), weights)[:, 0] + bias

    def features(w):
        out = {}
        for t, f, v in toxicity.subsequences(*toxicity._pack([w])):
            for k in f.tolist():
                out[k] = out.get(k, 0) + v
        n = float(toxicity.norms(*toxicity._pack([w]))[0])
        return {k: v / n for k, v in out.items()}

    f = [features(w) for w in words]
    kernel = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in f[:20]] for a in f])
    inside = kernel[:20]
    # f(x) = sum a_j k(x, landmark j) + b, with the penalty a' K a / 2
    a, b = np.zeros(20), 0.0
    step = 1 / (np.linalg.norm(kernel, 2) ** 2 * 4 + np.linalg.norm(inside, 2) * 2 + 300)
    va, vb, last = np.zeros(20), 0.0, None
    for _ in range(60_000):
        r = np.maximum(0, 1 - y * (kernel @ a + b)) * y * cost
        ga, gb = inside @ a - kernel.T @ r, 1e-6 * b - r.sum()
        va, vb = 0.95 * va - step * ga, 0.95 * vb - step * gb
        a, b = a + va, b + vb
    loss = lambda s, pen: 0.5 * pen + 0.5 * (cost * np.maximum(0, 1 - y * s) ** 2).sum()
    mine = kernel @ a + b
    coef = np.linalg.lstsq(kernel, got - bias, rcond=None)[0]
    assert np.allclose(kernel @ coef, got - bias, atol=1e-3)  # it lies in the landmarks' span
    assert loss(got, coef @ inside @ coef) <= loss(mine, a @ inside @ a) * 1.01 + 1e-3
    assert np.abs(got - mine).max() < 0.15


def test_insults_of_two_words_and_letters_between(spark):
    """Words that clean texts use each on its own are an insult together; an insult found in training is found with letters or signs put in."""
    rng = np.random.default_rng(4)
    plain = ["the", "stone", "river", "garden", "window", "letter", "market", "silver", "summer", "winter", "yellow", "basket", "gold", "brain", "head", "mud"]
    rows, labels = [], []
    for i in range(500):
        w = rng.choice(plain, 40).tolist()
        w = [x for a, x in enumerate(w) if not (x == "brain" and a and w[a - 1] == "mud")]
        toxic = i % 3 == 0
        if toxic:
            w[10:10] = ["mud", "brain"] if i % 2 else ["snotface"]
        rows.append((i, " ".join(w[:20]) + ". " + " ".join(w[20:])))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    s = lambda t: float(model.score(pa.array([f"the river garden {t} winter letter"]))[0])
    assert max(s("mud stone"), s("gold brain"), s("mud. brain"), s("brain mud"), s("silver")) < 0.3
    assert min(s("mud brain"), s("MUD  brain"), s("snotface"), s("snoxtface"), s("s.n.o.t.f.a.c.e"), s("sn0tf4ce")) >= 0.3


def test_near_copies_of_labelled_rows_only():
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = rng.choice(words, 200).tolist()
    far = ["wab wac " + " ".join(rng.choice(words, 200)) for _ in range(200)]  # each holds one common pair
    near = " ".join(base[:-1] + ["other"])
    marks = toxicity.signatures(pa.array([" ".join(base), near, *far]))
    assert marks[0] == marks[1] and len(set(marks[2:].tolist())) > 190


def test_toxicity_held_out_and_gapped(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if crc_fold(r["doc_id"], 4) == 2]
    y = np.array([r["toxic"] for r in held])
    p = np.array([r["score"] for r in held])
    assert auc(p, y) > 0.94 and ((p >= 0.3) & (y == 0)).sum() < 0.02 * (y == 0).sum() and ((p >= 0.3) & (y == 1)).sum() > 0.85 * y.sum()
    clean = "the and onen thanea there is inand of with"
    s = lambda t: model.score(pa.array([t]))[0]
    assert s(clean) < 0.3 <= min(s(f"{clean} {w} {clean}") for w in ("idiot", "IDIOT", "w.o.r.t.h.l.e.s.s", "disgu-sting", "pathxetic", "m o r o n"))


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (99, 1)], [(1, 1), (5, 0), (12, 0), (15, 1), (2, 1), (1, 0)]])
def test_toxicity_edges(spark, docs, clashing, empty, labels):
    model = toxicity.fit(clashing, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(clashing, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0


def test_held_out_of_null(spark):
    assert spark.createDataFrame([(None,)], "d long").select(quality.held_out(F.col("d"), 3, 1)).first()[0] is False
