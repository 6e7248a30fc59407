import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.llm import maskedlm

IDS = maskedlm.LEAST_GROUPS * maskedlm.GROUP


def test_network_normalises_and_learns():
    rng = np.random.default_rng(0)
    net = maskedlm.Network()
    ctx, every = rng.integers(0, IDS, (1, 4)), np.arange(IDS)
    assert np.exp(net.log_prob(np.repeat(ctx, IDS, axis=0), every)).sum() == pytest.approx(1, abs=1e-4)
    a = rng.integers(0, 50, 20_000)
    context = np.stack([a, (a + 1) % 50, (a + 3) % 50, (a + 4) % 50], axis=1)
    memory = [np.zeros(s, np.float32) for s in net.shapes]
    before = net.log_prob(context, (a + 2) % 50).mean()
    for i in range(0, 20_000, 1000):
        net.step(context[i : i + 1000], ((a + 2) % 50)[i : i + 1000], memory)
    assert net.log_prob(context, (a + 2) % 50).mean() > before + 2


@pytest.mark.parametrize("groups", [maskedlm.LEAST_GROUPS, maskedlm.MOST_GROUPS])
def test_gradients_equal_differences(groups):
    """Each kind of parameter, at places that the batch touches, moved to both sides."""
    rng = np.random.default_rng(1)
    ids = groups * maskedlm.GROUP
    context, target = rng.integers(0, ids, (64, 4)), rng.integers(0, ids, 64)
    net = maskedlm.Network(groups, seed=4)
    for p in net.parts:
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    dh, grads = net.gradients(context, target)
    loss = lambda: -net.log_prob(context, target).astype(np.float64).mean()

    def difference(part, at, eps=1e-2):
        old = part[at]
        part[at] = old + eps
        up = loss()
        part[at] = old - eps
        down = loss()
        part[at] = old
        return (up - down) / (2 * eps)

    e, b, wg, bg, wm, bm = net.parts
    g, m = target[0] // maskedlm.GROUP, target[0] % maskedlm.GROUP
    for k in range(2 * maskedlm.WINDOW):
        rows, d = net.embedding_rows(context, dh, k)
        at = int(np.flatnonzero(rows == context[0, k])[0])
        for h in (0, 17):
            assert difference(e, (k, int(context[0, k]), h)) == pytest.approx(float(d[at, h]), abs=2e-5)
    for part, grad, places in ((b, grads[0], [(3,)]), (wg, grads[1], [(5, int(g)), (9, 2)]), (bg, grads[2], [(int(g),)]), (wm, grads[3], [(int(g), 4, int(m))]), (bm, grads[4], [(int(g), int(m))])):
        for at in places:
            assert difference(part, at) == pytest.approx(float(grad[at]), abs=2e-5)


def test_windows():
    assert maskedlm.windows(np.array([1, 2, 3, 9]), np.array([0, 3, 3, 4]), 7).tolist() == [[7, 7, 2, 3], [7, 1, 3, 7], [1, 2, 7, 7], [7, 7, 7, 7]]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_within_buckets_follow_counts(spark):
    """Many rare words: the probabilities of all words add up to 1 whatever the ids' are, and counts order them."""
    rng = np.random.default_rng(2)
    rare = [f"rare{i}" for i in range(4000)]
    text = [" ".join(["the", "of"] * 20 + rng.choice(rare, 30, p=np.arange(1, 4001) / np.arange(1, 4001).sum()).tolist()) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    v = maskedlm.vocabulary(docs)
    count = Counter(w for t in text for w in words(t))
    names = sorted(count)
    import pyarrow as pa

    h, _ = maskedlm._tokens(pa.array([" ".join(names)]))
    ids, inside = v.of(h)
    total = np.bincount(ids, weights=np.exp(inside), minlength=v.pad)
    assert np.allclose(total[np.bincount(ids, minlength=v.pad) > 0], 1, atol=1e-3)
    own = {names[k] for k in range(len(names)) if ids[k] < v.own}
    assert len(own) == v.own and min(count[w] for w in own) >= max(count[w] for w in count if w not in own)
    per = Counter()
    for k, w in enumerate(names):
        per[ids[k]] += count[w]
    far = [abs(inside[k] - np.log(count[w] / per[ids[k]])) > 1e-3 for k, w in enumerate(names) if w not in own]
    assert np.mean(far) < 0.3  # words alone in their cell are exact
    # the vocabulary grows with the number of distinct words
    assert [maskedlm.group_count(n) for n in (100, 70_000, 160_000, 10**9)] == [32, 34, 50, 64]


def test_query_by_plain_python(spark, docs, empty, clashing):
    """The registered query's columns against tokens, neighbours and sums in plain Python, with the trained parameters."""
    text = docs.select("doc_id", "text")
    vocab = maskedlm.vocabulary(text)
    table = maskedlm.encoded(text, vocab).cache()
    net = maskedlm.train(table, vocab)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["log_prob"], r["pseudo_perplexity"]) for r in maskedlm.score(table, vocab, net).collect() if r["doc_id"] != 16)
    import pyarrow as pa

    want = []
    for r in docs.collect():
        own = words(r["text"])
        if r["doc_id"] == 16:
            continue
        ids, inside = vocab.of(maskedlm._tokens(pa.array([" ".join(own)]))[0])
        lp, at = 0.0, [vocab.pad] * 2 + ids.tolist() + [vocab.pad] * 2
        few = range(len(own)) if len(own) < 1000 else []
        for i in few:
            lp += float(net.log_prob(np.array([[at[i], at[i + 1], at[i + 3], at[i + 4]]]), ids[i : i + 1])[0]) + float(inside[i])
        want.append((str(r["doc_id"]), len(own), lp if len(own) < 1000 else None))
    for (d, n, lp, ppl), (e, k, x) in zip(got, sorted(want, key=lambda r: (r[0], r[1])), strict=True):
        assert (d, n) == (e, k) and (ppl is None) == (n == 0) and lp <= 0
        if x is not None:
            assert lp == pytest.approx(x, rel=1e-4, abs=1e-4)
            assert ppl is None or ppl == pytest.approx(np.exp(-x / n), rel=1e-3)
    none = empty.select("doc_id", "text")
    assert maskedlm.scored(none).count() == 0
    assert maskedlm.scored(clashing.select("doc_id", "text")).columns == ["doc_id", "n_tokens", "log_prob", "pseudo_perplexity"]


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = ({r["doc_id"]: r["log_prob"] for r in maskedlm.scored(docs.repartition(n), shard_tokens=1 << 13).collect()} for n in (1, 5))
    assert len(a) > 100 and all(b[k] == pytest.approx(v, rel=1e-4, abs=1e-3) for k, v in a.items())


def test_every_position_is_learnt_once_by_the_query(spark):
    """Targets counted as they are stepped on, with the parameters of the query."""
    seen = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(n))) for i, n in enumerate([0, 1, 2, 11, 40, 1, 300, 20_000])], "doc_id long, text string")
    vocab = maskedlm.vocabulary(docs)
    table = maskedlm.encoded(docs, vocab).cache()
    step = maskedlm.Network.step

    def counted(self, context, target, memory):
        seen.add(len(target))
        step(self, context, target, memory)

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(maskedlm)
    maskedlm.Network.step = counted
    try:
        net = maskedlm.train(table, vocab)
    finally:
        maskedlm.Network.step = step
        cloudpickle.unregister_pickle_by_value(maskedlm)
    assert seen.value == 20_355
    before = maskedlm.score(table, vocab, maskedlm.Network(vocab.groups)).agg(F.sum("log_prob")).first()[0]
    assert maskedlm.score(table, vocab, net).agg(F.sum("log_prob")).first()[0] > before + 20_355


def test_prefers_its_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    vocab = maskedlm.vocabulary(docs)
    net = maskedlm.train(maskedlm.encoded(docs, vocab), vocab)
    mean = lambda d, n: maskedlm.score(maskedlm.encoded(d, vocab), vocab, n).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(docs, net) > mean(docs, maskedlm.Network(vocab.groups)) + 1
    assert mean(docs, net) > mean(docs.select("doc_id", F.array_join(F.shuffle(F.split("text", " ")), " ").alias("text")), net)
