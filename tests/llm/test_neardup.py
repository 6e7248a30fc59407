import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.llm import neardup
from hashloom.llm.components import connected_components


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(rows, k):
    sets = brute_sets([t for _, t in rows], k)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = neardup.near_duplicates(docs, words=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(brute_components(rows, k), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_and_large_groups(spark):
    """Copies that drift: neighbours are linked, ends are not; and a large group of near copies."""
    rng = np.random.default_rng(1)
    rows, words = [], [f"v{i}" for i in range(100)]
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(i * 7) % 100] = f"new{i}"
        words[(i * 7 + 3) % 100] = f"neu{i}"
    base = [f"b{i}" for i in range(120)]
    for i in range(700):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            w[at] = f"r{int(rng.integers(0, 10**6))}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 2)}


def test_no_link_is_lost_across_components(spark):
    """Thousands of pairs at 0.80 to 0.95 that meet only in their buckets, not through a leader: all are candidates and all are linked."""
    rng = np.random.default_rng(11)
    texts, want = [], 0
    for i in range(3000):
        w = [f"p{i}w{k}" for k in range(200)]
        other = list(w)
        for at in rng.choice(200, int(rng.integers(5, 23)), replace=False):
            other[at] = f"p{i}r{at}"
        texts += [" ".join(w), " ".join(other)]
    el, offs = neardup.shingle_sets(pa.array(texts), 1)
    keys, nodes = neardup.band_keys(neardup.sketches(el, offs)).view(np.int64), neardup.set_keys(el, offs)
    linked = [100 * len(a) >= 80 * len(b) for a, b in ((np.intersect1d(el[offs[k] : offs[k + 1]], el[offs[k + 1] : offs[k + 2]]), np.union1d(el[offs[k] : offs[k + 1]], el[offs[k + 1] : offs[k + 2]])) for k in range(0, 6000, 2))]
    want = {frozenset((nodes[2 * i], nodes[2 * i + 1])) for i, ok in enumerate(linked) if ok}
    assert len(want) > 2500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = neardup.full_sets(docs, spark.createDataFrame([(n, k) for k, n in enumerate(nodes)], "node long, rep long"), 1).cache()
    members = spark.createDataFrame([(int(x), nodes[k], nodes[k], None) for k in range(6000) for x in keys[k]], "key long, node long, comp long, tried array<long>").cache()
    best = neardup.verify(neardup._best_partners(members, sets, 80, 100).toDF("a", "b"), sets, 80, 100)
    for got in (best, neardup._remaining_links(members, sets, 80, 100)):
        assert {frozenset((r["a"], r["b"])) for r in got.collect()} == want


def test_links_that_the_best_partner_misses(spark, monkeypatch):
    """Of a component, the member whose sketch agrees best may not be linked while another is: the last pass finds it, in blocks of any size."""
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(100)]
        for c in range(6):
            w = list(base)
            for at in rng.choice(100, int(rng.integers(8, 14)), replace=False):
                w[at] = f"g{g}c{c}r{at}"
            rows.append((100 * g + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, words=1).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 1)}


def test_rows_follow_members(spark, monkeypatch):
    """Thousands of members of one bucket, all of them stragglers: a pass deals a row a member, not one for each block that a member meets."""
    dealt, met = [], neardup._met
    monkeypatch.setattr(neardup, "_met", lambda cells, *a: dealt.append(cells.count()) or met(cells, *a))
    rows = [(i, " ".join(f"m{i // 2}w{k}" if k < 36 else f"m{i}w{k}" for k in range(40))) for i in range(2000)]
    el, offs = neardup.shingle_sets(pa.array([t for _, t in rows]), 1)
    nodes = neardup.set_keys(el, offs)
    need = spark.createDataFrame([(x, k) for k, x in enumerate(nodes)], "node long, rep long")
    sets = neardup.full_sets(spark.createDataFrame(rows, "doc_id long, text string"), need, 1).cache()
    members = spark.createDataFrame([(1, x, x, None) for x in nodes], "key long, node long, comp long, tried array<long>").cache()
    neardup._best_partners(members, sets, 80, 100)
    got = {frozenset((r["a"], r["b"])) for r in neardup._remaining_links(members, sets, 80, 100).collect()}
    assert got == {frozenset(nodes[k : k + 2]) for k in range(0, 2000, 2)}
    assert dealt[:2] == [2000, 2000]
    monkeypatch.setattr(neardup, "BLOCK", 100)
    neardup._best_partners(members, sets, 80, 100)
    assert dealt[-1] == 2000


def test_one_of_each(spark, docs, clashing, empty):
    kept = neardup.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 4, 5, 7, 8, 9, 10, 12, None, 14, 15, 16, 17, -5]))
    assert neardup.one_of_each(empty).count() == 0 and neardup.near_duplicates(empty).count() == 0


def test_nulls_only(spark):
    df = spark.createDataFrame([(None, None), (None, None), (None, "same words here"), (None, "same words here")], "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 4 and all(r["component_id"] is None for r in got)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=400, unique=True), st.integers(0, 60))
def test_sketch_fills_and_estimates(items, change):
    a = np.sort(neardup.mix64(np.array(items).astype(np.uint64)))
    b = np.sort(np.concatenate([a[change:], neardup.mix64(np.arange(10**7, 10**7 + min(change, len(a))).astype(np.uint64))]))
    sk = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert (sk < np.iinfo(np.uint64).max).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sk[0] == sk[1]).mean() - true) < 6 * np.sqrt(0.25 / neardup.COORDS)


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(path).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] == got[102] != got[0]
    assert connected_components(path.where(F.lit(False))).count() == 0
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 3), (4, 5)], "a long, b long")
    assert sorted(r["node"] for r in connected_components(odd).collect()) == [4, 5]


def test_shingles_of_short_texts():
    el, offs = neardup.shingle_sets(pa.array(["", None, "one", "a b", "a b a b", "A B"]), 2)
    assert np.diff(offs).tolist() == [0, 0, 1, 1, 2, 1]
    assert el[offs[3]] == el[offs[5]]
