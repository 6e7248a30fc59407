import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for p, own in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= {str(x) for x in own if x is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return out


ITEM = " ".join(f"Alpha{i}" for i in range(20))
CASES = [
    (1, "before " + ITEM + " after"), (2, ITEM.upper() + " " + ITEM), (3, " ".join(ITEM.split()[:12])), (4, "short item"), (5, "a short-item, twice short item"), (6, ""), (7, None), (8, "..."),
    (9, "x " * 2000 + ITEM), (1, "before " + ITEM + " after"), (None, ITEM), (10, "é日本 ünïcode"), (11, " ".join(ITEM.split()[3:17])),
]
ITEMS = [(1, ITEM), (2, "short item"), (3, ""), (4, None), (5, "..."), (None, "ünïcode"), (6, " ".join(ITEM.split()[5:]) + " more words"), (7, ITEM)]


@pytest.mark.parametrize("bench_bytes", [1 << 20, 60])
def test_equals_brute_force(spark, bench_bytes):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.find_contamination(docs, items, bench_bytes=bench_bytes).select("row.doc_id", "found.n_words", "found.n_hit", "found.hit_items").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(CASES, ITEMS)))


def test_cut_text(spark, clashing):
    docs = spark.createDataFrame([(1, f"é before, {ITEM}! after"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r["row"]["doc_id"]: r["found"] for r in decontam.find_contamination(docs, items).collect()}
    assert got[1]["cut_text"] == "é before, ! after" and got[2]["cut_text"] is None and len(got[1]["spans"]) == 1
    found = decontam.find_contamination(clashing, items)
    assert found.select("row.*").columns == clashing.columns and found.count() == clashing.count()


def test_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(empty, none).count() == 0
    assert all(r["found"]["n_hit"] == 0 for r in decontam.find_contamination(docs, none).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=5))
def test_index_finds_every_occurrence(segments, patterns):
    text = np.array([x for s in segments for x in [*s, 0]])
    fm = decontam.FMIndex(text, 5, sample=4)
    wide = np.zeros((len(patterns), 4), np.int64)
    for k, p in enumerate(patterns):
        wide[k, 4 - len(p) :] = p
    lo, hi = fm.search(wide, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(fm.locate(np.arange(lo[k], hi[k])).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(xs):
    text = np.array([*xs, 0])
    seps = iter(range(len(text)))
    keyed = [(-len(text) + next(seps)) if x == 0 else x for x in text.tolist()]
    assert decontam.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: keyed[i:])


def test_query_columns(spark):
    df = decontam.op9(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    none = df.where("n_items = 0").first()
    assert none["items_sha256"] == hashlib.sha256(b"").hexdigest()
