import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hashloom.llm import catalogue, fingerprint, pieces, pii, tokencount, warc

SMALL = "/root/testdata/sf0.001"


# WARC ---------------------------------------------------------------------------------------------------------------


def test_warc_cases(spark):
    rows = [(1, "http://a.example.com/x?q=1#f", "same"), (2, "https://b.example.com:443", "same"), (3, None, "same"), (None, "http://n/", "same"), (4, "http://e/\n", None), (5, "http://e/", ""), (6, "weird url", "é" * 50_000), (6, "weird url", "é" * 50_000), (7, "http://a.example.com/x?q=1", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("urlkey", F.lit("clash"))
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode())
        best = max((p for p, _, h in rows if (h or "") == html and p is not None), default=None)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == best else ("revisit", best))
        assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"].decode() == html
    assert warc.archive_round_trip(pages.where(F.lit(False))).count() == 0


def test_warc_lookup_reads_only_its_keys(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".org/p"), (F.col("id") % 250).cast("string")).alias("url"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("html"))
    captures = warc.write_archives(pages, f"{tmp_path}/a", file_bytes=5000)
    tops = warc.build_index(captures, f"{tmp_path}/i", shards=3, block_lines=16)
    keys = spark.createDataFrame([("org,h3)/p10",), ("org,none)/",), ("",), ("zzz",), (None,)], "urlkey string")
    got = warc.lookup(spark, keys, tops, f"{tmp_path}/i", f"{tmp_path}/a").collect()
    assert sorted(r["page_id"] for r in got) == [i for i in range(500) if i % 7 == 3 and i % 250 == 10]
    hot = spark.range(200).select(F.col("id").alias("page_id"), F.lit("http://one.org/").alias("url"), F.col("id").cast("string").alias("html"))
    tops = warc.build_index(warc.write_archives(hot, f"{tmp_path}/b"), f"{tmp_path}/j", shards=4, block_lines=8)
    assert warc.lookup(spark, warc.url_keys(hot), tops, f"{tmp_path}/j", f"{tmp_path}/b").count() == 200


def test_url_key():
    assert warc.url_key("HTTP://u@A.b.C:80/x?y#z") == "c,b,a)/x?y" and warc.url_key(None) == "" and warc.url_key("https://a.b") == "b,a)/"


@pytest.mark.parametrize("name", ["op2_minhash_neardup", "op4_warc_index", "op9_fm_decontamination"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    r = con.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(str(tuple(x[c] for c in cols)) for x in df.collect()) == sorted(str(tuple(v[at.index(c)] for c in cols)) for v in r.fetchall())


# token counts -------------------------------------------------------------------------------------------------------


def test_token_histogram(spark, docs, empty):
    n = [len(tokencount.encode(r["text"] or "")) for r in docs.collect()]
    h = tokencount.length_histogram(tokencount.token_lengths(docs))
    for r in h.collect():
        L = r["n_tokens"]
        assert r["n_docs"] == n.count(L) and r["docs_from"] == sum(x >= L for x in n) and r["tokens_from"] == sum(x for x in n if x >= L)
        assert r["docs_upto"] == sum(x <= L for x in n) and r["tokens_upto"] == sum(x for x in n if x <= L) and r["tokens_cut"] == sum(min(x, L) for x in n)
        assert r["total_docs"] == len(n) and r["total_tokens"] == sum(n)
    got = {(r["kind"], r["argument"]): r["value"] for r in tokencount.answers(h, [1, 50, 10**6], [0.5, 1.0]).collect()}
    assert got["cut", 10.0**6] == sum(n) and got["docs_from", 50.0] == sum(x >= 50 for x in n) and got["docs_from", 10.0**6] == 0
    assert {r["value"] for r in tokencount.answers(h.limit(0), [1], [0.5]).collect()} == {None}
    assert got["cut", 50.0] == sum(min(x, 50) for x in n) and got["quantile", 0.5] == sorted(n)[(len(n) + 1) // 2 - 1] and got["quantile", 1.0] == max(n)
    assert tokencount.length_histogram(tokencount.token_lengths(empty)).count() == 0


def test_token_query_by_plain_python(spark):
    n = [len(tokencount.encode(r["text"] or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = catalogue.queries()["op5_token_histogram"](spark, SMALL).collect()
    rows = {r["argument"]: r for r in got if r["kind"] == "length"}
    assert set(rows) == set(n) and all(r["n_docs"] == n.count(L) and r["tokens_cut"] == sum(min(x, L) for x in n) and r["n_tokens"] == L for L, r in rows.items())
    for L in tokencount.LIMITS:
        told = {r["kind"]: r for r in got if r["argument"] == L and r["kind"] != "length"}
        assert told["cut"]["tokens_cut"] == sum(min(x, L) for x in n) and told["docs_from"]["docs_from"] == sum(x >= L for x in n)
    for q in tokencount.QUANTILES:
        assert next(r for r in got if r["kind"] == "quantile" and r["argument"] == q)["n_tokens"] == min(x for x in n if sum(y <= x for y in n) >= q * len(n))


def test_long_white_space():
    for t in ("a" + " " * 7000 + "b", "x" + " " * 6001, "\n" * 6000 + "q", " " * 5000 + "\n\nfoo"):
        assert tokencount.encode(t) == tokencount.encoding(tokencount.VOCABULARY).encode_ordinary(t)
    assert tokencount.encode(" " * 2_000_000)


# sampled pieces -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=8))
def test_pieces_round_trip(texts):
    v = pieces.vocabulary()
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offs = pieces.sample(pa.array(texts, pa.string()), np.arange(len(texts)), v)
    raw, cuts = v.decode(ids, offs)
    assert [bytes(raw[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [t or "" for t in texts]


def test_pieces_follow_the_lattice():
    """Sampled frequencies against all segmentations of a word."""
    v = pieces.vocabulary()
    table = {bytes(v.bytes[v.at[i] : v.at[i + 1]]): i for i in range(v.size) if np.isfinite(v.weights[i])}

    def every(b):
        if not b:
            return [((), 0.0)]
        return [((table[b[:n]], *rest), v.weights[table[b[:n]]] + w) for n in range(1, len(b) + 1) if b[:n] in table for rest, w in every(b[n:])]

    want = every(b" there")
    total = np.logaddexp.reduce([w for _, w in want])
    n = 40_000
    ids, offs = pieces.sample(pa.array(["there"] * n), np.arange(n), v)
    got = {}
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        k = tuple(ids[a:b].tolist())
        got[k] = got.get(k, 0) + 1
    assert set(got) <= {s for s, _ in want}
    for s, w in want:
        p = np.exp(w - total)
        assert abs(got.get(s, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_runs_of_spaces_have_pieces_of_marks():
    """The whole lattice: a run of spaces is segmented in every way that the vocabulary allows, not a mark at a time."""
    v = pieces.vocabulary()
    table = {bytes(v.bytes[v.at[i] : v.at[i + 1]]): i for i in range(v.size) if np.isfinite(v.weights[i])}
    assert sum(b" " * k in table for k in range(2, 17)) > 8

    def every(b):
        return [((), 0.0)] if not b else [((table[b[:n]], *rest), v.weights[table[b[:n]]] + w) for n in range(1, len(b) + 1) if b[:n] in table for rest, w in every(b[n:])]

    want = every(b"    at")  # the leading space among them
    total, n = np.logaddexp.reduce([w for _, w in want]), 30_000
    ids, offs = pieces.sample(pa.array(["   at"] * n), np.arange(n), v)
    got = {}
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        k = tuple(ids[a:b].tolist())
        got[k] = got.get(k, 0) + 1
    assert set(got) <= {s for s, _ in want} and len(want) > 8
    for s, w in want:
        p = np.exp(w - total)
        assert abs(got.get(s, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_long_units():
    """A unit of 200,000 bytes without a space, and as many spaces, come back whole."""
    v = pieces.vocabulary()
    texts = ["x" * 200_000, " " * 200_000 + "end"]
    ids, offs = pieces.sample(pa.array(texts), np.arange(2), v)
    raw, cuts = v.decode(ids, offs)
    assert [bytes(raw[a:b]).decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == texts


def test_pieces_query(spark):
    """The registered query: pieces that the vocabulary joins to the text, their number, and the hash of what they decode to."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = catalogue.queries()["op10_sampled_pieces"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        assert r["n_pieces"] == len(r["pieces"]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        raw = b"".join(bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("\u2581", " ").encode() for i in r["pieces"])
        assert raw.decode() == (" " + text[r["doc_id"]] if text[r["doc_id"]] else "")


def test_clashing_columns(spark, docs, clashing):
    """Further columns under the names that operators use change nothing."""
    for make in (
        lambda df: tokencount.length_histogram(tokencount.token_lengths(df)), lambda df: pieces.sampled_pieces(df),
        lambda df: fingerprint.fingerprints(df), lambda df: fingerprint.edited_fingerprints(df),
    ):
        assert sorted(map(str, make(clashing).collect())) == sorted(map(str, make(docs).collect()))


def test_pieces_table(spark, docs, empty):
    a = {(r["doc_id"], tuple(r["pieces"])) for r in pieces.sampled_pieces(docs).collect()}
    b = pieces.sampled_pieces(docs.repartition(3)).collect()
    assert a == {(r["doc_id"], tuple(r["pieces"])) for r in b} and len(b) == docs.count()
    texts = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert {(r["doc_id"], r["decoded"]) for r in b} == texts and all(r["n_pieces"] == len(r["pieces"]) for r in b)
    assert pieces.sampled_pieces(empty).count() == 0
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, _ = pieces.sample(pa.array(["The quick brown fox"]), np.array([1]), pieces.vocabulary())
    assert m.decode([int(i) for i in ids]) == "The quick brown fox"


# personal data ------------------------------------------------------------------------------------------------------


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
}


def brute_base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])]


ODD = [
    "a@b.c_d@e.f", "x@y.z@w.v", "a@b a@b.c.", "..@-.-", "1.2.3.4.5.6.7.8", "01.002.0003.4", "256.1.1.1 1.1.1.256", "999999999999999999999.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111 4111111111111111",
    "12345678901234567890123", "+1 (555) 123-4567", "+1 555", "+49 30 123456-78 9012345678", "++1 2345678901", "é日 a@b.co 😀 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "0 0000000000000", "a.b@c.d.e.f@g.h.i", "%+-@a.b-", "", None,
]


def listed_rows(spark, df):
    found = pii.find(df)
    return {r[0]: r for r in found.select("row.doc_id", pii.listed(pii.KINDS[:-1]).alias("base"), pii.listed(pii.KINDS).alias("all"), pii.redacted(F.col("row.text")).alias("text")).collect()}


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = listed_rows(spark, df)
    for i, t in enumerate(ODD):
        assert got[i]["base"] == ",".join(brute_base(t)), t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="01259 .-+@ab()é", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", *[v.alias(k) for k, v in pii.base_spans(F.col("text")).items()])
    for r in df.collect():
        assert [f"{k}:{s['b']}:{s['e']}" for k in BASE for s in r[k]] == brute_base(texts[r["doc_id"]])


def test_ip_parts_are_compared_whole(spark):
    odd = ["1.2.3.20240101", "10.0.0.10000", "1.2.3.10000", "10000.1.2.3", "1.2.3.1000", "1.2.3.2550", "1.2.3.256", "000255.0.00.0001", "0.0.0.0", "1.2.3.00000010", "1.2.3.0000000256"]
    got = listed_rows(spark, spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    for i, t in enumerate(odd):
        assert got[i]["base"] == ",".join(brute_base(t)), t
        assert got[i]["text"] == ("[PII]" if brute_base(t) else t)


def test_bootstrapping(spark):
    """Hexadecimal seeds teach the pattern `key: `, which then finds identifiers of other shapes, and those are found elsewhere."""
    rows = [(i, f"some words key: {hashlib.md5(str(i).encode()).hexdigest()[:20]} and more") for i in range(12)]
    rows += [(100, "a note key: ZX12QW99 here"), (101, "in other words ZX12QW99 appears"), (102, "the year2024 and room42b, nothing to see"), (103, "the 20240101 and the 19991231"), *((200 + i, "ordinary words here and there, in other hands, and the words end there") for i in range(40))]
    got = listed_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[100]["all"] == "id:12:20" and got[101]["all"] == "id:15:23" and got[102]["all"] == "" and got[103]["all"] == ""
    assert got[100]["text"] == "a note key: [PII] here" and got[102]["text"] == "the year2024 and room42b, nothing to see"


def test_bootstrapping_discovers_what_is_hidden(spark):
    """Of the tokens in the test table, nine tenths are no seeds: the pattern before them finds them, whatever their shape, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    gold = {(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', r["text"] or "")}
    found = pii.find(docs, seed_shapes="^[0-9a-f]{39}[07]$").select("row.doc_id", F.explode("pii.id").alias("s")).select("doc_id", "s.b", "s.e")
    got = {tuple(r) for r in found.collect()}
    assert len(gold) > 100 and len(got & gold) > 0.9 * len(gold) and len(got - gold) < 0.1 * len(got)


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Spans are sent to the texts while they are few, whatever Spark takes their size for; beyond the bound the result is the same."""
    rows = [(i, f"some words key: {hashlib.md5(str(i).encode()).hexdigest()[:20]} and more") for i in range(12)]
    rows += [(100, "a note key: ZX12QW99 here"), (101, "mail a1@b2.example and year2024"), (102, ""), (103, None), *((200 + i, "ordinary words here and there") for i in range(40))]
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shown(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        own = spark.createDataFrame([(k, f"t{k}", k % 2 == 0) for k in range(10)], "__row long, text string, may boolean")
        ids = spark.createDataFrame([(4, [(1, 2)]), (6, [(3, 4), (5, 9)])], "__row long, id array<struct<b:int,e:int>>")
        for bound, join in ((3, "BroadcastHashJoin"), (2, "SortMergeJoin")):
            monkeypatch.setattr(pii, "BROADCAST_SPANS", bound)
            out = pii._with_ids(own, ids, F.col("may"))
            assert join in shown(out)
            got = {r["__row"]: (r["text"], [tuple(x) for x in r["id"] or []]) for r in out.collect()}
            assert got == {k: (f"t{k}", {4: [(1, 2)], 6: [(3, 4), (5, 9)]}.get(k, [])) for k in range(10)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_candidates_of_any_length_and_words_of_any_length(spark):
    """Long identifiers, signs inside them, and a word of 5,000 letters as the pattern."""
    word = "k" * 5000
    rows = [(i, f"note {word}: {hashlib.md5(str(i).encode()).hexdigest()} end") for i in range(8)]
    rows += [(20, f"note {word}: ab-12_cd/ef+34.gh end"), (21, f"note {word}: {'9a' * 400} end"), (22, f"note {'k' * 4999}: zz12zz12 stop"), *((100 + i, "the words end there") for i in range(40))]
    got = listed_rows(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[20]["all"] == "id:5007:5024" and got[21]["all"] == "id:5007:5807" and got[22]["all"] == ""


def test_pii_query_by_plain_python(spark):
    """Every column of the registered query; of spans, the base ones."""
    got = {r["doc_id"]: r for r in catalogue.queries()["op7_bootstrapped_pii"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        own, row = brute_base(r["text"]), got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in BASE] == [sum(x.startswith(f"{k}:") for x in own) for k in BASE]
        assert row["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [x for x in row["spans"].split(",") if x and not x.startswith("id:")] == own


def test_pii_edges(spark, docs, clashing, empty):
    assert pii.find(empty).count() == 0
    out = pii.find(clashing)
    assert out.select("row.*").columns == clashing.columns and out.count() == docs.count()
    overlap = spark.createDataFrame([(1, "call +1.234.567.8901 or 10.0.0.1 a@10.0.0.1")], "doc_id long, text string")
    assert listed_rows(spark, overlap)[1]["text"] == "call [PII] or [PII] [PII]"


# fingerprints -------------------------------------------------------------------------------------------------------


def shingles(t, n=5):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    p = [""] * (n - 1) + w
    return {tuple(p[i : i + n]) for i in range(len(w))}


def test_fingerprints(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
    got = {(r["doc_id"], r["edited"]): r for r in fingerprint.edited_fingerprints(docs).withColumns({"near_edited": fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")), "near_next": fingerprint.resemblance(F.col("sketch"), F.col("next_sketch"))}).collect()}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        r = got[d, t[: len(t) - m] + nxt[:m]]
        assert r["n_chars"] == len(t)
        for col, other in (("near_edited", r["edited"]), ("near_next", nxt)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[col] - true) < 0.2, (d, col)
    assert fingerprint.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("cuts", [8, 1000])
def test_successors_over_many_ranges(spark, monkeypatch, cuts):
    """Ranges of a few rows, by quantiles and by steps between them; a third of the rows under one id, and null ids."""
    monkeypatch.setattr(fingerprint, "ROWS_A_RANGE", 7)
    monkeypatch.setattr(fingerprint, "MOST_CUTS", cuts)
    rows = [(i * i, f"t{i:05d} and some more") for i in range(100)] + [(777, f"many {i * 7919 % 101} under one id") for i in range(70)] + [(None, f"none {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = fingerprint._ranges(df.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("key"), F.xxhash64("text").alias("h"))).groupBy("range").count()
    assert ranges.agg(F.max("count")).first()[0] < 60 and ranges.count() > 5
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], spark_hash(r[1]), r[1]), reverse=True)
    got = sorted((str(r["doc_id"]), r["edited"]) for r in fingerprint.edited_fingerprints(df).collect())
    want = [(str(d), t[: len(t) - len(t) // 3] + order[(i + 1) % len(order)][1][: len(t) // 3]) for i, (d, t) in enumerate(order)]
    assert got == sorted(want)


def spark_hash(*values):
    """xxhash64 as Spark chains it: 64 bits with seed 42, each value seeded by the hash before; None leaves it as it is."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), h)
    return h - 2**64 if h >> 63 else h


def plain_sketch(t):
    w = [spark_hash(x) for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
    p = [0] * 4 + w
    return sorted({spark_hash(*p[i : i + 5]) for i in range(len(w))})[:128]


def plain_likeness(a, b):
    u = sorted({*a, *b})[:128]
    return len([x for x in u if x in a and x in b]) / len(u) if u else 1.0


def test_fingerprint_query_by_plain_python(spark):
    """Every column of the registered query."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows.sort(reverse=True)
    got = {r["doc_id"]: r for r in catalogue.queries()["op8_bottom_k_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    hexes = lambda s: "".join(f"{x % 2**64:016X}" for x in s)
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(n)
        want = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), plain_likeness(set(a), set(b)), plain_likeness(set(a), set(c)))
        assert tuple(got[d]) == want


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(300))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_sketch(df, c, f"s{c}", words=1)
    r = df.select(
        (fingerprint.merge(F.col("sa"), F.col("sb")) == F.col("sc")).alias("same"), fingerprint.distinct_count(F.col("sc")).alias("n"),
        fingerprint.containment(F.col("sa"), F.col("sc")).alias("inside"), fingerprint.containment(F.col("sc"), F.col("sa")).alias("part"), fingerprint.resemblance(F.col("sa"), F.col("sc")).alias("like"),
    ).first()
    assert r["same"] and r["n"] == pytest.approx(700, rel=0.3) and r["inside"] == pytest.approx(1, abs=0.2) and r["part"] == pytest.approx(4 / 7, abs=0.2) and r["like"] == pytest.approx(4 / 7, abs=0.15)


# the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, clashing, tmp_path):
    cur = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, cur, SMALL).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == clashing.columns, name
        cur = out
    got = {r["doc_id"]: r["text"] for r in cur.collect()}
    assert 2 not in got and 3 not in got and cur.count() <= clashing.count()


def test_pipeline_on_nothing(spark, empty):
    cur = empty
    for _, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, SMALL)
    assert cur.count() == 0


def test_pipeline_run(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert 0.5 * len(docs) < len(got) <= len(docs) and len({r["doc_id"] for r in got}) == len(got)
    whole = sum(r["text"] == docs[r["doc_id"]] for r in got)
    assert whole > 0.8 * len(got)  # most texts have nothing to take out
    assert not any(re.search(BASE["email"][0], r["text"]) for r in got)


def test_catalogue():
    sql = catalogue.oracle_sql()
    assert set(sql) <= set(catalogue.queries()) and all(isinstance(v, str) for v in sql.values())
    assert sorted(int(k[2:].split("_")[0]) for k in catalogue.queries()) == list(range(1, 11))
