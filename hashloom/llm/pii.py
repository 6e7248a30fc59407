"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers. DataFrame functions only.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches per kind that pass their kind's test. Candidates are
maximal runs of ASCII letters, digits and inner _ / + . - of at least LEAST_LENGTH characters, however long, with a digit
among them. A candidate's lexical patterns are what stands next to it, up to the candidates on either side: the word before it and the
two words before it with the signs between, and the signs and the word after it. Seeds are candidates inside base spans or
of a well-known shape. Then, for ROUNDS rounds on the graph of patterns and instances (candidate values):

* a pattern's score is the share of its occurrences in the corpus that stand beside a candidate, times k / (k + 1) for k distinct
  trusted instances (seeds or accepted ones); it needs SUPPORT of them, and them to be SHARE of its distinct instances. What
  is not trusted yet does not count against a pattern, ordinary words beside it do;
* an instance's confidence is 1 for a seed, else the noisy-or of its patterns' scores.

Candidates whose value ends at ACCEPT or more become spans of kind `id`, in whatever context they stand, unless they
overlap a base span. Counts are over all texts; patterns and instances stay distributed.

Defined results: null is the empty text, which has no spans; repeated rows each get theirs; texts and words of any length are read
whole; patterns are compared in lower case; offsets are code points, ends exclusive; kinds are ordered as in KINDS, then by
start; an empty table gives no rows; extra columns, whatever their names, pass through find().
The patterns below are the base ones written so that long runs cost linear time; they match the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_table

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
SUPPORT = 3
SHARE = 0.05
BROADCAST_PATTERNS = 500_000
BROADCAST_SPANS = 1_000_000
ACCEPT = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LEAST_LENGTH = 6
_SIGN = "[^\\p{L}0-9]{1,6}+"
_WORD = "(?<!\\p{L})\\p{L}++"
CANDIDATE = r"(?<![0-9A-Za-z])(?=[A-Za-z_/+.-]*+[0-9])[0-9A-Za-z](?:[_/+.-]*+[0-9A-Za-z]++)*+"
#: Patterns by kind: where they stand in the text before or after a candidate, and anywhere.
BEFORE = {"l1": _WORD + _SIGN, "l2": _WORD + _SIGN + "\\p{L}++" + _SIGN}
AFTER = {"r1": _SIGN + "\\p{L}++"}
#: Shapes of access keys and hexadecimal secrets.
SEED_SHAPES = r"^AKIA[0-9A-Z]{16}$|^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,64}$"

_SPAN = "array<struct<b:int,e:int,v:string>>"


def _matches(text: Column, regex: str, gate: Column) -> Column:
    """Spans (b, e, v) of all matches: the texts between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.slice(F.split(text, regex, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(between, found, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m"), m.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, x):
        b = acc["at"] + x["g"]
        return F.struct((b + x["m"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(b.alias("b"), (b + x["m"]).alias("e"), x["v"].alias("v")))).alias("spans"))

    return F.when(gate, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(_SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)
    # every second digit from the right is doubled; 9 is taken off above 9
    def add(acc, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _ip_ok(v: Column) -> Column:
    def part(p):
        p = F.ltrim(p, F.lit("0"))
        return (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, "\\."), part)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (b, e, v) by base kind."""
    digit = F.rlike(text, F.lit("[0-9]"))
    return {
        "email": _matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_matches(text, IP, digit & F.contains(text, F.lit("."))), lambda s: _ip_ok(s["v"])),
        "card": F.filter(_matches(text, CARD, digit), lambda s: _luhn(s["v"])),
        "phone": F.filter(_matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["v"])).between(9, 15)),
    }


def _candidates(text: Column) -> Column:
    """Candidates with the patterns beside each."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    between = F.split(text, CANDIDATE, -1)
    kinds = "array<struct<b:int,e:int,v:string,patterns:array<string>>>"
    ahead = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    beside = F.zip_with(ahead, F.slice(between, F.lit(2), F.size(found)), lambda x, n: F.struct(x["g"].alias("g"), x["m"].alias("m"), n.alias("n")))
    empty = F.array().cast(kinds)

    def patterns(x):
        l = [F.concat(F.lit(f"{k}:"), F.lower(F.regexp_extract(x["g"], f"({p})$", 1))) for k, p in BEFORE.items()]  # noqa: E741
        r = [F.concat(F.lit(f"{k}:"), F.lower(F.regexp_extract(x["n"], f"^({p})", 1))) for k, p in AFTER.items()]
        return F.filter(F.array(*l, *r), lambda p: F.length(p) > 3)

    def step(acc, x):
        b = acc["at"] + F.char_length(x["g"])
        e = b + F.char_length(x["m"])
        one = F.struct(b.alias("b"), e.alias("e"), x["m"].alias("v"), patterns(x).alias("patterns"))
        return F.struct(e.alias("at"), F.when(F.length(x["m"]) >= LEAST_LENGTH, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(F.rlike(text, F.lit("[0-9]")), F.aggregate(beside, start, step, lambda acc: acc["spans"])).otherwise(empty)


def _everywhere(text: Column) -> Column:
    """All patterns of a text, overlapping ones too."""

    def every(kind: str, pattern: str) -> Column:
        here = f"(?=({pattern}))" if kind in BEFORE else f"(?<![^\\p{{L}}0-9])(?=({pattern}))"
        return F.transform(F.regexp_extract_all(text, F.lit(here), F.lit(1)), lambda m: F.concat(F.lit(f"{kind}:"), F.lower(m)))

    return F.concat(*[every(k, p) for k, p in {**BEFORE, **AFTER}.items()])


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT, keep_text: bool = True, seed_shapes: str = SEED_SHAPES) -> DataFrame:
    """(row, pii): docs' columns (less text, unless keep_text) in struct `row`, and for each of KINDS its spans, an array of (b, e), in struct `pii`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]).alias("row")
    base = base_spans(F.col("__t"))
    rows = docs.select(own, text.alias("__t")).withColumns({**{f"__{k}": v for k, v in base.items()}, "__cand": _candidates(F.col("__t"))}).drop("__t")
    # row numbers are drawn once, into a written table
    rows = persist_table(rows.withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
    plain = {k: F.transform(f"__{k}", lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"))) for k in KINDS[:-1]}
    hits = lambda s: F.exists(F.concat(*plain.values()), lambda x: (x["b"] < s["e"]) & (s["b"] < x["e"]))
    cand = rows.where(F.size("__cand") > 0).select("__row", F.explode(F.transform("__cand", lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["v"].alias("v"), s["patterns"].alias("patterns"), hits(s).alias("base")))).alias("c")).select("__row", "c.*")
    cand = persist_table(cand.withColumn("seed", F.col("base") | F.rlike("v", F.lit(seed_shapes))), "pii-candidates")
    values = persist_table(cand.groupBy("v").agg(F.max("seed").alias("seed")), "pii-values")
    trust = values.select("v", F.col("seed").cast("double").alias("conf"), "seed")
    reach = persist_table(cand.select("v", F.explode("patterns").alias("pattern")).groupBy("v", "pattern").agg(F.count("*").alias("n")), "pii-graph")
    # patterns that a round may reach: those with enough distinct candidates, seeds or not
    wanted = persist_table(reach.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= support).select("pattern"), "pii-patterns")
    seen = docs.select(F.explode(_everywhere(text)).alias("pattern"))
    # short strings; beyond the bound all patterns of all texts are shuffled
    known = F.broadcast(wanted) if wanted.count() <= BROADCAST_PATTERNS else wanted
    totals = persist_table(seen.join(known, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total")), "pii-totals")
    reach = reach.join(wanted, "pattern", "left_semi")
    for _ in range(rounds):
        trust = persist_table(trust, "pii-trust")
        edges = reach.join(trust, "v")
        score = edges.groupBy("pattern").agg(F.sum("n").alias("s"), F.count("*").alias("distinct"), F.count_if(F.col("conf") >= accept).alias("k"))
        score = score.where((F.col("k") >= support) & (F.col("k") >= SHARE * F.col("distinct"))).join(totals, "pattern")
        score = score.select("pattern", (F.col("s") / F.greatest("total", "s") * F.col("k") / (F.col("k") + 1)).alias("score"))
        voted = edges.where("not seed").join(score, "pattern").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("voted"))
        trust = trust.join(voted, "v", "left").select("v", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("voted", F.lit(0.0))).alias("conf"), "seed")
    ids = cand.where("not base").join(trust.where(F.col("conf") >= accept).select("v"), "v", "left_semi")
    ids = persist_table(ids.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("id")), "pii-ids")
    out = _with_ids(rows, ids, F.exists("__cand", lambda s: ~hits(s)))
    return out.select("row", F.struct(*[plain[k].alias(k) for k in KINDS[:-1]], F.coalesce("id", F.array().cast("array<struct<b:int,e:int>>")).alias("id")).alias("pii"))


def _with_ids(rows: DataFrame, ids: DataFrame, may: Column) -> DataFrame:
    """rows with `id` of ids(__row, id), null where there is none, as in all rows that `may` is false for. Whole texts stand in rows, so they stay
    where they are while the spans are few enough to broadcast (some 100 bytes each); beyond the bound, those that may have ids are shuffled."""
    if (ids.agg(F.sum(F.size("id"))).first()[0] or 0) <= BROADCAST_SPANS:
        return rows.join(F.broadcast(ids), "__row", "left")
    none = F.lit(None).cast(ids.schema["id"].dataType)
    return rows.where(may).join(ids, "__row", "left").unionByName(rows.where(~may).withColumn("id", none))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans in struct column `pii`, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(F.col(f"pii.{kind}"), lambda s: F.concat(F.lit(f"{kind}:"), s["b"].cast("string"), F.lit(":"), s["e"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def redacted(text: Column, mark: str = "[PII]") -> Column:
    """The text with every span of `pii` replaced by mark; overlapping spans merge."""
    spans = F.array_sort(F.concat(*[F.col(f"pii.{k}") for k in KINDS]))
    kind = "array<struct<b:int,e:int>>"

    def merge(acc, s):
        joins = (F.size(acc) > 0) & (s["b"] < F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0)))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.struct(F.get(acc, F.size(acc) - 1)["b"].alias("b"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], s["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(spans, F.array().cast(kind), merge)
    edge = lambda m, i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["e"])
    pieces = F.transform(F.sequence(F.lit(0), F.size(merged)), lambda i: F.substring(text, edge(merged, i) + 1, F.coalesce(F.get(merged, i)["b"], F.char_length(text)) - edge(merged, i)))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, keep_text=False)
    counts = [F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:-1]]
    return found.select("row.doc_id", *counts, F.sha2(listed(KINDS[:-1]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))

