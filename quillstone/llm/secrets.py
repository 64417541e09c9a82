r"""Secrets in whole texts: stated patterns, and random strings told by character Markov models; DataFrame functions alone.

Base spans, of each kind leftmost and not overlapping: assign, a name such as token or api_key with : or = and a value of
LEAST["assign"] characters or more; access, AKIA and what follows in [A-Z0-9]; hex, a run of lower-case hex digits. A match that is too short is
dropped and hides nothing behind it.

The method adds spans of the kind random. Two Markov chains of characters, of random strings and of ordinary identifiers, are
counted in Spark from labelled samples (token, label). Every run of at least RUN characters of the alphabet is
read once, adding up the log-likelihood ratio of each character given the one before; the segment of the largest sum
is reported if that is THRESHOLD or more, and no base span touches it.

Samples: label 1 are the values of base spans and DRAWN strings that are drawn from usual alphabets by a hash of their
number; label 0 are the words outside base spans, alone and joined as identifiers are (_, -, /, or a capital). Words come from
about SAMPLE documents, those whose hash falls into a fixed share; scores and spans cover all documents, whole texts.

Positions are in code points. They are running sums of the lengths between matches, in slices of SLICE so that a text of very many
matches costs no square of them.

Cases: null and empty texts have no spans; repeated rows are judged alike; ties (two segments of one sum) go to the one that ends first;
null ids are carried; without any document the models know drawn strings alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns in the order of their kinds, the group whose length counts, and the least length.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: What is searched for: a run of access or hex is long enough or not whatever stands around it, so short ones need not be found.
_SEARCH = PATTERNS | {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
GROUP = {"assign": 2, "access": 0, "hex": 0}
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = (*PATTERNS, "random")
#: What a text must match to be looked through for a kind.
_GATES = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
_SHARES = 1 << 20
RUN, SEGMENT, THRESHOLD = 20, 16, 15.0
SAMPLE, DRAWN, SMOOTH = 20_000, 8_000, 0.5
WORD = r"[A-Za-z0-9+/_=-]"
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SLICE = 512
#: Codes of the alphabet's characters; a word begins after the code below them.
_FIRST, _CODES = ord("+"), ord("z") - ord("+") + 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(a: Column) -> Column:
    """Sums of an array of longs up to each element; a: not empty."""
    one = lambda x: F.aggregate(x, F.array().cast("array<bigint>"), lambda out, v: F.array_append(out, F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("long")) + v))
    slices = _let(a, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SLICE).cast("int")), lambda i: F.slice(v, i * SLICE + 1, F.lit(SLICE))))
    inner = F.transform(slices, one)

    def whole(parts: Column) -> Column:
        before = _let(one(F.transform(parts, lambda p: F.element_at(p, -1))), lambda s: F.concat(F.array(F.lit(0).cast("long")), F.slice(s, F.lit(1), F.size(s) - 1)))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda v: v + b)))

    return _let(inner, whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern that has none of no length: match, start and end, and value, what the group holds."""
    zipped = F.arrays_zip(F.split(text, pattern).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def place(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda r: (F.length(r["before"]) + F.length(r["match"])).cast("long")))
        return F.zip_with(rows, ends, lambda r, e: F.struct(r["match"].alias("match"), (e - F.length(r["match"])).alias("start"), e.alias("end"), r["value"].alias("value")))

    # what stands behind the last match has no match beside it
    rows = _let(zipped, lambda z: F.slice(z, F.lit(1), F.size(z) - 1))
    return _let(rows, lambda r: F.when(F.size(r) > 0, place(r)))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a kind (start, rank, end) with their value; none: an empty array."""
    fine = F.filter(matches(text, _SEARCH[kind], GROUP[kind]), lambda m: F.length(m["value"]) >= LEAST[kind])
    rank = F.lit(list(KINDS).index(kind))
    found = F.transform(fine, lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), m["value"].alias("value")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string>>")
    return F.coalesce(F.when(text.rlike(_GATES[kind]), found), none)


def _steps(token: Column) -> Column:
    """Of each character of a token the number of (the one before, it)."""
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c) - _FIRST)
    return _let(codes(token), lambda c: F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(c, F.lit(1), F.size(c) - 1)), c, lambda p, x: (p + 1) * _CODES + x))


@dataclass
class Model:
    """Log-likelihood ratios of random to ordinary, by the number of a step."""

    ratios: list[float]

    def table(self) -> Column:
        # of constants alone, so the optimizer makes one literal of it
        return F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")

    def best(self, token: Column) -> Column:
        """The segment of the largest sum: best, first (its start) and last (its end, exclusive)."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("i"), F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"))

        def step(acc: Column, s: Column) -> Column:
            value = F.get(self.table(), s)
            opens = acc["sum"] <= 0
            total, since = F.when(opens, value).otherwise(acc["sum"] + value), F.when(opens, acc["i"]).otherwise(acc["from"])
            more = total > acc["best"]
            return F.struct(
                total.alias("sum"), since.alias("from"), (acc["i"] + 1).alias("i"), F.when(more, total).otherwise(acc["best"]).alias("best"),
                F.when(more, since).otherwise(acc["first"]).alias("first"), F.when(more, acc["i"] + 1).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(_steps(token), start, step)


def drawn(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """n random strings of 20 to 59 characters, of each alphabet in turn."""
    one = reduce(lambda out, ia: F.when(F.col("id") % len(ALPHABETS) == ia[0], F.lit(ia[1])).otherwise(out), enumerate(ALPHABETS), F.lit(None).cast("string"))
    size = (F.pmod(F.xxhash64("id"), F.lit(40)) + 20).cast("int")
    rows = spark.range(n).withColumns({"alphabet": one, "size": size})
    char = lambda i: F.substring(F.col("alphabet"), (F.pmod(F.xxhash64(F.col("id"), i), F.length("alphabet")) + 1).cast("int"), F.lit(1))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), char), "").alias("token"))


def samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct labelled rows (token, label): 1 random, 0 ordinary; words of about so many documents."""
    kept = int(min(1.0, sample / max(1, docs.count())) * _SHARES)
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(_SHARES)) < kept)).select("text")
    values = some.select(F.explode(F.flatten(F.array(*[F.transform(base_spans(F.col("text"), k), lambda x: x["value"]) for k in PATTERNS]))).alias("token"))
    rest = reduce(lambda t, k: F.regexp_replace(t, _SEARCH[k], " "), PATTERNS, F.col("text"))
    words = F.regexp_extract_all(rest, F.lit(WORD + "{2,}"), F.lit(0))

    def joined(a: Column, b: Column) -> Column:
        way = F.pmod(F.xxhash64(a, b), F.lit(4))
        return F.concat(a, F.when(way == 0, F.lit("_")).when(way == 1, F.lit("-")).when(way == 2, F.lit("/")).otherwise(F.lit("")), F.when(way == 3, F.initcap(b)).otherwise(b))

    pairs = _let(words, lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), joined)).otherwise(F.array().cast("array<string>"))))
    ordinary = some.select(F.explode(pairs).alias("token")).distinct()
    random = values.union(drawn(docs.sparkSession)).distinct()
    return random.withColumn("label", F.lit(1)).union(ordinary.withColumn("label", F.lit(0)))


def train(labelled: DataFrame) -> Model:
    """Both chains from labelled tokens (token, label), of which characters outside the alphabet are left out. What is gathered is a count for each step at most."""
    t = labelled.select("label", F.regexp_replace("token", "[^" + WORD[1:], "").alias("token")).where("token != ''")
    counts = t.select("label", F.explode(_steps(F.col("token"))).alias("step")).groupBy("label", "step").count().collect()
    n = {(r["label"], r["step"]): r["count"] for r in counts}
    of = {}
    for (label, step), c in n.items():
        of[label, step // _CODES] = of.get((label, step // _CODES), 0) + c
    chance = lambda label, step: (n.get((label, step), 0) + SMOOTH) / (of.get((label, step // _CODES), 0) + SMOOTH * _CODES)
    return Model([math.log(chance(1, i) / chance(0, i)) for i in range((_CODES + 1) * _CODES)])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with n_assign, n_access, n_hex, base and all: the base spans and all of them (start, rank, end), in order of start and kind."""
    d = docs.withColumns({f"_{k}": base_spans(F.coalesce("text", F.lit("")), k) for k in PATTERNS})
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    d = d.withColumn("_base", plain(F.array_sort(F.concat(*[f"_{k}" for k in PATTERNS]))))
    runs = F.when(F.col("text").rlike(WORD + "{%d}" % RUN), matches(F.col("text"), WORD + "{%d,}" % RUN))
    scored = F.transform(runs, lambda m: F.struct(m["start"].alias("at"), model.best(m["match"]).alias("b")))
    fine = F.filter(scored, lambda x: (x["b"]["best"] >= THRESHOLD) & (x["b"]["last"] - x["b"]["first"] >= SEGMENT))
    d = d.withColumn("_more", F.transform(fine, lambda x: F.struct((x["at"] + x["b"]["first"]).alias("start"), F.lit(len(PATTERNS)).alias("rank"), (x["at"] + x["b"]["last"]).alias("end"))))
    clear = _let(F.struct("_more", "_base"), lambda y: F.filter(y["_more"], lambda x: ~F.exists(y["_base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    counts = {f"n_{k}": F.size(f"_{k}").cast("long") for k in PATTERNS}
    return d.withColumns({**counts, "all": F.array_sort(F.concat("_base", F.coalesce(clear, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))))}).select(
        "doc_id", "text", *counts, F.col("_base").alias("base"), "all"
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.lit(",".join(KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.split(kinds, ","), x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs, with models trained from these."""
    d = docs.select("doc_id", "text")
    found = find(d, train(samples(d)))
    return found.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
