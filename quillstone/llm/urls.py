"""URL rules and block lists through cascades of Bloom filters, in DataFrame functions alone.

A list of keys (a host, or a host and the beginning of a path) is encoded as a cascade: the first
filter holds the listed keys, the second those keys of the corpus that pass the first without being
listed, the third the listed keys that pass the second, and so on until none is left over. As the
levels are built against every candidate key of the corpus (its complete key universe), asking them
in turn gives exact membership, and judging a URL needs no join: each filter is one array literal of a
size set by the list. Building reads the universe once per level, keeps what passes the earlier levels,
and gathers filter words (64 bits each), never keys. Lists may be tables of any length: keys of a list too long for one
filter of MAX_WORDS words are dealt by a hash to several cascades; a key's shape (labels of the host, characters of the path) has to be one of MAX_SHAPES.

Cases: a null URL, or one without ://, has an empty host and path, which fit no rule; hosts compare
without regard to the case of A-Z, all else literally; repeated rows are judged once each; an empty
table stays empty; rules without a verdict or host count for nothing, and a null path is an empty one.
The columns host, path, rule and verdict replace any of these names; other columns are carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, cut

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that the method itself blocks, with their subdomains, where no rule fits.
BLOCKED_HOSTS = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
BITS_PER_KEY, HASHES = 12, 6
#: Longest filter that becomes a literal, in 64-bit words (8 MB).
MAX_WORDS = 1 << 20
MAX_LEVELS = 40
MAX_SHAPES = 200
_END = "\u0000"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def candidate(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of a rule of so many host labels and path characters, null where the URL can have none."""
    suffix = F.substring_index(host, ".", -labels)
    enough = (F.length(host) > 0) & (F.length(path) >= chars)
    return F.when(enough, F.concat(suffix, F.lit(_END), F.substring(path, 1, chars) if chars else F.lit("")))


@dataclass
class Filter:
    bits: int
    words: dict[int, int] = field(default_factory=dict)

    def positions(self, key: Column) -> list[Column]:
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        return [F.pmod(a.bitwiseXOR(F.shiftright(b, i) if i else F.lit(0).cast("long")).bitwiseXOR(F.shiftleft(b, 7 * i + 1)), F.lit(self.bits)) for i in range(HASHES)]

    def passes(self, key: Column) -> Column:
        # of constants alone, so the optimizer makes one literal of it
        words = F.split(F.lit(",".join(str(self.words.get(i, 0)) for i in range(self.bits // 64))), ",").cast("array<bigint>")
        return F.forall(F.array(*self.positions(key)), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)


def build_filter(keys: DataFrame, n: int) -> Filter:
    """Of the n rows of keys (column key). What is gathered is at most one row for each filter word."""
    f = Filter(max(64, 64 * math.ceil(n * BITS_PER_KEY / 64)))
    if f.bits // 64 > MAX_WORDS:
        raise ValueError(f"{n} keys make a filter of more than {MAX_WORDS} words: split the list by a hash of its keys")
    p = keys.select(F.explode(F.array(*f.positions(F.col("key")))).alias("p"))
    words = p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    f.words = {r["word"]: r["bits"] for r in words.collect()}
    return f


@dataclass
class Cascade:
    levels: list[Filter]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built against."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


@dataclass
class Split:
    """Cascades of a list whose keys are dealt by a hash."""

    parts: list[Cascade]

    def contains(self, key: Column) -> Column:
        part = _part(key, len(self.parts))
        out = F.lit(False)
        for i, c in enumerate(self.parts):
            out = F.when(part == i, c.contains(key)).otherwise(out)
        return out


def _part(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(n))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | Split:
    """listed, universe: one column key, string. Each level holds what wrongly passed the one before."""
    listed = cut(listed.where("key is not null").distinct())
    n = listed.count()
    if not n:
        return Cascade([])
    parts = -(-n * BITS_PER_KEY // (48 * MAX_WORDS))  # three quarters full at most on average
    if parts > 1:
        mine = lambda df, i: df.where(_part(F.col("key"), parts) == i)
        return Split([build_part(mine(listed, i), mine(universe, i)) for i in range(parts)])
    return build_part(listed, universe)


def build_part(listed: DataFrame, universe: DataFrame) -> Cascade:
    n = listed.count()
    if not n:
        return Cascade([])
    levels = [build_filter(listed, n)]
    first = universe.where(F.col("key").isNotNull() & levels[0].passes(F.col("key"))).distinct()
    wrong, right = cut(first.join(listed, "key", "left_anti")), listed
    while n := wrong.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(build_filter(wrong, n))
        wrong, right = cut(right.where(levels[-1].passes(F.col("key")))), wrong
    return Cascade(levels)


def judge(pages: DataFrame, rules: tuple | DataFrame = RULES, blocked_hosts: tuple[str, ...] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """pages (url, ...) with host, path, rule and verdict: that of the longest rule that fits, else the block list's.

    rules: tuples or a table (verdict, host, path); blocked_hosts: names or a table (host). Of rules of
    equal length that both fit, block goes before allow.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([*rules], "verdict string, host string, path string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict")
    df = pages.withColumns({"host": host, "path": path})
    r = rules.where("host is not null").select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    lists = {"block": r.where("verdict = 'block'"), "allow": r.where("verdict = 'allow'"), "listed": blocked_hosts.where("host is not null").select(ascii_lower(F.col("host")).alias("host"), F.lit("").alias("path"))}
    found: list[Column] = []
    listed = F.lit(False)
    parts = df.select("host", "path")
    for name, keys in lists.items():
        shapes = keys.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().limit(MAX_SHAPES + 1).collect()
        if len(shapes) > MAX_SHAPES:
            raise ValueError(f"keys of the list {name!r} have more than {MAX_SHAPES} shapes")
        if not shapes:
            continue
        candidates = [candidate(F.col("host"), F.col("path"), *s) for s in sorted(tuple(s) for s in shapes)]
        universe = parts.select(F.explode(F.array(*candidates)).alias("key"))
        cascade = build_cascade(keys.select(F.concat("host", F.lit(_END), "path").alias("key")), universe)
        for c in candidates:
            if name == "listed":
                listed = listed | cascade.contains(c)
            else:
                found.append(F.when(cascade.contains(c), F.struct(F.length(c).alias("n"), F.lit(name).alias("verdict"), F.replace(c, F.lit(_END), F.lit("")).alias("rule"))))
    best = F.greatest(*found, F.lit(None).cast(_RULE), F.lit(None).cast(_RULE))
    df = df.select("*", F.struct(best.alias("best"), listed.alias("listed")).alias("_best_of_rules"))
    out = df.withColumns({"rule": F.col("_best_of_rules.best.rule"), "verdict": F.coalesce(F.col("_best_of_rules.best.verdict"), F.when(F.col("_best_of_rules.listed"), "block").otherwise("allow"))})
    return out.drop("_best_of_rules")


_RULE = "struct<n:int,verdict:string,rule:string>"
