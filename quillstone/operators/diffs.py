"""Change sets as text: sections by file, hunks, file lists and token-bounded chunks.

All of it works on the lines of one row, as higher-order functions, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import CHARS_PER_TOKEN, token_estimate

#: Characters that a truncated hunk leaves for its marker, and the marker.
TRUNCATION_ROOM, TRUNCATION = 100, "\n... [TRUNCATED - diff too large] ...\n"
MAX_TOKENS = 6000
_GIT, _NEW = r"^diff --git a/(.+?) b/(.+)$", r"^\+\+\+ b/(.+)$"
SECTION = "array<struct<file:string,content:string>>"
CHUNK = "struct<content:string,estimated_tokens:int,files:array<string>>"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def header_file(line: Column) -> Column:
    """The file that a header line opens; null for other lines."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.regexp_extract(line, _GIT, 2)), some(F.regexp_extract(line, _NEW, 1)))


def _pieces(lines: Column, starts: Column, last: Column) -> Column:
    """The runs of lines from each start (from 1) up to the next."""
    ends = F.slice(F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(last + 1)), 1, F.size(starts))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.slice(lines, p["a"], p["b"] - p["a"]))


def split_by_file(diff: Column) -> Column:
    """SECTION. Lines before the first header go; of sections of one file the last stays, in the first one's place."""

    def of(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: header_file(F.get(lines, i - 1)).isNotNull())
        found = F.transform(_pieces(lines, starts, F.size(lines)), lambda p: F.struct(header_file(F.get(p, F.lit(0))).alias("file"), F.array_join(p, "\n").alias("content")))
        files = lambda s: F.array_distinct(F.transform(s, lambda x: x["file"]))
        return let(found, lambda s: F.transform(files(s), lambda f: F.element_at(F.filter(s, lambda x: x["file"] == f), -1)))

    return F.when(F.coalesce(diff, F.lit("")) == "", F.array().cast(SECTION)).otherwise(let(F.split(diff, "\n"), of))


def split_by_hunk(section: Column) -> Column:
    """A hunk begins at every line with @@ but the first line; what comes before is a hunk of its own."""

    def of(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | F.get(lines, i - 1).startswith("@@"))
        return F.transform(_pieces(lines, starts, F.size(lines)), lambda p: F.array_join(p, "\n"))

    return let(F.split(section, "\n"), of)


def file_list(diff: Column) -> Column:
    """The files that headers name, in order of first appearance."""
    greedy = lambda x: F.nullif(F.regexp_extract(x, r"^diff --git a/.+ b/(.+)$", 1), F.lit(""))
    new = lambda x: F.nullif(F.regexp_extract(x, _NEW, 1), F.lit(""))
    return F.array_distinct(F.array_compact(F.transform(F.split(diff, "\n"), lambda x: F.coalesce(greedy(x), new(x)))))


def changed_paths(diff: Column) -> Column:
    """What the +++ and --- lines name, in order."""
    lines = F.filter(F.split(diff, "\n"), lambda x: x.startswith("+++ ") | x.startswith("--- "))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^[+-]{3}\s*", ""))


def chunks(diff: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """C4: array of CHUNK. A diff that fits is one chunk; else sections, and the hunks of sections that
    are too large, are packed greedily in order, and hunks that are too large are cut short."""
    most = max_tokens * CHARS_PER_TOKEN
    state = f"struct<chunks:array<{CHUNK}>,held:array<string>,files:array<string>,size:int>"
    fresh = F.struct(F.array().alias("chunks"), F.array().alias("held"), F.array().alias("files"), F.lit(0).alias("size")).cast(state)

    def flushed(acc: Column) -> Column:
        content = F.array_join(acc["held"], "\n")
        full = F.struct(content.alias("content"), token_estimate(content).alias("estimated_tokens"), acc["files"].alias("files"))
        return F.when(F.size(acc["held"]) > 0, F.struct(F.array_append(acc["chunks"], full).alias("chunks"), F.array().alias("held"), F.array().alias("files"), F.lit(0).alias("size")).cast(state)).otherwise(acc)

    def put(acc: Column, u: Column) -> Column:
        files = F.when(F.array_contains(acc["files"], u["file"]), acc["files"]).otherwise(F.array_append(acc["files"], u["file"]))
        return F.struct(acc["chunks"].alias("chunks"), F.array_append(acc["held"], u["text"]).alias("held"), files.alias("files"), (acc["size"] + F.length(u["text"])).alias("size")).cast(state)

    def cut(acc: Column, u: Column) -> Column:
        text = F.concat(F.substring(u["text"], 1, most - TRUNCATION_ROOM), F.lit(TRUNCATION))
        one = F.struct(text.alias("content"), F.lit(max_tokens).alias("estimated_tokens"), F.array(u["file"]).alias("files"))
        return F.struct(F.array_append(acc["chunks"], one).alias("chunks"), acc["held"].alias("held"), acc["files"].alias("files"), acc["size"].alias("size")).cast(state)

    def step(acc: Column, u: Column) -> Column:
        n = F.length(u["text"])
        emptied = let(flushed(acc), lambda a: F.when(n > most, cut(a, u)).otherwise(put(a, u)))
        return F.when(u["opens"] | (n > most) | (acc["size"] + n > most), emptied).otherwise(put(acc, u))

    def units(s: Column) -> Column:
        hunks = lambda: F.transform(split_by_hunk(s["content"]), lambda h, i: F.struct(s["file"].alias("file"), h.alias("text"), (i == 0).alias("opens")))
        whole = F.array(F.struct(s["file"].alias("file"), s["content"].alias("text"), F.lit(False).alias("opens")))
        return F.when(F.length(s["content"]) > most, hunks()).otherwise(whole)

    packed = F.aggregate(F.flatten(F.transform(split_by_file(diff), units)), fresh, step, lambda acc: flushed(acc)["chunks"])
    single = F.array(F.struct(diff.alias("content"), token_estimate(diff).alias("estimated_tokens"), file_list(diff).alias("files")))
    return F.when(F.length(diff) <= most, single).otherwise(packed)


def chunk_prompt(parts: Column) -> Column:
    """Chunks joined, each under a line that numbers it and names its files."""
    n = F.size(parts).cast("string")
    head = lambda c, i: F.concat(F.lit("--- Chunk "), (i + 1).cast("string"), F.lit("/"), n, F.lit(" ("), F.array_join(c["files"], ", "), F.lit(") ---\n"), c["content"])
    return F.array_join(F.transform(parts, head), "\n\n")


def chunk_rows(changes: DataFrame, diff: str = "diff", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each chunk: the other columns of changes, chunk_no from 1, content, estimated_tokens, files."""
    keep = [c for c in changes.columns if c != diff]
    return changes.select(*keep, F.posexplode(chunks(F.col(diff), max_tokens)).alias("chunk_no", "chunk")).select(*keep, (F.col("chunk_no") + 1).alias("chunk_no"), "chunk.*")
