"""Table functions for SQL, by name once register(spark) has been called."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillstone.functions.text import CHARS_PER_TOKEN
from quillstone.operators.diffs import MAX_TOKENS, TRUNCATION, TRUNCATION_ROOM

# a line ends for the columns' patterns at any line end there is, and $ stands before a last one
_DOT, _END = "[^\r\x85\u2028\u2029]", "(?=[\r\x85\u2028\u2029]?\\Z)"
_GIT, _GREEDY, _NEW = (re.compile(p.replace(".", _DOT) + _END) for p in (r"diff --git a/(?:.+?) b/(.+)", r"diff --git a/.+ b/(.+)", r"\+\+\+ b/(.+)"))


def _named(line: str, *patterns: re.Pattern) -> str | None:
    return next((m[1] for m in (p.match(line) for p in patterns) if m), None)


def _sections(lines: list[str]) -> dict[str, list[str]]:
    """The lines of each file's last section, in the order of first sections."""
    out: dict[str, list[str]] = {}
    held: list[str] | None = None
    for line in lines:
        file = _named(line, _GIT, _NEW)
        if file is not None:
            held = out[file] = []
        if held is not None:
            held.append(line)
    return out


def _units(lines: list[str], most: int) -> Iterator[tuple[str, str, bool]]:
    """(file, text, whether a chunk has to begin here): sections, or the hunks of those that are too large."""
    for file, section in _sections(lines).items():
        whole = "\n".join(section)
        if len(whole) <= most:
            yield file, whole, False
            continue
        starts = [i for i, x in enumerate(section) if i == 0 or x.startswith("@@")]
        for a, b in zip(starts, [*starts[1:], len(section)]):
            yield file, "\n".join(section[a:b]), a == 0


def pack(diff: str | None, max_tokens: int) -> Iterator[tuple[str, int, list[str]]]:
    """C4: (content, estimated_tokens, files), the chunks of operators.diffs.chunks, in one pass."""
    most = max_tokens * CHARS_PER_TOKEN
    if diff is None:
        return
    lines = diff.split("\n")
    if len(diff) <= most:
        yield diff, -(-len(diff) // CHARS_PER_TOKEN), list(dict.fromkeys(f for f in (_named(x, _GREEDY, _NEW) for x in lines) if f is not None))
        return
    held: list[str] = []
    files: dict[str, None] = {}
    size = 0
    for file, text, opens in _units(lines, most):
        if held and (opens or size + len(text) > most):
            content = "\n".join(held)
            yield content, -(-len(content) // CHARS_PER_TOKEN), list(files)
            held, files, size = [], {}, 0
        if len(text) > most:
            yield text[: max(0, most - TRUNCATION_ROOM)] + TRUNCATION, max_tokens, [file]
        else:
            held.append(text)
            files[file] = None
            size += len(text)
    if held:
        content = "\n".join(held)
        yield content, -(-len(content) // CHARS_PER_TOKEN), list(files)


class ChangeChunks:
    """change_chunks(changes => TABLE(...) PARTITION BY review ORDER BY ..., max_tokens => n): a row for each chunk of each change set in column
    diff, with the table's other columns, chunk_no, content, estimated_tokens and files.

    Each row is a change set of its own and is let go once it is packed; chunks are numbered from 1 through all rows of a
    review, in the order given. A null diff has no chunk, an empty one has one. A table whose column has a name of the
    result's is refused.
    """

    def __init__(self) -> None:
        self.n = 0

    @staticmethod
    def analyze(changes: AnalyzeArgument, max_tokens: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not changes.isTable:
            raise ValueError("change_chunks takes a TABLE argument")
        names = changes.dataType.names
        if "diff" not in names or not isinstance(changes.dataType["diff"].dataType, T.StringType):
            raise ValueError("change_chunks needs a string column diff")
        if max_tokens is not None and (not max_tokens.isConstantExpression or not isinstance(max_tokens.value, int) or max_tokens.value < 1):
            raise ValueError("max_tokens is a constant from 1")
        out = T.StructType([f for f in changes.dataType.fields if f.name != "diff"])
        out = out.add("chunk_no", T.IntegerType()).add("content", T.StringType()).add("estimated_tokens", T.IntegerType()).add("files", T.ArrayType(T.StringType()))
        if len({n.lower() for n in out.names}) < len(out.names):
            raise ValueError("columns of changes clash with those of the result")
        return AnalyzeResult(schema=out)

    def eval(self, changes: Row, max_tokens: int = MAX_TOKENS) -> Iterator[tuple]:
        keep = [v for k, v in zip(changes.__fields__, changes) if k != "diff"]
        for content, tokens, files in pack(changes["diff"], max_tokens):
            self.n += 1
            yield (*keep, self.n, content, tokens, files)


def register(spark: SparkSession) -> None:
    spark.udtf.register("change_chunks", F.udtf(ChangeChunks))
