"""Symbols of source files. Parsing is Python on whole files, dealt by Arrow batches: Python files by its own
syntax tree, TypeScript, Go and Rust by a scanner of tokens and scopes (no parser for them is available here)."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.lineage import spread

SYMBOLS = "name string, kind string, file string, start_line int, end_line int, signature string, calls_to array<string>"

#: A comment, a string, a name, a number, an arrow, a path mark, or any other character.
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|%s|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|::|\S" % "'(?:\\\\.|[^'\\\\\n])*'", re.S)
#: The same where a quote also begins a lifetime.
_TOKEN_RS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\[^']+|[^'\\])'|'[A-Za-z_]\w*|[A-Za-z_$][\w$]*|\d[\w.]*|=>|::|\S", re.S)
#: A regular expression literal, and what may stand before one; elsewhere a slash divides.
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = {"", "(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "<", ">", "~", "^", "=>", "return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "await", "yield"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*$")
_KEYWORDS = {"if", "for", "while", "switch", "match", "return", "catch", "function", "func", "fn", "sizeof", "typeof", "await", "new", "super", "import", "else", "do", "in", "of", "as", "range", "defer", "go", "loop", "move", "async", "yield", "void", "delete", "throw"}
_CLASSES = {"ts": {"class", "interface", "enum"}, "go": {"struct", "interface"}, "rs": {"struct", "trait", "enum"}}
_FUNCTIONS = {"ts": "function", "go": "func", "rs": "fn"}
_VARIABLES = {"ts": {"const", "let", "var"}, "go": {"var", "const"}, "rs": {"let", "const", "static"}}


def callee(node: ast.expr) -> str:
    """A3: a name, or a chain of them; else the text of what is called, to 80 characters."""
    parts, n = [], node
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    if isinstance(n, ast.Name):
        return ".".join([n.id, *reversed(parts)])
    return ast.unparse(node)[:80]


def python_symbols(file: str, text: str) -> list[tuple]:
    """A2 for Python. Methods are functions; lines count from 1; a file that does not parse has no symbols."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []

    def calls(node: ast.AST) -> list[str]:
        return list(dict.fromkeys(callee(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)))

    for node in ast.walk(tree):
        first = lines[node.lineno - 1].strip() if hasattr(node, "lineno") and node.lineno <= len(lines) else None
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, "function", file, node.lineno, node.end_lineno, first, calls(node)))
        elif isinstance(node, ast.ClassDef):
            out.append((node.name, "class", file, node.lineno, node.end_lineno, first, []))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append((ast.get_source_segment(text, node) or first, "import", file, node.lineno, node.end_lineno, None, []))
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        out += [(t.id, "variable", file, node.lineno, node.end_lineno, None, calls(node)) for t in targets if isinstance(t, ast.Name)]
    return sorted(out, key=lambda s: (s[3], s[0]))


def _tokens(text: str, language: str) -> list[tuple[str, int]]:
    """Tokens with their places, without comments; a regular expression literal is one."""
    out, at, before = [], 0, ""
    pattern = _TOKEN_RS if language == "rs" else _TOKEN
    while m := pattern.search(text, at):
        if language == "ts" and m[0] == "/" and before in _BEFORE_REGEX:
            m = _REGEX.match(text, m.start()) or m
        if not m[0].startswith(("//", "/*")):
            before = m[0]
            out.append((before, m.start()))
        at = m.end()
    return out


@dataclass
class _Scope:
    depth: int  #: braces that are open outside of it
    kind: str  #: class, function, variable or block
    symbol: list | None


class BraceScanner:
    """A1 to A3 for TypeScript, Go and Rust: one pass over a file's tokens with a stack of open scopes.

    Comments and strings are no code. Functions are those declared by a keyword; methods are functions of a class body, an
    impl or trait block, or with a receiver. A call belongs to the innermost function or method around it, else to the
    variable whose value it is part of. A declaration ends with its closing brace, or where its statement does.
    """

    def __init__(self, file: str, text: str, language: str):
        self.file, self.text, self.language, self.out = file, text, language, []
        found = _tokens(text, language)
        self.tokens, self.at = [t for t, _ in found], [a for _, a in found]
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.lines = [bisect_left(breaks, a) + 1 for a in self.at]
        self.scopes: list[_Scope] = []
        self.depth = 0

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def closing(self, i: int) -> int:
        """The token that closes the bracket at i; the last one if none does."""
        depth = 0
        for j in range(i, len(self.tokens)):
            depth += (self.tokens[j] in ("(", "[", "{")) - (self.tokens[j] in (")", "]", "}"))
            if not depth:
                return j
        return len(self.tokens) - 1

    def add(self, i: int, name: str, kind: str, end: int | None = None, signature: str | None = None) -> list:
        self.out.append([name, kind, self.file, self.lines[i], self.lines[end if end is not None else i], signature, []])
        return self.out[-1]

    def inside(self, kind: str) -> bool:
        return bool(self.scopes) and self.scopes[-1].kind == kind

    def owner(self) -> list | None:
        return next((s.symbol for s in reversed(self.scopes) if s.kind == "function"), None) or next((s.symbol for s in reversed(self.scopes) if s.kind == "variable"), None)

    def body(self, i: int) -> int:
        """From i on, the brace that opens a body, or the token that ends the declaration without one (negative)."""
        while i < len(self.tokens):
            t = self.tokens[i]
            if t == "{":
                return i
            if t in (";", "}") or self.language == "go" and self.lines[i] > self.lines[i - 1]:
                return -i
            i = self.closing(i) + 1 if t in ("(", "[") else i + 1
        return -(len(self.tokens) - 1)

    def open_body(self, i: int, kind: str, symbol: list | None) -> int:
        """Opens the scope whose body begins from i on; the token to go on with."""
        b = self.body(i)
        if b <= 0:
            if symbol and -b > 0:
                symbol[4] = max(symbol[3], self.lines[max(-b - (self.token(-b) != ";"), 0)])
            return max(-b, i)
        self.scopes.append(_Scope(self.depth, kind, symbol))
        self.depth += 1
        return b + 1

    def statement(self, i: int) -> int:
        """The last token of the statement at i: at a semicolon, or where a line ends with all brackets closed."""
        j = i
        while j < len(self.tokens):
            if self.tokens[j] in ("(", "[", "{"):
                j = self.closing(j)
            if self.token(j + 1) in ("", ";") or self.tokens[j] == ";":
                return j
            if self.lines[j + 1] > self.lines[j] and self.language != "rs" and self.tokens[j] not in (",", "from", "import"):
                return j
            j += 1
        return len(self.tokens) - 1

    def function(self, i: int, method: bool) -> int:
        """A function whose name, or bracket, is the token at i."""
        if self.language == "go" and self.token(i) == "(" and _NAME.match(self.token(self.closing(i) + 1)) and self.token(self.closing(i) + 2) in ("(", "["):
            i, method = self.closing(i) + 1, True
        name = self.token(i) if _NAME.match(self.token(i)) else None
        p = i + (name is not None)
        while p < len(self.tokens) and self.tokens[p] not in ("(", "{", ";"):  # type parameters
            p += 1
        if self.token(p) != "(":
            return p
        end = self.closing(p)
        symbol = self.add(i, name or "<anonymous>", "method" if method else "function", signature=self.text[self.at[p] : self.at[end] + 1])
        return self.open_body(end + 1, "function", symbol)

    def symbols(self) -> list[tuple]:
        i, lang = 0, self.language
        while i < len(self.tokens):
            t, after = self.tokens[i], self.token(i + 1)
            first = i == 0 or self.lines[i - 1] < self.lines[i] or self.tokens[i - 1] in (";", "}", "{")
            while self.inside("variable") and self.depth <= self.scopes[-1].depth and (t == ";" or first and t not in (".", "?", ":", "|", "&")):
                self.scopes.pop()
            if t == "{":
                self.scopes.append(_Scope(self.depth, "block", None))
                self.depth += 1
            elif t == "}":
                while self.scopes and self.scopes[-1].kind == "variable" and self.scopes[-1].depth >= self.depth:
                    self.scopes.pop()
                self.depth -= 1
                if self.scopes and self.scopes[-1].kind != "variable":
                    symbol = self.scopes.pop().symbol
                    if symbol:
                        symbol[4] = self.lines[i]
                if self.inside("variable") and self.scopes[-1].symbol:
                    self.scopes[-1].symbol[4] = self.lines[i]
            elif first and (t == "import" and lang != "rs" and after != "(" or t == "import" and lang == "go" or t == "use" and lang == "rs"):
                end = self.statement(i)
                self.add(i, " ".join(self.text[self.at[i] : self.at[end] + len(self.tokens[end])].split()), "import", end)
                i = end
            elif t == "export" and first and lang == "ts":
                line = self.text[self.at[i] :].split("\n", 1)[0].strip()
                self.add(i, line, "export")
                i += after == "default"
                self.lines_first(i + 1)
            elif t == "type" and lang == "go" and self.token(i + 2) in _CLASSES["go"]:
                i = self.open_body(i + 3, "class", self.add(i, after, "class")) - 1
            elif t in _CLASSES[lang] and lang != "go" and self.token(i - 1) != ".":
                named = bool(_NAME.match(after)) and after not in ("extends", "implements")
                i = self.open_body(i + 1 + named, "class", self.add(i, after if named else "<anonymous-class>", "class")) - 1
            elif t == "impl" and lang == "rs":
                i = self.open_body(i + 1, "class", None) - 1
            elif t == _FUNCTIONS[lang] and self.token(i - 1) != "." and after != ":":
                i = self.function(i + 1 + (after == "*"), self.inside("class")) - 1
            elif self.inside("class") and lang == "ts" and _NAME.match(t) and after in ("(", "<") and t not in _KEYWORDS and self.depth == self.scopes[-1].depth + 1 and self.is_method(i):
                i = self.function(i, True) - 1
            elif t in _VARIABLES[lang] and self.token(i - 1) not in (".", "(") and (first or self.token(i - 1) in ("export", "pub", ")")):
                j = i + 1 + (after == "mut")
                if _NAME.match(self.token(j)):
                    self.scopes.append(_Scope(self.depth, "variable", self.add(i, self.token(j), "variable")))
                    i = j
            elif _NAME.match(t) and after == "(" and (t not in _KEYWORDS or self.token(i - 1) in (".", "::")) and self.token(i - 1) != "new" and (owner := self.owner()):
                j = i
                while self.token(j - 1) in (".", "::") and _NAME.match(self.token(j - 2)):
                    j -= 2
                if self.token(j - 1) != "new" and (name := "".join(self.tokens[j : i + 1])) not in owner[6]:
                    owner[6].append(name)
            i += 1
        return [tuple(x) for x in self.out]

    def lines_first(self, i: int) -> None:
        """What follows an export is declared as if it began its line."""
        if i < len(self.tokens):
            self.tokens[i - 1] = ";"

    def is_method(self, i: int) -> bool:
        """Whether a name and brackets in a class body are a method's, and not a call in a field's value."""
        p = i + 1
        while p < len(self.tokens) and self.tokens[p] != "(":
            if self.tokens[p] in (";", "{", "}", "="):
                return False
            p += 1
        return self.token(i - 1) not in (".", "=", "new", "(", ",") and self.body(self.closing(p) + 1) > 0


def symbols_of(file: str, text: str) -> list[tuple]:
    """A1: the symbols of one file."""
    language = file.lower().rsplit(".", 1)[-1]
    return python_symbols(file, text) if language == "py" else BraceScanner(file, text, {"tsx": "ts"}.get(language, language)).symbols()


def index(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files (path, text) to symbols; files in other languages are left out."""
    known = files.where(F.lower(F.col(path)).rlike(r"\.(ts|tsx|py|go|rs)$") & F.col(text).isNotNull())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for p in parts:
            yield pd.DataFrame([s for a, b in zip(p[path], p[text]) for s in symbols_of(a, b)], columns=names)

    return spread(known.select(path, text)).mapInPandas(run, SYMBOLS)
