"""Text and coercion functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
TRUNCATED = "\n... [truncated] ...\n"
EMOTIONS = ("certain", "uneasy", "speculating", "confused", "satisfied", "concerned")
SEVERITIES = ("critical", "warning", "note")
VERDICTS = ("rejected", "revised")


def strip(s: Column) -> Column:
    """Without white space of any kind at its ends; trim() takes only spaces away."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units, where characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")


def token_estimate(s: Column, per_token: int = CHARS_PER_TOKEN, utf16: bool = False) -> Column:
    """A token for every four characters begun."""
    return F.ceil((utf16_length(s) if utf16 else F.length(s)) / F.lit(per_token)).cast("int")


def truncate_to_tokens(s: Column, max_tokens: int, marker: str = TRUNCATED) -> Column:
    """At most max_tokens, the marker counted."""
    room = max_tokens * CHARS_PER_TOKEN
    return F.when(F.length(s) <= room, s).otherwise(F.concat(F.substring(s, 1, max(0, room - len(marker))), F.lit(marker)))


def prefix(s: Column, chars: int) -> Column:
    """The first characters, for prompts of a fixed size."""
    return F.substring(s, 1, chars)


def coerce_emotion(raw: Column, known: tuple[str, ...] = EMOTIONS) -> Column:
    """K5: a known emotion in lower case, else uneasy."""
    e = strip(F.lower(raw))
    return F.when(e.isin(*known), e).otherwise(F.lit("uneasy"))


def coerce_number(raw: Column) -> Column:
    """A string as the numeric conversion of a dynamic language reads it: null and blank 0, else the number, NaN if it is none."""
    s = strip(raw.cast("string"))
    return F.when(raw.isNull() | (s == ""), F.lit(0.0)).otherwise(F.coalesce(s.try_cast("double"), F.lit(float("nan"))))


def parse_confidence(raw: Column, semantics: str = "documented") -> Column:
    """K6: a number clamped to 0..1, 0.5 where there is none; as_coded leaves it as it is."""
    n = coerce_number(raw)
    if semantics == "as_coded":
        return n
    return F.when(F.isnan(n), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)))


def coerce_severity(raw: Column) -> Column:
    """K8: a known severity, else note."""
    return F.when(raw.isin(*SEVERITIES), raw).otherwise(F.lit("note"))


def coerce_verdict(raw: Column) -> Column:
    """K7: rejected or revised if so given, else confirmed."""
    return F.when(raw.isin(*VERDICTS), raw).otherwise(F.lit("confirmed"))


def consensus_status(raw: Column) -> Column:
    """Part of K1: agreed and dismissed stay, all else (contested too) is disputed."""
    return F.when(F.lower(raw).isin("agreed", "dismissed"), F.lower(raw)).otherwise(F.lit("disputed"))


def finding_id(issue: Column, locations: Column) -> Column:
    """Part of K1: the first 12 hex digits of the SHA-256 of issue|location,location."""
    return F.substring(F.sha2(F.concat(issue, F.lit("|"), F.array_join(locations, ",")).cast("binary"), 256), 1, 12)


def extract_field(block: Column, field: str) -> Column:
    """What follows FIELD: on its line, trimmed; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?i){field}:\s*(.+)", 1)), F.lit(""))


def to_list(text: Column) -> Column:
    """C11: the lines of a text without bullets, blank ones left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-•*]\s*", "")))
    return F.coalesce(F.filter(lines, lambda x: F.length(x) > 0), F.array().cast("array<string>"))


def json_of(raw: Column) -> Column:
    """The JSON in a fenced block, else the whole text if it is JSON; else null."""
    fenced = strip(F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1))
    fine = lambda s: F.try_parse_json(s).isNotNull()
    return F.when(fenced.isNotNull() & (fenced != "") & fine(fenced), fenced).when(fine(strip(raw)), strip(raw))


def search_tokens(text: Column, longer_than: int = 2) -> Column:
    """C14: words in lower case, between punctuation or any white space, short ones left out."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: F.length(w) > longer_than)


def market(ticker: Column) -> Column:
    """CN, HK or US by the form of a ticker."""
    return F.when(ticker.rlike(r"^\d{6}$"), F.lit("CN")).when(ticker.rlike(r"(?i)^\d{4,5}\.HK$"), F.lit("HK")).otherwise(F.lit("US"))


def first_match(text: Column, patterns: list[str], default: str | None = None) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns], F.lit(default))


def first_class(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class of which a keyword occurs."""
    t, out = F.lower(text), F.lit(default)
    for name, keywords in reversed(classes):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(t, F.lit(k.lower()))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def normal_formula(formula: Column) -> Column:
    """Part of C23: a spreadsheet formula with row numbers replaced by #."""
    return F.regexp_replace(formula, r"(\$?[A-Z]{1,3}\$?)\d+", "$1#")


#: Ranges in formulas, with and without a sheet, and aggregations of one. Fixed values.
RANGE, SHEET_RANGE = r"([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)", r"([A-Za-z_]\w*?)!([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)"
FROM_HEADER = r"(?i)(SUM|AVERAGE|AVG|COUNT|COUNTA|MIN|MAX|SUMPRODUCT)\s*\(\s*([A-Z]{1,3})1:"
VALID_FORMULA = r"(?i)[A-Z]{2,}\s*\(|\$?[A-Z]{1,3}\$?\d+"
SMALL = r"(?i)(SUM|AVERAGE|AVG|COUNT|COUNTA)\s*\(\s*([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)\s*\)"


def out_of_range(formula: Column, rows: Column, sheets: Column) -> Column:
    """Part of C23: the ranges that end far below the data: over thrice its rows, and over 100. rows: of the formula's own
    sheet; sheets: a map of those of all, for formulas that name one (unknown sheets are left alone)."""
    listed = lambda p, n: F.transform(F.regexp_extract_all(formula, F.lit(p), F.lit(n)), lambda x: x)
    far = lambda end, have: (end > have * 3) & (end > 100)
    ends, names = F.transform(listed(SHEET_RANGE, 5), lambda x: x.cast("long")), listed(SHEET_RANGE, 1)
    there = F.filter(F.transform(listed(SHEET_RANGE, 0), lambda x, i: F.when(far(F.get(ends, i), F.nullif(F.try_element_at(sheets, F.get(names, i)), F.lit(0))), x)), lambda x: x.isNotNull())
    own = F.transform(listed(RANGE, 4), lambda x: x.cast("long"))
    here = F.filter(F.transform(listed(RANGE, 0), lambda x, i: F.when(far(F.get(own, i), rows), x)), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, there).otherwise(here)


def header_included(formula: Column, row: Column) -> Column:
    """Part of C23: whether a formula below the header aggregates from row 1."""
    return formula.rlike(FROM_HEADER) & (row > 1)


def small_aggregates(formula: Column) -> Column:
    """Part of C23: the aggregations of one or two cells."""
    first, last = (F.transform(F.regexp_extract_all(formula, F.lit(SMALL), F.lit(n)), lambda x: x.cast("long")) for n in (3, 5))
    found = F.transform(F.regexp_extract_all(formula, F.lit(SMALL), F.lit(0)), lambda x, i: F.when(F.abs(F.get(last, i) - F.get(first, i)) + 1 <= 2, x))
    return F.filter(found, lambda x: x.isNotNull())


def text_as_formula(value: Column, is_formula: Column) -> Column:
    """Part of C24: whether a cell that begins with = is text: none of a formula's signs in a text cell; in a formula cell
    neither a call nor a reference, unless it begins with a quoted string."""
    body = F.trim(F.substring(value, 2, 1 << 30))
    plain = ~value.rlike(r"[+\-*/()&,!:$]")
    empty = ~body.startswith('"') & ~body.rlike(VALID_FORMULA)
    return F.coalesce(value.startswith("=") & F.when(is_formula, empty).otherwise(plain), F.lit(False))


def strength(element: Column, month: Column, others: Column) -> Column:
    """The score of a day's element: 40 if the month's is the same or brings it forth, -20 if the month's overcomes it, and 15 for each of the others that is the same."""
    # what each element is brought forth by, and overcome by. Fixed values.
    bears = F.create_map(*[F.lit(x) for x in ("wood", "water", "fire", "wood", "earth", "fire", "metal", "earth", "water", "metal")])
    beats = F.create_map(*[F.lit(x) for x in ("wood", "metal", "fire", "water", "earth", "wood", "metal", "fire", "water", "earth")])
    season = F.when((month == element) | (month == bears[element]), 40).when(month == beats[element], -20).otherwise(0)
    return season + 15 * F.size(F.filter(others, lambda x: x == element))


def forbidden_functions(formula: Column, names: list[str]) -> Column:
    """Those of the named functions that a formula calls."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.regexp_like(formula, F.concat(F.lit(r"(?i)\b"), n, F.lit(r"\s*\("))))


def deterministic_id(name: Column, namespace: str) -> Column:
    """V2: an id in UUID form from the SHA-1 of the namespace's text and the name."""
    h = F.sha1(F.concat(F.lit(namespace), name).cast("binary"))
    byte = F.conv(F.substring(h, 17, 2), 16, 10).cast("int")
    variant = F.lpad(F.lower(F.hex(byte.bitwiseAND(0x3F).bitwiseOR(0x80))), 2, "0")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def embedding_text(kind: Column, name: Column, signature: Column, calls: Column, called_by: Column, file: Column, start: Column, end: Column) -> Column:
    """The text of a symbol that is embedded."""
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("["), kind, F.lit("] "), name), F.nullif(signature, F.lit("")), listed("Calls: ", calls), listed("Called by: ", called_by),
        F.concat(F.lit("In: "), file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")),
    )


def import_target(text: Column) -> Column:
    """The path that an import statement names."""
    some = lambda c: F.nullif(c, F.lit(""))
    quoted = some(F.regexp_extract(text, r"from\s+['\"]([^'\"]+)['\"]", 1))
    relative = F.when(quoted.startswith(".") & ~quoted.rlike(r"\.tsx?$"), F.concat(quoted, F.lit(".ts"))).otherwise(quoted)
    dotted = some(F.regexp_extract(text, r"from\s+([\w.]+)", 1))
    go = some(F.regexp_extract(text, r"import\s+['\"`]([^'\"`]+)", 1))
    rust = some(F.regexp_extract(text, r"use\s+([\w:]+)", 1))
    return F.coalesce(relative, F.concat(F.replace(dotted, F.lit("."), F.lit("/")), F.lit(".py")), go, F.concat(F.replace(rust, F.lit("::"), F.lit("/")), F.lit(".rs")))


def language(path: Column) -> Column:
    """The language of a file by its extension; null if it is not read."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return (
        F.when(ext == "ts", F.lit("typescript")).when(ext == "tsx", F.lit("tsx")).when(ext == "py", F.lit("python"))
        .when(ext == "go", F.lit("go")).when(ext == "rs", F.lit("rust"))
    )


#: Kinds of characters that fonts lack or that change how text reads, by code points. Fixed values.
SUSPICIOUS = {
    "notdef": (0x00,),
    "control_char": (*range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F),
    "replacement_char": (0xFFFD,),
    "zero_width": (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x034F),
    "bidi_control": (0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069),
    "variation_selector": tuple(range(0xFE00, 0xFE10)),
}
PRIVATE_USE = (0xE000, 0xF8FF)


def code_point_kind(char: Column) -> Column:
    """Part of C21: the kind of a suspicious character, null for others."""
    c = F.ascii(char)
    out = F.when(c.between(*PRIVATE_USE), F.lit("private_use_area"))
    for name, points in SUSPICIOUS.items():
        out = F.when(c.isin(*points), F.lit(name)).otherwise(out)
    return out


def character_similarity(a: Column, b: Column) -> Column:
    """U4: shared over all distinct characters."""
    chars = lambda s: F.array_distinct(F.split(s, ""))
    union = F.size(F.array_union(chars(a), chars(b)))
    return F.when(union > 0, F.size(F.array_intersect(chars(a), chars(b))) / union).otherwise(F.lit(0.0))


def fuzzy_match(a: Column, b: Column, above: float = 0.6) -> Column:
    """One holds the other, or their characters are alike."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (character_similarity(x, y) > above))
