"""Facts in prose: time markers, mentions, profiles and their contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import code_point_kind
from quillstone.operators.dictionary import occurrences

#: Patterns whose first group is a point in time, or a list of characters; attributes of profiles; colours. Fixed values.
TIME_MARKERS = (
    r"(?i)(?:Day|Night)\s+(\d+)", r"(?i)(\d+)\s+(?:days?|weeks?|months?|years?)\s+(?:later|ago|after|before)", r"(?i)(?:Morning|Afternoon|Evening|Night)\s+of\s+(?:Day\s+)?(\d+)",
    r"(?i)Chapter\s+(\d+)", r"(?i)\*\*(?:Timeline|Time|When):\*\*\s*(.+?)(?:\n|$)", r"(?i)\*\*Date:\*\*\s*(.+?)(?:\n|$)",
)
CHARACTERS = (r"(?i)\*\*Characters?:\*\*\s*(.+?)(?:\n|$)", r"(?i)\*\*(?:POV|Perspective):\*\*\s*(.+?)(?:\n|$)")
PROFILE = {
    "age": r"(?i)\*\*Age:\*\*\s*(.+?)(?:\n|$)", "appearance": r"(?i)\*\*Appearance:\*\*\s*(.+?)(?:\n|$)", "hair": r"(?i)hair[\s:]+([^,\n]+)",
    "eyes": r"(?i)eyes[\s:]+([^,\n]+)", "height": r"(?i)\*\*Height:\*\*\s*(.+?)(?:\n|$)", "role": r"(?i)\*\*Role:\*\*\s*(.+?)(?:\n|$)",
}
ALIASES, NAME = r"(?i)\*\*(?:Nicknames?|Aliases?):\*\*\s*(.+?)(?:\n|$)", r"(?m)^#\s+(.+?)$"
COLOURS = r"(?i)\b(black|brown|blonde|red|auburn|white|gray|grey|blue|green|hazel)\b"


def _places(text: Column, pattern: str) -> Column:
    """(pos, marker) of a pattern's matches. The parts between the matches tell where each one is."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(hits, lambda h, k: F.struct((total(gaps, k + 1) + total(hits, k)).alias("pos"), F.trim(F.regexp_extract(h, pattern, 1)).alias("marker")))


def time_markers(text: Column) -> Column:
    """Array of (pos, marker) in order of position."""
    return F.array_sort(F.concat(*[_places(text, p) for p in TIME_MARKERS]))


def listed_names(text: Column) -> Column:
    """Names given on lines of characters or of perspective: a, b & c and d."""
    lines = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CHARACTERS])
    names = F.flatten(F.transform(lines, lambda x: F.split(x, r"[,&]|\sand\s")))
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")


def mentions(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term) where a term occurs as a word or as whole words, without regard to case."""
    return occurrences(docs, terms, id_col, text).distinct()


def undefined(mentioned: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """What is mentioned without being defined."""
    return mentioned.select(key).distinct().join(defined.select(key), key, "left_anti")


def profile(text: Column) -> Column:
    """C17: a map of the attributes that a profile gives."""
    some = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), some(p).alias("value")) for k, p in PROFILE.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def profiles(files: DataFrame) -> DataFrame:
    """C17: name (the first title), profile and aliases of each file (path, text) that has a title."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    listed = F.filter(F.transform(F.split(F.regexp_extract("text", ALIASES, 1), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return files.select("path", some(F.regexp_extract("text", NAME, 1)).alias("name"), profile(F.col("text")).alias("profile"), listed.alias("aliases")).where("name is not null")


def contradictions(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, name, attribute, said, known) of known profiles (name, profile): an age in a sentence on a name
    that is not the profile's, or hair or eyes in such a sentence with a colour and without the profile's words."""
    m = mentions(docs, known.select(F.col("name").alias("term"))).join(known, F.col("term") == F.col("name")).join(docs.select("doc_id", "text"), "doc_id")
    on = lambda rest: F.concat(F.lit(r"(?i)\b\Q"), F.col("name"), F.lit(r"\E\b" + rest))
    of = lambda k: F.try_element_at("profile", F.lit(k))
    age = F.nullif(F.regexp_extract(of("age"), r"\d+", 0), F.lit(""))
    ages = F.transform(F.regexp_extract_all("text", on(r"[^.!?]*\b(\d+)[\s-](?:year|yr)"), F.lit(1)), lambda x: F.struct(F.lit("age").alias("attribute"), x.alias("said"), age.alias("known")))
    rows = [F.filter(ages, lambda x: x["known"].isNotNull() & (x["said"] != x["known"]))]
    for k in ("hair", "eyes"):
        said = F.regexp_extract_all("text", on(rf"[^.!?]*\b{k}\b[^.!?]*"), F.lit(0))
        rows.append(_odd(said, k, of(k)))
    return m.select("doc_id", "name", F.explode(F.concat(*rows)).alias("r")).select("doc_id", "name", "r.*")


def _odd(said: Column, attribute: str, known: Column) -> Column:
    """Of sentences on an attribute those with a colour that lack the profile's words."""
    bad = F.filter(said, lambda x: known.isNotNull() & ~F.contains(F.lower(x), F.lower(known)) & x.rlike(COLOURS))
    return F.transform(bad, lambda x: F.struct(F.lit(attribute).alias("attribute"), x.alias("said"), known.alias("known")))


def name_variants(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Other capitalisations of a name that occur, by document."""
    m = mentions(docs, names.select(F.col("name").alias("term"))).join(docs.select("doc_id", "text"), "doc_id")
    found = F.regexp_extract_all(F.col("text"), F.concat(F.lit(r"(?iU)\b(\Q"), F.col("term"), F.lit(r"\E)\b")), F.lit(1))
    v = F.array_sort(F.array_except(F.array_distinct(found), F.array("term")))
    return m.select("doc_id", F.col("term").alias("name"), v.alias("variants")).where(F.size("variants") > 0)


def first_facts(facts: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """C20: the fact given first."""
    return facts.groupBy(*key).agg(F.min_by(value, order).alias(value))


def suspicious_characters(docs: DataFrame, id_col: str = "doc_id", text: str = "text", around: int = 10) -> DataFrame:
    """Position, character, kind and surroundings of characters that fonts lack; of equal kinds and surroundings the first."""
    # printable ASCII has no kind; the rest is few, so that a text is not carried along with each of its characters
    rare = F.filter(F.transform(F.split(text, ""), lambda ch, i: F.when(~F.ascii(ch).between(0x20, 0x7E), F.struct(i.alias("pos"), ch.alias("ch")))), lambda x: x.isNotNull())
    chars = docs.select(id_col, text, F.explode(rare).alias("_x")).select(id_col, text, "_x.*").where(F.col("ch") != "").withColumn("kind", code_point_kind(F.col("ch"))).where("kind is not null")
    start = F.greatest(F.lit(1), F.col("pos") + 1 - around)
    found = chars.select(id_col, "pos", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0")).alias("char"), "kind", F.col(text).substr(start, F.col("pos") + 2 + around - start).alias("context"))
    return found.groupBy(id_col, "kind", "context").agg(F.min(F.struct("pos", "char")).alias("_f")).select(id_col, "_f.pos", "_f.char", "kind", "context")
