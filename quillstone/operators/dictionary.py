"""Terms of a dictionary in texts, all of them in one pass of each text.

The lower-case terms become an Aho-Corasick automaton, which is broadcast and run over Arrow batches of texts; so the time
a text takes depends on its length and its finds, and not on the number of terms. The dictionary is measured first: one of more than
TERM_BYTES is dealt by a hash into several automata of at most about that size, and each text is passed once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.lineage import cut

#: Bytes of terms, with what the automaton needs for each, that are gathered and broadcast at once.
TERM_BYTES = 32 << 20
_STATE = 100  # about the bytes of a term besides its characters


@lru_cache(4096)
def _is_word(c: str) -> bool:
    import regex

    return bool(regex.match(r"\w", c))


def _boundary(text: str, at: int) -> bool:
    """Whether a word begins or ends before the character at a place."""
    return (at > 0 and _is_word(text[at - 1])) != (at < len(text) and _is_word(text[at]))


def occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text", whole_words: bool = True, limit: int = TERM_BYTES) -> DataFrame:
    """(id, term): for each row of docs each distinct term (column term) that its text holds without regard to case, as
    whole words or anywhere. Null and empty terms and texts hold nothing; repeated rows have their finds each."""
    import ahocorasick

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    t = cut(terms.select("term", F.lower("term").alias("low")).where("low <> ''").distinct())
    size = t.agg(F.coalesce(F.sum(F.octet_length("low") * 8 + F.octet_length("term") + _STATE), F.lit(0))).first()[0]
    parts, found = -(-size // limit), []
    for p in range(parts):
        automaton, named = ahocorasick.Automaton(), {}
        for r in t.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == p).collect():  # about limit bytes
            named.setdefault(r["low"], []).append(r["term"])
        for low, same in named.items():
            automaton.add_word(low, (len(low), same))
        if not named:
            continue
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                at, out = [], []
                for i, x in enumerate(batch.column(1)):
                    whole = x.as_py() or ""
                    held: dict[str, None] = {}
                    for end, (n, same) in shared.value.iter(whole):
                        if same[0] not in held and (not whole_words or _boundary(whole, end + 1 - n) and _boundary(whole, end + 1)):
                            held.update(dict.fromkeys(same))
                    at += [i] * len(held)
                    out += held
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], [id_col, "term"])

        found.append(docs.select(id_col, F.lower(text).alias("_low")).mapInArrow(run, f"`{id_col}` {kind}, term string"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"`{id_col}` {kind}, term string")
