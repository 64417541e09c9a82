"""License scans by diagonal voting.

Texts become words (A-Z lowered; runs of ASCII letters, digits and everything beyond ASCII). Every
rolling K-gram of words is hashed, a gram that occurs in no template is left out at once, and Spark
joins the rest to the template positions of the same gram (the templates are a fixed list, so that
side is broadcast). A match votes for its diagonal, the text position less the template position;
votes are counted for each diagonal with partial aggregation. Neighbouring diagonals of a template (words
left out or put in) are merged, as far as SLACK from one of them, so that a span is no longer than its
template and SLACK words; and spans are verified: grams are compared as text, not only by hash; a base
phrase needs every gram on one diagonal, a longer template COVER of its grams, each counted once however
often the text repeats it. Overlapping spans of a template are one.

Cases: null text is empty: no words, no labels, score 0; places of a repeated phrase all count; rows
repeated in the input are scanned and returned once each; an empty table stays empty; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.wordhash import gram_hashes, word_hashes

K = 2
#: Phrases whose every place is counted, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Longer wordings, matched approximately. Their labels add to those of BASE.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0-notice"),
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Diagonals of one template at most so far apart are one span; the share of its grams that a template needs.
SLACK, COVER = 3, 0.8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _gram_hashes(words: list[bytes]) -> np.ndarray:
    return gram_hashes(word_hashes(words), K)


def _template_rows(templates: list[tuple[str, str, bool]]) -> list[tuple]:
    rows = []
    for t, (phrase, label, base) in enumerate(templates):
        w = words_of(phrase)
        if len(w) < K:
            raise ValueError(f"{phrase!r} has fewer than {K} words")
        rows += [(h, b" ".join(w[o : o + K]).decode(), t, label, base, len(w), o) for o, h in enumerate(_gram_hashes(w).astype(np.int64).tolist())]
    return rows


def scan(docs: DataFrame, base: tuple = BASE, templates: tuple = TEMPLATES, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    rows = _template_rows([(p, x, True) for p, x in base] + [(p, x, False) for p, x in templates])
    known = np.unique(np.array([r[0] for r in rows], np.int64))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, counts, hits = batch.column(0), [], []
            for text in batch.column(1):
                w = words_of(text.as_py())
                h = _gram_hashes(w).astype(np.int64)
                at = np.flatnonzero(known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h)
                counts.append(len(w))
                hits.append([{"pos": int(p), "h": int(h[p]), "gram": b" ".join(w[p : p + K]).decode("utf-8", "replace")} for p in at])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("gram", pa.string())])))], ["row", "doc_id", "n_words", "hits"])
            row += len(ids)

    table = docs.sparkSession.createDataFrame(rows, "h long, gram string, template int, label string, base boolean, size int, offset int")
    hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(grams, "row long, doc_id long, n_words long, hits array<struct<pos:long,h:long,gram:string>>")
    hits = hits.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("x")).select("row", "doc_id", "n_words", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"), F.col("x.gram").alias("gram"))
    votes = (
        hits.join(F.broadcast(table), ["h", "gram"], "left")
        .withColumn("diagonal", F.col("pos") - F.col("offset"))
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "diagonal")
        .agg(F.collect_set("offset").alias("offsets"), F.min("pos").alias("from"), (F.max("pos") + K).alias("to"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    near = order.rangeBetween(0, slack)
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("offsets").over(near))))
    merged = votes.withColumn("votes", F.when(F.col("base"), F.size("offsets")).otherwise(covered).cast("long"))
    merged = merged.withColumns({"from": F.when(F.col("base"), F.col("from")).otherwise(F.min("from").over(near)), "to": F.when(F.col("base"), F.col("to")).otherwise(F.max("to").over(near))})
    merged = merged.withColumn("share", F.col("votes") / (F.col("size") - (K - 1)))
    good = F.col("template").isNotNull() & F.coalesce(F.when(F.col("base"), F.col("votes") == F.col("size") - (K - 1)).otherwise(F.col("share") >= cover), F.lit(False))
    # of a template's good diagonals, one for each run of neighbours
    merged = merged.withColumn("good", good)
    last = F.max(F.when(F.col("good"), F.col("diagonal"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("base") | F.coalesce(F.col("diagonal") - last > slack, F.lit(True))
    merged = merged.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    spans = merged.groupBy("row", "doc_id", "n_words", "template", "label", "base", "good", "span").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.max("share").alias("share"))
    good = F.col("good")
    of_base = good & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(of_base).alias("n_base"), F.min(F.when(of_base, F.col("from"))).alias("first_word"), F.max(F.when(of_base, F.col("from"))).alias("last_word"),
        joined(F.when(of_base, F.col("label"))).alias("base_labels"), joined(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("from", "to", "label", "share")))).alias("spans"),
    )
    return out.drop("row")
