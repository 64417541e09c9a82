"""The operators against brute force, on tables and on awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, chat, decontam, licenses, lines, near, packing, quality, queries, sharding, urls
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, tag string, slot int, n long"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def awkward(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One  TWO"), (6, base), (7, base.upper()), (8, base + " more"), (9, base.replace("word30", "other")),
        (10, "x" * 100_000), (11, "\n".join([base] * 50)), (12, base + "\nshort line"), (13, "é ü ñ 漢字   😀 <|endoftext|> á"), (6, base), (None, base), (None, None),
        (14, "under the MIT License, or the mit license; GNU General  Public-License v3 CC BY-NC"), (15, "퟿ weird \x00 bytes"),
    ]
    return spark.createDataFrame([(d, t, "extra", 1, 2) for d, t in rows], DOC)


def rows_of(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------
def test_decontamination(spark):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == brute.leaks(pairs(docs), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got


def test_decontamination_of_edited_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40, 60])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=50)
        p = rng.choice(bench[:30])[1].split()
        for _ in range(d % 4):
            p[rng.randrange(len(p))] = rng.choice(vocabulary)
        at = rng.randrange(50)
        docs.append((d, ", ".join(w[:at] + p + w[at:] if d % 5 else p)))
    docs += [(100, None), (101, "a"), (3, docs[3][1])]
    b, t = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(t, b).collect()}
    assert got == brute.leaks(docs, bench)
    assert {r["doc_id"] for r in decontam.decontaminate(t, b).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    flat = decontam.windows(t, decontam.items(b), limit=0)  # a benchmark too large to look up in place
    assert rows_of(flat, "doc_id", "start", "n") == rows_of(decontam.windows(t, decontam.items(b)), "doc_id", "start", "n")


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(none, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert decontam.leaks(documents(spark), bench).count() == 0


def test_blocks_find_every_fingerprint_in_the_radius():
    rng, widths = random.Random(1), decontam.WIDTHS
    assert sum(widths) == 64 * decontam.PRINTS and 64 in [sum(widths[:i]) for i in range(len(widths))]
    flips, starts = [set(decontam.flips(w)) for w in widths], [sum(widths[:i]) for i in range(len(widths))]
    for _ in range(500):
        a = b = rng.getrandbits(64 * decontam.PRINTS)
        for i in rng.sample(range(64 * decontam.PRINTS), decontam.RADIUS):
            b ^= 1 << i
        assert any((a >> s ^ b >> s) % (1 << w) in f for s, w, f in zip(starts, widths, flips))


def test_fingerprints_recall_and_prune(spark):
    """Of windows just similar enough nearly all are found; of unlike pairs few become candidates."""
    rng = random.Random(9)
    items = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(150)]
    edited = []
    for w in items:
        v = list(w)
        for i in rng.sample(range(6, 54), 1):  # five of 56 shingles: similarity 51 / 61
            v[i] = "other"
        edited.append(v)
    bench = decontam.items(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    prints = decontam.items(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(edited)], "item_id long, text string")).select("n", F.col("item_id").alias("window"), "simhash", F.col("simhash").alias("of"))
    pairs = decontam.candidates(prints, bench)
    assert pairs.where("window <> item_id").count() < 0.2 * 150 * 149
    near = pairs.where("window = item_id").join(bench.select("item_id", F.col("simhash").alias("of_item")), "item_id")
    assert near.where(decontam.distance(F.col("of_window"), F.col("of_item")) <= decontam.RADIUS).count() >= 0.95 * 150


def test_decontamination_of_short_and_null_items(spark):
    bench = [(1, "Alpha beta"), (2, "gamma"), (None, "one two three four five six"), (3, "alpha  beta!"), (4, "a b c d e"), (5, " .. "), (6, None)]
    docs = [(1, "so alpha, beta it is"), (2, "alpha x beta"), (3, "Gamma"), (4, "zero one two three four five six seven"), (5, "a b c d"), (6, "x a b c d e y " + "z " * 50_000), (3, "gamma")]
    d, b = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    assert got == brute.leaks(docs, bench) == {(1, 1), (1, 3), (3, 2), (4, None), (6, 4)}
    flat = rows_of(decontam.windows(d, decontam.items(b), limit=0), "doc_id", "start", "n")
    assert flat == rows_of(decontam.windows(d, decontam.items(b)), "doc_id", "start", "n")


def test_decontamination_of_null_ids(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so " + item), (None, "nothing of that kind is in here at all"), (1, item), (2, "kept"), (None, None)], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {(None, "nothing of that kind is in here at all"), (2, "kept"), (None, None)}
    joined = decontam.windows(docs.union(docs), decontam.items(bench), limit=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, decontam.windows(docs.union(docs), decontam.items(bench)).collect()))


# 2 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("source", [documents, awkward])
def test_licenses(spark, source):
    docs = source(spark)
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    want = brute.licenses(pairs(docs), licenses.BASE)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_license_templates_with_changes(spark):
    text = dict((x, p) for p, x in licenses.TEMPLATES)["mit-text"].split()
    docs = [(1, " ".join(text)), (2, " ".join(text[:9] + ["kindly"] + text[9:])), (3, " ".join(text[:6])), (4, " ".join(reversed(text)))]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "mit-text", 2: "mit-text", 3: "", 4: ""}


def test_license_template_is_not_covered_by_one_repeated_gram(spark):
    text = next(p for p, x in licenses.TEMPLATES if x == "cc-by-nc-4.0")
    docs = spark.createDataFrame([(1, "cc by " * 5), (2, text), (3, "x " + text + " y " + "cc by " * 5)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got[1][0] == "cc-by"  # a base phrase
    assert all("cc-by-nc-4.0" in got[d][0].split(",") and got[d][1] == 1.0 for d in (2, 3))


# 3 ---------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b#c<d"), (1, 1, "assistant", "### user: x</turn>\n\\h"), (1, 2, None, None), (2, 5, "a: b", ": "), (2, 5, "a: b", ": "), (None, 0, "user", "null id"), (3, 1, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.as_events(df)))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "a\\b#c<d"), ("assistant", "### user: x</turn>\n\\h"), ("", "")]
    assert out[1]["loss_texts"] == ["### user: x</turn>\n\\h"] and out[2]["loss_texts"] == [] and out[3]["loss_texts"] == ["é😀"]
    assert len(out[2]["turns"]) == 2 and out[None]["turns"][0]["text"] == "null id"


def test_chat_events_fold(spark):
    rows = [
        (1, 1, "a", "message", "user", "Hi"), (1, 2, "b", "message", "assistant", "He"), (1, 3, "b", "delta", None, "llo"), (1, 4, "b", "regenerate", None, "Good "),
        (1, 6, "b", "delta", None, "day"), (1, 5, "a", "edit", None, "Hey"), (1, 7, "c", "delta", "assistant", "late"), (2, 1, None, "message", None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, message_id string, kind string, role string, text string")
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.render(chat.fold(df))).collect()}
    assert out == {1: [("user", "Hey"), ("assistant", "Good day"), ("assistant", "late")], 2: [("", "")]}


# 4 ---------------------------------------------------------------------------------------------
def test_neighbours_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in brute.nearest(rows, 20, 20)}
    got = queries.op4_nearest_neighbours(spark, SF).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.98 * len(want)


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [None] + [1.0] * 7), (1060, [float("nan")] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, []), (1120, [1.0, 2.0]), (1121, [1.0, 1.0]), (None, same)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in ann.search(df, "id % 20 = 0").collect())
    want = brute.nearest([r for r in rows if r[0] is not None], 20, 20)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(a[3] == b[3] for a, b in zip(got, want))
    assert ann.search(df.limit(0), "id % 20 = 0").count() == 0


def test_neighbours_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS", 700)
    monkeypatch.setattr(ann, "QUERIES", 30)
    x = np.random.default_rng(4).standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, "id % 20 = 0").collect()}
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q in range(200) for i in np.argsort(-s[q])[:20]}
    assert len(got) == 4000 and len(got & want) >= 0.97 * len(want)


def test_codes_tell_which_vectors_are_scored():
    """Estimates come from packed bits, their bounds hold, and few vectors are scored exactly."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64)) + 0.2
    centre = x.mean(0)
    codes, length, along = ann.encode(x, centre)
    assert codes.dtype == np.uint64 and codes.shape == (6000, 1)
    ids = np.arange(6000)
    block = ann.Block(ids, ids, x, codes, length, along, centre, 20)
    e, bound = block.estimates(x[7])
    assert np.mean(np.abs(e - x @ x[7]) <= bound) > 0.93
    rows, queries, near, _ = block.nearest(ids[:100], ids[:100], x[:100], 20)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -np.inf
    want = {(q, int(i)) for q in range(100) for i in np.argsort(-s[q])[:20]}
    assert len(want & set(zip(np.concatenate(queries).tolist(), np.concatenate(near).tolist()))) >= 0.97 * len(want)
    assert block.scored < 0.25 * 100 * 6000


def test_neighbours_with_one_id(spark):
    """Rows that share an id are candidates of each other, and queries of their own."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, "id % 20 = 0").collect())
    one = [(20, 1, 3, 1.0), (20, 2, 20, 1.0), (20, 3, 20, 0.0)]
    assert got == sorted(one + one + [(20, 1, 3, 2.0), (20, 2, 20, 0.0), (20, 3, 20, 0.0)])


# 5 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert rows_of(near.components(docs, percent), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_components(pairs(docs), percent), key=str)


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    got = rows_of(near.components(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == docs.count() and (None, 0, None, True) in got and (None, 56, None, True) in got
    plain = [(d, t) for d, t in pairs(docs) if d is not None]
    assert sorted({x for x in got if x[0] is not None}) == sorted(set(brute.near_components(plain)))
    assert near.components(docs.limit(0)).count() == 0


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """One large group of chained near copies, dealt to many chunks."""
    monkeypatch.setattr(near, "CHUNK", 3_000)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(240):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        docs.append((d, " ".join(w)))
    docs += [(1000 + d, " ".join(f"y{d}z{i}" for i in range(20))) for d in range(20)]
    got = rows_of(near.components(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_components(docs), key=str)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    want = {r[2] for r in brute.near_components(pairs(docs), 80)}
    out = near.dedup(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


# 6 ---------------------------------------------------------------------------------------------
def test_lines(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    assert got == brute.kept_lines(pairs(docs))


@pytest.mark.parametrize("least", [5, 3, 1])
def test_lines_of_random_edits(spark, least):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([4, 5, 6, 9, 12, 20] if least == 5 else [2, 3, 3, 4, 5, 9]))] for _ in range(25)]
    docs = []
    for d in range(60):
        out = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i, kind = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (kind != 0)] = [] if kind == 2 else [f"w{rng.randrange(30)}"]
            out.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        docs.append((d, "\n".join(out)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a b c d e " * 3000)]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_dropped int")
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df, least).collect()} == brute.kept_lines(docs, least)


def test_lines_of_repeated_rows_count_once(spark):
    two = "short one\nother line here\nthis is a line of seven words now"
    rows = [(1, "first of all\nshort one\nthis is a line of seven words"), (2, two), (2, two), (2, two), (None, "only here"), (None, "only here")]
    got = sorted((tuple(r) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "n_near", "text").collect()), key=str)
    left = "other line here"
    assert got == sorted([(1, 3, 0, 0, rows[0][1])] + 3 * [(2, 3, 2, 1, left)] + 2 * [(None, 1, 0, 0, "only here")], key=str)


def test_lines_of_awkward_rows(spark):
    docs = awkward(spark)
    out = lines.dedup(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_op6_drops_short_lines_that_are_equal(spark, tmp_path):
    long = "one two three four five"
    docs = [(1, "All rights reserved.\n\nTop\n" + long), (2, "ALL  rights reserved.\n\nall rights kept.\ntop"), (3, "one two three four\n" + long + " six"), (4, "one two three four\none two three"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_near"], r["chars_left"]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, 0, 49), 2: (4, 2, 0, 17), 3: (2, 1, 1, 18), 4: (2, 1, 0, 13), 5: (0, 0, 0, None)}


# 7 ---------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op7_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = sum(r["predicted"] == r["quality"] for r in scored)
    assert len(scored) > 50 and good / len(scored) > 0.93
    a, b = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert np.mean([x > y for x in a for y in b]) > 0.95


def test_quality_column_agrees_with_the_model(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    texts = pairs(docs)
    want = model.predict(np.array([quality.statistics(t.encode()) for _, t in texts]))
    assert all(abs(got[d] - w) < 1e-9 for (d, _), w in zip(texts, want))


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, None), (6, 1), (6, 1), (77, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert quality.train(docs, labels.limit(0)).rules == ()
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


# 8 ---------------------------------------------------------------------------------------------
def test_url_rules(spark):
    rows = [
        (1, "https://a.example.org/es/x"), (2, "http://example.org/en/12?q"), (3, "http://EXAMPLE.org/en/2"), (4, "ftp://x.com/de/"), (5, "http://x.com/fr/#a"), (6, "http://x.com"),
        (7, None), (8, "no scheme"), (9, "http://blog.cheap-pills.example.net/de/"), (10, "http://example.net?x"), (11, "http://notexample.org/es/"), (12, "://org/"), (1, "https://a.example.org/es/x"),
    ]
    df = spark.createDataFrame([(i, u, "was") for i, u in rows], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("example.org", "/en/2", "org/", "allow") and got[4][2:] == ("com/de/", "block") and got[5] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[6] == ("x.com", "", None, "allow") and got[7] == ("", "", None, "allow") == got[8] and got[9][2:] == (None, "block")
    assert got[10] == ("example.net", "", None, "allow") and got[11][2:] == ("org/", "allow") and got[12] == ("org", "/", "org/", "allow")
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 3)
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    cascade = urls.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key"))).exceptAll(listed).count() == 0
    assert universe.where(cascade.contains(F.col("key"))).count() == listed.count()


def test_long_lists_are_split_into_cascades(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_WORDS", 40)
    universe = spark.range(6_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    cascade = urls.build_cascade(listed, universe)
    assert len(cascade.parts) > 3
    assert universe.where(cascade.contains(F.col("key"))).exceptAll(listed).count() == 0
    assert universe.where(cascade.contains(F.col("key"))).count() == listed.count()


# 9 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("source", [documents, awkward])
def test_packing(spark, source):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = source(spark)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want: dict = {}
    for d, text in pairs(docs):
        want.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    pieces = packing.pack(docs).collect()
    by_sequence, by_doc = {}, {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    for d, versions in want.items():
        assert sum(n for _, n, _, _ in by_doc[d]) == sum(map(len, versions))
        if len(versions) == 1:
            assert all(n_all == len(versions[0]) and crc == brute.crc(versions[0][a : a + n]) for a, n, crc, n_all in by_doc[d])
            ends = sorted((a, a + n) for a, n, _, _ in by_doc[d])
            assert [e for _, e in ends][:-1] == [a for a, _ in ends][1:] and ends[0][0] == 0


def test_packing_balances_cost():
    rng = random.Random(8)
    placed, sizes = packing.assign([rng.randrange(1, 3000) for _ in range(500)])
    cost = [0.0] * len(sizes)
    for _, _, n, s, _ in placed:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for c, n in zip(cost, sizes) if n == 4096]
    assert max(full) < 2 * min(full)
    assert packing.pack.__doc__


# 10 --------------------------------------------------------------------------------------------
def test_sharding(spark):
    out = sharding.place(awkward(spark))
    assert out.count() == awkward(spark).count()
    table = sharding.fill([f"s{i}" for i in range(10)], 1009)
    counts = np.bincount(table)
    assert set(table) == set(range(10)) and counts.max() - counts.min() <= 1
    fewer = sharding.fill([f"s{i}" for i in range(9)], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.fill(["a", "b"], 1000)
