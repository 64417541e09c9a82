"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import ann, chat, decontam, licenses, lines, merkle, near, packing, quality, secrets, sharding, trie, urls
from quillstone.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", "\\" + text), (-7, 1, "assistant", "\\" + text)], rows.schema)
    out = chat.read_back(chat.render(chat.fold(chat.as_events(rows.unionByName(extra)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("_loss", F.array_join("loss_texts", "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", F.length("text").cast("long").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def _urls_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in urls.BLOCKED_HOSTS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES {rules}),
m AS (SELECT page_id, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, r.verdict DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1"""


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 14 + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', '')) + length(text) - length(replace(text, '<', '')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def _sharding_sql() -> str:
    slots = ",".join(map(str, sharding.fill([f"shard-{i}" for i in range(sharding.SHARDS)])))
    return f"""
WITH t AS (SELECT [{slots}] AS slots),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(slots[slot + 1] AS INTEGER) AS shard FROM d, t"""


#: The table of crc32, one list; and what it makes of an integer's decimal digits, null of null.
_CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc)"


def _crc32(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _trie_sql() -> str:
    return f"""
WITH {_CRC},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, length(text) AS size, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS digest FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS n FROM d),
h AS (SELECT conv_id, conv_id - conv_id % {trie.SPAN} AS base, {_crc32("conv_id")} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM c), crc),
r AS (SELECT h.conv_id, n, digest, size FROM h JOIN c ON c.conv_id = base AND n <= h UNION ALL SELECT h.conv_id, n, digest, size FROM h JOIN c ON c.conv_id = h.conv_id AND n > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY n) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM h),
node AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY path),
below AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
whole AS (SELECT p.path, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM node JOIN p ON p.conv_id = node.conv_id AND p.depth <= node.depth LEFT JOIN below ON below.path = node.path GROUP BY p.path),
ended AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN whole USING (path) LEFT JOIN below USING (path) LEFT JOIN ended USING (path)
  LEFT JOIN node up ON node.depth > 0 AND up.path = substr(node.path, 1, 32 * (node.depth - 1))"""


def _merkle_sql(deep: int = 6) -> str:
    """For at most FAN ** deep documents a source, and as many sources."""
    fan = merkle.FAN
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join([*map(field, merkle.FIELDS[:-1]), field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, by: str, start: str) -> str:
        """name_k: nodes (by, pos, digest, n) of a level; name_top: the last; of start, by, pos, digest and n."""
        out = f"{name}_0 AS ({start})"
        for k in range(deep):
            out += f",\n{name}_r{k} AS (SELECT {by}, pos // {fan} AS pos, string_agg(digest, '' ORDER BY pos) AS run, any_value(n) AS n FROM {name}_{k} WHERE n > 1 GROUP BY {by}, pos // {fan})"
            out += f",\n{name}_{k + 1} AS (SELECT {by}, pos, sha256(run) AS digest, (n + {fan - 1}) // {fan} AS n FROM {name}_r{k})"
        tops = " UNION ALL ".join(f"SELECT {by}, digest FROM {name}_{k} WHERE n = 1" for k in range(deep + 1))
        return out + f",\n{name}_top AS ({tops})"

    joins, proof, folded = "", "", "coalesce(tampered, leaf)"
    for name, by, pos in (("a", "source", "l.pos"), ("b", "one", "l.place")):
        for k in range(deep):
            run, i = f"{name}{k}.run", f"(({pos} // {fan**k}) % {fan})"
            on = f"{name}{k}.source IS NOT DISTINCT FROM l.source" if by == "source" else "true"
            joins += f" LEFT JOIN {name}_r{k} {name}{k} ON {on} AND {name}{k}.pos = {pos} // {fan ** (k + 1)}\n"
            before, behind = f"substr({run}, 1, 64 * {i})", f"substr({run}, 64 * {i} + 65)"
            proof += f" || coalesce({before} || {behind}, '')"
            folded = f"CASE WHEN {run} IS NULL THEN {folded} ELSE sha256({before} || {folded} || {behind}) END"
    return f"""
WITH {_CRC},
d AS (SELECT doc_id, source, {digest("text")} AS leaf, CASE WHEN {_crc32("doc_id")} % {merkle.TAMPERED} = 0 THEN {digest(lower)} END AS tampered FROM documents, crc),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
{tree("a", "source", "SELECT source, pos, leaf AS digest, n FROM e")},
{tree("b", "one", "SELECT 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, digest, count(*) OVER () AS n FROM a_top")},
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM a_top),
l AS (SELECT e.*, s.subroot, s.place FROM e JOIN s ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, b_top.digest AS root, sha256(''{proof}) AS proof_sha256, {folded} AS folded_root FROM l, b_top
{joins})"""


_ALL = (
    op1_decontamination, op2_license_scan, op3_chat_format, op4_nearest_neighbours, op5_near_duplicates,
    op6_line_dedup, op7_quality, op8_url_filter, op9_packing, op10_sharding,
    op11_prefix_trie, op12_merkle_manifest, op13_secret_scan,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op3_chat_format": _CHAT_SQL, "op8_url_filter": _urls_sql(), "op10_sharding": _sharding_sql(), "op11_prefix_trie": _trie_sql(), "op12_merkle_manifest": _merkle_sql(3)}
