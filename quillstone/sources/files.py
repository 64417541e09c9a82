"""Scans of files and directories, and the sinks that go with them. Paths are read by Spark alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_GLOB = "*.{ts,tsx,py,go,rs}"
#: Parts of paths that are never read. Fixed values.
IGNORED = r"node_modules|\.git|/dist/|/build/|/vendor/|__pycache__|\.next"
MAX_PROMPTS = 1000
CHANGES = "new_path string, old_path string, diff string, new_file boolean, deleted_file boolean, renamed_file boolean"


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def repository(spark: SparkSession, root: str) -> DataFrame:
    """The source files below a directory, each once, but for ignored folders."""
    return _texts(spark, root, CODE_GLOB).where(~F.col("path").rlike(IGNORED)).dropDuplicates(["path"])


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown below a directory, folders that begin with a dot left out."""
    return _texts(spark, root, "*.md").where(~F.col("path").rlike(r"/\.[^/]+/"))


def prompts(spark: SparkSession, root: str) -> dict[str, str]:
    """Templates by name; a folder of a few files, of which more than MAX_PROMPTS are refused."""
    rows = _texts(spark, root, "*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), "text").limit(MAX_PROMPTS + 1).collect()
    if len(rows) > MAX_PROMPTS:
        raise ValueError(f"{root} holds more than {MAX_PROMPTS} templates")
    return {r["name"]: r["text"] for r in rows}


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses with changes and diff_refs: one row a change."""
    schema = f"iid int, diff_refs struct<base_sha:string,head_sha:string,start_sha:string>, changes array<struct<{CHANGES.replace(' ', ':').replace(',:', ',')}>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("iid").alias("mr_iid"), "diff_refs.*", F.inline_outer("changes"))


def decoded(content: Column) -> Column:
    """A base64 file content as text; null if it is none."""
    return F.try_to_binary(content, F.lit("base64")).cast("string")


_RANGE = re.compile(r"^(?:(?:'([^']+)'|([^'!]+))!)?\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)$")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def parse_range(text: str) -> tuple[str | None, int, int, int, int]:
    """S10: "Sheet!A1:F100" as sheet, first column and row, last column and row."""
    m = _RANGE.match(text.strip())
    if not m:
        raise ValueError(f"no range: {text!r}")
    return m[1] or m[2], column_number(m[3]), int(m[4]), column_number(m[5]), int(m[6])


def cell_range(cells: DataFrame, text: str) -> DataFrame:
    """Cells (sheet, row, col, value) of a range as rows under the header's names; rows without any value go."""
    sheet, c1, r1, c2, r2 = parse_range(text)
    inside = cells.where((F.col("sheet") == sheet if sheet else F.lit(True)) & F.col("col").between(c1, c2) & F.col("row").between(r1, r2))
    names = {r["col"]: r["value"] for r in inside.where(F.col("row") == r1).collect()}  # at most the range's columns
    wanted = {c: names.get(c) or f"col{c}" for c in range(c1, c2 + 1)}
    rows = inside.where(F.col("row") > r1).groupBy("row").pivot("col", list(wanted)).agg(F.first("value"))
    rows = rows.select("row", *[F.col(str(c)).alias(n) for c, n in wanted.items()])
    return rows.where(F.coalesce(*[F.col(n).cast("string") for n in wanted.values()]).isNotNull())


def dated_examples(names: DataFrame, col: str = "name") -> DataFrame:
    """File names that begin with a date, oldest first; others go."""
    d = F.to_date(F.try_to_timestamp(F.substring(col, 1, 10), F.lit("yyyy-MM-dd")))
    return names.withColumn("date", F.when(F.col(col).rlike(r"^\d{4}-\d{2}-\d{2}"), d)).where("date is not null").orderBy("date", col)


GRADING = "summary struct<pass_rate:double,passed:int,failed:int,total:int>, timing struct<total_duration_seconds:double>, execution_metrics struct<total_tool_calls:int,errors_encountered:int,output_chars:bigint>, user_notes_summary struct<uncertainties:array<string>,needs_review:array<string>,workarounds:array<string>>"


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """Grading.json of eval-*/config/run-* folders with keys from their paths; time from timing.json beside it where it is missing; broken files go."""
    g = spark.read.schema(GRADING).json(f"{root}/eval-*/*/run-*/grading.json", multiLine=True, mode="PERMISSIVE").withColumn("path", F.col("_metadata.file_path"))
    part = lambda p: F.regexp_extract("path", p, 1)
    g = g.select(
        part(r"/eval-(\d+)/").try_cast("long").alias("eval_id"), part(r"/eval-[^/]+/([^/]+)/run-").alias("config"), part(r"/run-(\d+)/").try_cast("int").alias("run_number"), "summary.*", "timing", "execution_metrics", "user_notes_summary",
        F.regexp_replace("path", r"/grading\.json$", "").alias("folder"),
    ).where("total is not null")
    t = spark.read.schema("total_duration_seconds double, total_tokens bigint").json(f"{root}/eval-*/*/run-*", multiLine=True, pathGlobFilter="timing.json")
    t = t.select(F.regexp_replace(F.col("_metadata.file_path"), r"/timing\.json$", "").alias("folder"), F.col("total_duration_seconds").alias("beside"), "total_tokens")
    j = g.join(t, "folder", "left")
    notes = F.concat(*[F.coalesce(f"user_notes_summary.{c}", F.array().cast("array<string>")) for c in ("uncertainties", "needs_review", "workarounds")])
    return j.select(
        "config", "eval_id", "run_number", "pass_rate", "passed", "failed", "total", F.coalesce(F.nullif("timing.total_duration_seconds", F.lit(0.0)), "beside", F.lit(0.0)).alias("time_seconds"),
        F.coalesce("total_tokens", "execution_metrics.output_chars", F.lit(0)).alias("tokens"), F.coalesce("execution_metrics.total_tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("execution_metrics.errors_encountered", F.lit(0)).alias("errors"), notes.alias("notes"),
    )


def find_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """Folders that hold outputs/, pruned of hidden and installed ones, by eval id (missing last) and name."""
    f = files.where(F.col(path).contains("/outputs/") & ~F.col(path).rlike(r"/(node_modules|\.git|__pycache__|skill|inputs)/"))
    runs = f.select(F.regexp_extract(path, r"^(.*?)/outputs/", 1).alias("run")).distinct()
    return runs.withColumn("eval_id", F.regexp_extract("run", r"/eval-(\d+)", 1).try_cast("long")).orderBy(F.col("eval_id").asc_nulls_last(), "run")


FEEDBACK = "project_id string, mr_iid int, finding_id string, action string, comment string, created_at timestamp"


def ensure_feedback(spark: SparkSession, name: str) -> None:
    """The feedback table, if it is missing, dealt by project."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({FEEDBACK}) USING parquet PARTITIONED BY (project_id)")


def record_feedback(rows: DataFrame, name: str) -> None:
    """O3: appends rows; an unknown action is an error, as a CHECK would have it."""
    fine = F.col("action").isin("accepted", "dismissed", "modified")
    checked = rows.withColumn("action", F.when(fine, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))
    order = [c for c in ("mr_iid", "finding_id", "action", "comment", "created_at", "project_id")]
    checked.select(*order).write.mode("append").insertInto(name)


def markdown_table(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]), F.lit(" |")).alias("line"))


PAPER = "id string, title string, year int, n_citation bigint, authors array<string>, venue string"
SORTS = {"citation": ("n_citation",), "year": ("year",)}


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses of a scholarly service, each with a list of papers."""
    fields = PAPER.replace(", ", ",").replace(" ", ":")
    return spark.read.schema(f"data array<struct<{fields}>>").json(path, multiLine=True).select(F.inline("data")).dropDuplicates(["id"])


def search_papers(found: DataFrame, words: str | None = None, author: str | None = None, since: int | None = None, sort: str | None = None, page: int = 0, size: int = 10) -> DataFrame:
    """A page of the papers whose titles hold all words, by an author, from a year on; sorted by citations or year, the most first, ties by id."""
    title = F.lower("title")
    for w in (words or "").lower().split():
        found = found.where(F.contains(title, F.lit(w)))
    if author is not None:
        found = found.where(F.exists("authors", lambda a: F.lower(a) == author.lower()))
    if since is not None:
        found = found.where(F.col("year") >= since)
    order = [F.desc_nulls_last(c) for c in SORTS.get(sort or "", ())]
    return found.orderBy(*order, "id").offset(page * size).limit(size)


STOCK = "ticker string, price double, change_percent double, pe double, fetched_at timestamp"


def fetched(raw: DataFrame, schema: str = STOCK, col: str = "value") -> DataFrame:
    """Answers (text) of a model asked for JSON as rows; text around the outermost braces is left out, answers without any go."""
    body = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    return raw.withColumn("_r", F.from_json(body, schema)).where((body != "") & F.exists(F.map_values(F.from_json(body, "map<string,string>")), lambda v: v.isNotNull())).select(*[c for c in raw.columns if c != col], "_r.*")
