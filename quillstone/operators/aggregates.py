"""Grouped statistics, counts and votes. Every one is an aggregation with partial sums before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.lineage import cut, small
from quillstone.operators.dictionary import occurrences
from quillstone.prefix import running

#: Prices of a million tokens by tier, in USD. Fixed values.
PRICES = {"cheap": 0.15, "base": 2.5, "frontier": 15.0, "embedding": 0.02}
ACTIONS = ("accepted", "dismissed", "modified")


def action_counts(feedback: DataFrame, project: object) -> DataFrame:
    """of one project."""
    return feedback.where(F.col("project_id") == F.lit(project)).groupBy("action").agg(F.count("*").alias("n"))


def feedback_stats(feedback: DataFrame, project: object) -> DataFrame:
    """always one row: total, each action's count and the share dismissed, 0 without feedback."""
    f = feedback.where(F.col("project_id") == F.lit(project))
    n = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    out = f.agg(F.count("*").alias("total"), *n)
    return out.withColumn("dismissal_rate", F.when(F.col("total") > 0, F.col("dismissed") / F.col("total")).otherwise(F.lit(0.0)))


def top_dismissed(feedback: DataFrame, project: object, limit: int = 20) -> DataFrame:
    """The findings dismissed most often (pattern, count), ties by pattern."""
    f = feedback.where((F.col("project_id") == F.lit(project)) & (F.col("action") == "dismissed"))
    return f.groupBy(F.col("finding_id").alias("pattern")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "pattern").limit(limit)


def call_cost(tier: Column, tokens: Column, prices: dict[str, float] = PRICES) -> Column:
    out = F.lit(0.0)
    for name, price in prices.items():
        out = F.when(tier == name, tokens / F.lit(1e6) * F.lit(price)).otherwise(out)
    return out


def cost_accounting(calls: DataFrame, by: str = "run_id", tiers: tuple[str, ...] = tuple(PRICES)) -> DataFrame:
    """calls, tokens and cost of each run, and both counts by tier, zero where there are none."""
    per = [x for t in tiers for x in (F.count_if(F.col("tier") == t).alias(f"calls_{t}"), F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("tokens"))), F.lit(0)).alias(f"tokens_{t}"))]
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum(call_cost(F.col("tier"), F.col("tokens"))).alias("cost"), *per)


def status_counts(findings: DataFrame, given: Column | None = None) -> DataFrame:
    """agreed, contested and escalated findings; numbers given (a struct of these) go before counted ones."""
    counts = {"agreed": F.count_if(F.col("status") == "agreed"), "contested": F.count_if(F.col("status") == "disputed"), "escalated": F.count_if("escalate")}
    return findings.agg(*[(F.coalesce(F.max(given[k]), c) if given is not None else c).alias(k) for k, c in counts.items()])


def escalations(findings: DataFrame) -> DataFrame:
    """how many are escalated."""
    return findings.agg(F.count_if("escalate").alias("escalated"))


def group_stats(df: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """mean, sample deviation (0 for one value), least and greatest, rounded."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return df.groupBy(*by).agg(F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("stddev"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"))


def mean_delta(df: DataFrame, config: str, first: str, second: str, value: str) -> DataFrame:
    """the first configuration's mean less the second's, with its sign as text."""
    m = lambda c: F.coalesce(F.avg(F.when(F.col(config) == c, F.col(value))), F.lit(0.0))
    return df.agg(m(first).alias("first_mean"), m(second).alias("second_mean")).withColumn("delta", F.col("first_mean") - F.col("second_mean")).withColumn("shown", F.format_string("%+.2f", "delta"))


def trigger_rates(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """share of runs that triggered, by query, and whether that is as it should be."""
    r = runs.groupBy("query").agg(F.max("should_trigger").alias("should_trigger"), F.count_if("triggered").alias("triggers"), F.count("*").alias("runs")).withColumn("rate", F.col("triggers") / F.col("runs"))
    return r.withColumn("pass", F.when(F.col("should_trigger"), F.col("rate") >= threshold).otherwise(F.col("rate") < threshold))


def confusion(runs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """counts and precision, recall (1 without cases) and accuracy (0 without)."""
    a, p = F.col(actual), F.col(predicted)
    c = runs.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    share = lambda n, d, none: F.when(d > 0, n / d).otherwise(F.lit(none))
    return c.withColumns({
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0),
        "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), 0.0),
    })


def best_row(df: DataFrame, score: str, order: str, by: list[str] | None = None) -> DataFrame:
    """the first row with the greatest score, of all or of each group."""
    keep = [c for c in df.columns if c not in (by or [])]
    return df.groupBy(*(by or [])).agg(F.max_by(F.struct(*keep), F.struct(score, -F.col(order))).alias("_r")).select(*(by or []), "_r.*")


def numeric_aggregate(values: Column, method: str = "sum") -> Column:
    """Over the cells that are numbers; 0 without any."""
    v = values.cast("string").try_cast("double")
    f = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}.get(method, F.sum)
    return F.coalesce(f(v).cast("double"), F.lit(0.0))


def top_mentions(df: DataFrame, key: str, order: str, limit: int = 10) -> DataFrame:
    """F16: the keys mentioned most, nulls left out, ties by first appearance."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("mentions"), F.min(order).alias("first_seen")).orderBy(F.desc("mentions"), "first_seen").limit(limit)


def counts(df: DataFrame, key: str, unknown: str | None = None) -> DataFrame:
    """rows by key; null keys under a name if one is given."""
    k = F.coalesce(F.col(key), F.lit(unknown)) if unknown else F.col(key)
    return df.groupBy(k.alias(key)).agg(F.count("*").alias("n"))


def grouped_lists(df: DataFrame, key: Column, name: str, fields: list[str], order: str, unknown: str) -> DataFrame:
    """the rows of each key as an ordered list."""
    return df.groupBy(F.coalesce(key, F.lit(unknown)).alias(name)).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("events"))


def pattern_outliers(df: DataFrame, by: list[str], pattern: str, least: int = 3, few: int = 2) -> DataFrame:
    """in groups of at least so many rows and several patterns, those of few rows, next to the commonest."""
    n = df.groupBy(*by, pattern).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    top = F.first(pattern).over(w.orderBy(F.desc("n"), pattern))
    return n.select("*", F.sum("n").over(w).alias("total"), F.count("*").over(w).alias("patterns"), F.max("n").over(w).alias("most"), top.alias("dominant")).where((F.col("total") >= least) & (F.col("patterns") > 1) & (F.col("n") <= few) & (F.col("n") < F.col("most"))).select(*by, pattern, "n", "dominant")


def first_seen(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """F21, W-d: the first row of each key (null in the order comes first); combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in df.columns])


def same_keys(by: list[str]) -> Column:
    """Condition of a join with keys under the names _key0, _key1 and so on; null is a key too."""
    return reduce(lambda x, ic: x & F.col(ic[1]).eqNullSafe(F.col(f"_key{ic[0]}")), enumerate(by), F.lit(True))


def upper_medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """of each group's sorted values that in the middle, the upper one of two; null values don't count (null if there are no others).

    Equal values are counted first and their counts summed up in order, so no group is ever held as a whole.
    """
    n = df.groupBy(*by, value).agg(F.count(value).alias("_n"))
    total = small(cut(n.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], F.floor(F.col("_all") / 2).alias("_mid"))))
    places = running(n, by, [value], {"_lo": F.col("_n")}).join(total, same_keys(by))
    middle = (F.col("_lo") <= F.col("_mid")) & (F.col("_mid") < F.col("_lo") + F.col("_n"))
    return places.groupBy(*by).agg(F.max(F.when(middle, F.col(value))).alias(name))


def majority(condition: Column) -> Column:
    """whether it holds for more than half."""
    return F.count_if(condition) > F.count("*") / 2


def keyword_votes(df: DataFrame, id_col: str, text: str, keywords: DataFrame, default: str | None = None) -> DataFrame:
    """the class (class, ord, keyword) with most keywords in a text, first declared among equals; else the default.

    All keywords are looked for in one pass of each text.
    """
    held = occurrences(df, keywords.select(F.col("keyword").alias("term")), id_col, text, whole_words=False)
    hits = held.join(keywords, F.col("term") == F.col("keyword")).groupBy(id_col, "class", "ord").agg(F.count("*").alias("votes"))
    best = hits.groupBy(id_col).agg(F.max_by("class", F.struct("votes", -F.col("ord"))).alias("class"), F.max("votes").alias("votes"))
    return df.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("class", F.lit(default)).alias("class"), F.coalesce("votes", F.lit(0)).alias("votes"))


def oldest(df: DataFrame, order: str, keep: int, key: str | None = None) -> DataFrame:
    """What has to go, oldest first, so that so many stay; null is oldest. Ties are in the order of key; without one, rows that
    tie with the oldest that stays stay too.

    Only the newest are looked for, so many a task; all older ones are told by one comparison.
    """
    at = F.struct(*([order] if key is None else [order, key]))
    if keep <= 0:
        return df.orderBy(at)
    least = df.select(at.alias("_at")).orderBy(F.desc("_at")).limit(keep).agg(F.min("_at").alias("_least"))
    return df.join(F.broadcast(least), at < F.col("_least")).drop("_least").orderBy(at)


#: How many examples a library holds at most, and how many are pruned at once. Fixed values.
MAX_EXAMPLES, PRUNE = 20, 5


def library_check(names: DataFrame, by: list[str], most: int = MAX_EXAMPLES, prune: int = PRUNE) -> DataFrame:
    """of each library its size, by how many it is over the limit, what room is left, and how many to prune."""
    n = names.groupBy(*by).agg(F.count("*").alias("n"))
    over = F.greatest(F.col("n") - most, F.lit(0))
    return n.withColumns({"over": over, "room": F.greatest(most - F.col("n"), F.lit(0)), "prune": F.when(over > 0, prune).otherwise(0)})


def graded_runs(runs: DataFrame) -> DataFrame:
    """correct runs (positives count triggers, negatives the others), and good from 0.8, ok from 0.5, else bad."""
    right = F.when(F.col("should_trigger"), F.col("triggers")).otherwise(F.col("runs") - F.col("triggers"))
    g = runs.groupBy("iteration").agg(F.sum(right).alias("correct"), F.sum("runs").alias("total"))
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    return g.withColumn("grade", F.when(share >= 0.8, "good").when(share >= 0.5, "ok").otherwise("bad"))


def mode_share(df: DataFrame, value: str, limit: float = 0.2) -> DataFrame:
    """the commonest value (null: default), the share of others, and whether that is over the limit."""
    n = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("default")).alias("value")).agg(F.count("*").alias("n"))
    out = n.agg(F.max_by("value", F.struct("n", "value")).alias("dominant"), (1 - F.max("n") / F.sum("n")).alias("others"))
    return out.withColumn("warn", F.col("others") > limit)


#: Error values of cells, and formulas that only work as arrays. Fixed values.
CELL_ERRORS = ("#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A")
IMPLICIT_ARRAYS = (r"(?i)MATCH\s*\(\s*TRUE\s*\(\s*\)", r"(?i)MATCH\s*\(\s*TRUE\s*,", r"(?i)MATCH\s*\([^,]+[<>=!]+[^,]+,")


def audit(cells: DataFrame, by: list[str], errors: int = 50, zeros: int = 30, arrays: int = 20) -> DataFrame:
    """of cells (cell, formula, value) with a formula: how many, errors, zeros and implicit arrays, each with a capped list."""
    f = cells.where(F.col("formula").isNotNull())
    bad, array = F.lit(False), F.lit(False)
    for e in CELL_ERRORS:
        bad = bad | F.contains("value", F.lit(e))
    for p in IMPLICIT_ARRAYS:
        array = array | F.col("formula").rlike(p)
    kinds = {"error": (bad, errors), "zero": (F.col("value").try_cast("double") == 0, zeros), "array": (array, arrays)}
    holds = {name: F.coalesce(c, F.lit(False)) for name, (c, _) in kinds.items()}
    totals = f.groupBy(*by).agg(F.count("*").alias("formulas"), *[F.count_if(c).alias(f"{name}s") for name, c in holds.items()])
    hits = f.where(F.col("cell").isNotNull()).select(*by, "cell", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in holds.items()]))).alias("kind"))
    # each task keeps as many rows a list as the longest has before the shuffle
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("cell"))).where(F.col("_n") <= max(errors, zeros, arrays))
    cells = [F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("_n") <= n), F.col("cell")))).alias(f"{name}_cells") for name, (_, n) in kinds.items()]
    lists = first.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]).agg(*cells)
    out = totals.join(lists, same_keys(by), "left")
    return out.select(*totals.columns, *[F.coalesce(f"{name}_cells", F.array()).alias(f"{name}_cells") for name in kinds])


def sheet_summary(cells: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """Of the cells (sheet, row, col, value, formula) of each sheet its rows, columns, data rows and formulas below the
    header, headers (those given in row 1, by column) and charts, where these (sheet, a row each) are given.

    The header row is at most one value a column.
    """
    below = F.col("row") > 1
    filled = F.coalesce("value", "formula").isNotNull() if "value" in cells.columns else F.lit(True)
    header = F.when((F.col("row") == 1) & F.col("value").isNotNull(), F.struct("col", F.col("value").cast("string").alias("name"))) if "value" in cells.columns else F.lit(None).cast("struct<col:int,name:string>")
    out = cells.groupBy("sheet").agg(
        F.max("row").alias("rows"), F.max("col").alias("cols"), F.count_distinct(F.when(below & filled, F.col("row"))).alias("data_rows"), F.count_if(below & F.col("formula").isNotNull()).alias("formulas"),
        F.transform(F.array_sort(F.collect_list(header)), lambda h: h["name"]).alias("headers"),
    )
    if charts is None:
        return out.withColumn("charts", F.lit(0).cast("long"))
    n = charts.groupBy("sheet").agg(F.count("*").alias("charts"))
    return out.join(n, "sheet", "left").withColumn("charts", F.coalesce("charts", F.lit(0).cast("long")))
