"""Pivot tables, scores and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.aggregates import numeric_aggregate

#: Points of a rumor by its type (others: 1) and the words of urgent ones. Fixed values.
TYPE_POINTS = {"ma": 5, "insider": 4, "analyst": 3, "regulatory": 3, "earnings": 2}
URGENT, ENGAGED = r"(?i)breaking|just in|alert|urgent", 2
#: Bounds of payout ratios in percent. Fixed values.
PAYOUT = ((40, "safe"), (60, "moderate"), (80, "high"))
#: Verdicts that count as buying, watching and selling. Fixed values.
VERDICTS = {"buy": ("买入", "强烈买入"), "watch": ("观望",), "sell": ("卖出",)}


def text_key(c: Column) -> Column:
    """A row key as text, null as None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def is_number(c: Column) -> Column:
    return c.cast("string").try_cast("double").isNotNull()


def flat_pivot(df: DataFrame, rows: list[str], values: list[tuple[str, str]], digits: int = 2) -> DataFrame:
    """Groups by rows with (field, method) aggregates of cells that are numbers, rounded; groups without a number in any field are left out."""
    some = is_number(F.col(values[0][0]))
    for f, _ in values[1:]:
        some = some | is_number(F.col(f))
    aggs = [F.round(numeric_aggregate(F.col(f), m), digits).alias(f"{f}_{m}") for f, m in values]
    return df.groupBy(*[text_key(F.col(r)).alias(r) for r in rows]).agg(F.count_if(some).alias("_some"), *aggs).where("_some > 0").drop("_some")


def cross_tab(df: DataFrame, rows: list[str], col: str, value: str, method: str = "sum", columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """A column for each value of a field in the order of their text, 0 where there is nothing. Without given columns they are read first."""
    keyed = df.select(*[text_key(F.col(r)).alias(r) for r in rows], text_key(F.col(col)).alias("_c"), value)
    names = columns if columns is not None else sorted(r["_c"] for r in keyed.select("_c").distinct().collect())
    out = keyed.groupBy(*rows).pivot("_c", names).agg(F.round(numeric_aggregate(F.col(value), method), digits))
    return out.fillna(0.0, names)


def payout_status(ratio: Column) -> Column:
    """By the share of earnings paid out; null: unknown."""
    out = F.lit("unsustainable")
    for bound, name in reversed(PAYOUT):
        out = F.when(ratio < bound, name).otherwise(out)
    return F.when(ratio.isNull(), F.lit("unknown")).otherwise(out)


def payout_ratio(dividend: Column, eps: Column) -> Column:
    """In percent with one decimal, only for positive earnings."""
    return F.when(eps > 0, F.round(dividend / eps * 100, 1))


def safety(payout: Column, growth: Column, years: Column, yield_: Column) -> dict[str, Column]:
    """Score 0 to 100, the factors behind it, and a rating. A null figure moves nothing."""
    rules = [
        (payout < 40, 20, "payout healthy"), ((payout >= 40) & (payout < 60), 10, "payout moderate"), ((payout >= 60) & (payout < 80), -10, "payout high"), (payout >= 80, -20, "payout unsustainable"),
        (growth > 10, 15, "growth strong"), ((growth > 5) & (growth <= 10), 10, "growth good"), ((growth > 0) & (growth <= 5), 5, "growth small"), (growth <= 0, -15, "shrinking"),
        (years >= 25, 15, "aristocrat"), ((years >= 10) & (years < 25), 10, "long stable"), ((years >= 5) & (years < 10), 5, "stable"),
        (yield_ > 8, -10, "yield very high"), (yield_ < 1, 0, "yield low"),
    ]
    total = F.lit(50)
    for c, points, _ in rules:
        total = total + F.when(c, points).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    rating = F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("poor")
    return {"score": score, "factors": F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in rules])), "rating": rating}


def impact_score(kind: Column, text: Column, engaged: Column) -> Column:
    """1, points of the type, 2 for urgent words, 2 for engagement; at most 10."""
    points = F.lit(1)
    for name, p in TYPE_POINTS.items():
        points = F.when(kind == name, p).otherwise(points)
    extra = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return F.least(F.lit(10), 1 + points + extra(text.rlike(URGENT), 2) + extra(engaged, ENGAGED))


def alerts(watch: DataFrame) -> DataFrame:
    """Up to three rows for an item: target reached, stop reached, signal changed; a price of 0 or null is not set."""
    p, set_ = F.col("current_price"), lambda c: F.col(c) != 0
    kinds = F.array_compact(F.array(
        F.when(set_("target_price") & (p >= F.col("target_price")), F.lit("target_hit")), F.when(set_("stop_price") & (p <= F.col("stop_price")), F.lit("stop_hit")),
        F.when(p.isNotNull() & F.col("alert_on_signal") & F.col("current_signal").isNotNull() & F.col("last_signal").isNotNull() & (F.col("current_signal") != F.col("last_signal")), F.lit("signal_change")),
    ))
    return watch.select("ticker", "current_price", F.explode(kinds).alias("alert"))


def watch_metrics(watch: DataFrame) -> DataFrame:
    """Change since added, way to target and stop in percent, 2 decimals; null where a price is missing or 0."""
    pct = lambda a, b: F.when((F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0), F.round((a - b) / b * 100, 2))
    c = F.col("current_price")
    return watch.select("ticker", pct(c, F.col("price_at_add")).alias("change_pct"), pct(F.col("target_price"), c).alias("to_target_pct"), pct(F.col("stop_price"), c).alias("to_stop_pct"))


def partial_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values over old ones, column by column; null in a new row keeps what there was."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    return o.join(n, key, "full").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in cols])


def remove(old: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not among those gone."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def validate_prices(stocks: DataFrame) -> DataFrame:
    """What is missing or extreme about each row; 0 counts as missing; an error is the only warning of its row."""
    falsy = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    w = F.array_compact(F.array(
        F.when(falsy("price"), F.lit("price missing")), F.when(falsy("ma5") & falsy("ma20"), F.lit("moving averages missing")),
        F.when(F.coalesce("overbought_warning", F.lit(False)), F.lit("overbought")), F.when(falsy("roe") & falsy("pe_ttm"), F.lit("fundamentals missing")),
    ))
    failed = F.coalesce("error", F.lit("")) != ""
    return stocks.withColumns({"warnings": F.when(failed, F.array(F.concat(F.lit("fetch failed: "), "error"))).otherwise(w), "valid": ~failed & ~falsy("price")})


def verdict_buckets(df: DataFrame, verdict: str = "verdict", names: dict[str, tuple[str, ...]] = VERDICTS) -> DataFrame:
    """How many to buy, watch and sell."""
    return df.agg(*[F.count_if(F.col(verdict).isin(*v)).alias(k) for k, v in names.items()])
