"""Language models as pluggable functions: tiers, a running budget, retries, and an offline stand-in."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.lineage import cut
from quillstone.operators.aggregates import PRICES
from quillstone.operators.windows import budget_gate


class ModelFn(Protocol):
    """Answers a prompt of a tier with a text."""

    def __call__(self, tier: str, system: str, prompt: str) -> str: ...


class BudgetExceeded(RuntimeError):
    """A further call would be over a limit; not worth another attempt."""


class Transient(RuntimeError):
    """A failure that may pass: too many requests, a server's error, the network."""


@dataclass
class Budget:
    """W-e, F4: calls, tokens and cost of one run; check() before a call, record() after it."""

    max_calls: int = 25
    max_cost: float = 0.5
    calls: dict[str, int] = field(default_factory=dict)
    tokens: dict[str, int] = field(default_factory=dict)

    @property
    def cost(self) -> float:
        return sum(n / 1e6 * PRICES.get(t, 0.0) for t, n in self.tokens.items())

    def check(self) -> None:
        if sum(self.calls.values()) >= self.max_calls:
            raise BudgetExceeded(f"{self.max_calls} calls")
        if self.cost >= self.max_cost:
            raise BudgetExceeded(f"{self.max_cost} USD")

    def record(self, tier: str, tokens: int) -> None:
        self.calls[tier] = self.calls.get(tier, 0) + 1
        self.tokens[tier] = self.tokens.get(tier, 0) + tokens

    def reset(self) -> None:
        self.calls.clear()
        self.tokens.clear()


def retried(fn: ModelFn, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> ModelFn:
    """L1: fn, tried again after 1 s, 2 s while its failure may pass."""

    def call(tier: str, system: str, prompt: str) -> str:
        for n in range(1, attempts + 1):
            try:
                return fn(tier, system, prompt)
            except Transient:
                if n == attempts:
                    raise
                wait(float(n))
        raise ValueError("no attempt")

    return call


def tokens_of(*texts: str) -> int:
    """About how many tokens texts are together."""
    return -(-sum(map(len, texts)) // 4)


def with_budget(fn: ModelFn, budget: Budget, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> ModelFn:
    """L1: fn under a budget, tried again after 1 s, 2 s while its failure may pass."""
    again = retried(fn, attempts, wait)

    def call(tier: str, system: str, prompt: str) -> str:
        budget.check()
        out = again(tier, system, prompt)
        budget.record(tier, tokens_of(system, prompt, out))
        return out

    return call


def stub(tier: str, system: str, prompt: str) -> str:
    """An offline answer that depends on the prompt alone: a finding for every added line with a TODO."""
    found = [line[1:].strip() for line in prompt.split("\n") if line.startswith("+") and "TODO" in line]
    digest = hashlib.md5(f"{tier}|{system}".encode()).hexdigest()[:4]
    return json.dumps({"findings": [{"issue": f, "location": f"line:{i}", "risk": f, "propagation": f"line:{i}", "deviation": f, "evidence": f"line:{i}", "confidence": 0.9, "emotion": "certain", "by": digest} for i, f in enumerate(found)]})


def ask(rows: DataFrame, fn: ModelFn, tier: str, system: str, prompt: str = "prompt", budget: Budget | None = None, order: tuple[str, ...] = (), reserve: int = 1000, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """L1, L2: rows with answer, the model's text for their prompt, materialised, so that no call is paid twice.

    Under a budget, rows are taken in the given order (columns that tell rows apart; nulls first). A row is asked while calls and cost so far are
    below their limits, both by what the answers really took and with reserve tokens set aside for each; the others have a
    null answer. These rows, at most max_calls whatever the table's size, are asked one after the other in one task, as each call depends on what
    the ones before it took. What was used is recorded on the budget. fn runs on the executors and is tried again while its
    failure may pass. answers.AnswerStore keeps answers over runs.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", answer string"
    again = retried(fn, wait=wait)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(answer=[again(tier, system, t or "") for t in p[prompt]])

    if budget is None:
        return cut(rows.mapInPandas(run, kinds))
    if not order:
        raise ValueError("a budget needs an order of the rows")
    spent = F.ceil((len(system) + F.length(F.coalesce(prompt, F.lit("")))) / 4) + reserve
    first = rows.orderBy(*order).limit(max(0, budget.max_calls - sum(budget.calls.values())))
    left = max(0.0, budget.max_cost - budget.cost)
    price = PRICES.get(tier, 0.0) / 1e6
    admitted = budget_gate(first.withColumns({"_run": F.lit(0), "tier": F.lit(tier), "tokens": spent}).select("_run", "tier", "tokens", *order), "_run", list(order), budget.max_calls, left)
    admitted = F.broadcast(admitted.where("admitted").select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(order)]))  # max_calls rows at most
    same = reduce(lambda a, ic: a & F.col(ic[1]).eqNullSafe(F.col(f"_of_{ic[0]}")), enumerate(order), F.lit(True))

    def run_within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost = 0.0
        for p in parts:
            out = []
            for t in p[prompt]:
                if cost >= left:
                    out.append(None)
                    continue
                out.append(again(tier, system, t or ""))
                cost += tokens_of(system, t or "", out[-1]) * price
            yield p.assign(answer=out)

    asked = cut(rows.join(admitted, same, "left_semi").coalesce(1).sortWithinPartitions(*order).mapInPandas(run_within, kinds))
    used = asked.where("answer is not null").agg(F.count("*"), F.coalesce(F.sum(F.ceil((len(system) + F.length(F.coalesce(prompt, F.lit(""))) + F.length("answer")) / 4)), F.lit(0))).first()
    if used[0]:
        budget.calls[tier] = budget.calls.get(tier, 0) + used[0]
        budget.tokens[tier] = budget.tokens.get(tier, 0) + used[1]
    rest = rows.join(admitted, same, "left_anti").withColumn("answer", F.lit(None).cast("string"))
    return asked.unionByName(rest)
