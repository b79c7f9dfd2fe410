"""The extraction ledger: a pending queue, budget-gated calls to a provider, and append-only runs."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PENDING, RUNS, STATUSES
from .ranges import running_sum

#: USD a million tokens, input and output, by model; others; characters a token; output tokens expected (fixed values).
PRICES = {
    "claude-haiku-4.5": (1.0, 5.0),
    "claude-haiku-3.5": (0.8, 4.0),
    "claude-sonnet-4.5": (3.0, 15.0),
    "claude-opus-4.5": (15.0, 75.0),
    "gpt-4-mini": (0.15, 0.6),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4o": (2.5, 10.0),
}
OTHER_PRICE, CHARS_A_TOKEN, EXPECTED_OUTPUT, PROMPT_VERSION, BUDGET = (3.0, 15.0), 3.0, 512, "1.0.0", 1.0


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_A_TOKEN)).cast("long")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")


def with_cost(runs: DataFrame, tokens_in: str = "tokens_input", tokens_out: str = "tokens_output") -> DataFrame:
    """runs with cost_usd by model."""
    df = runs.join(F.broadcast(prices(runs.sparkSession)), "model", "left")
    price = lambda c, i: F.coalesce(c, F.lit(OTHER_PRICE[i]))
    cost = F.col(tokens_in) / 1e6 * price("price_in", 0) + F.col(tokens_out) / 1e6 * price("price_out", 1)
    return df.withColumn("cost_usd", cost).drop("price_in", "price_out")


def cost_of(model: str, tokens_in: int, tokens_out: int) -> float:
    a, b = PRICES.get(model, OTHER_PRICE)
    return tokens_in / 1e6 * a + tokens_out / 1e6 * b


def render(template: Column, content: Column) -> Column:
    return F.replace(template, F.lit("{content}"), content)


def provider_of(model: str) -> str:
    return os.environ.get("PALIMPSEST_EXTRACT_PROVIDER") or ("anthropic" if model.startswith("claude-") else "openai")


def status_or_failed(c: Column) -> Column:
    return F.when(c.isin(*STATUSES["extraction_runs"]), c).otherwise("failed")


def within_budget(pending: DataFrame, budget: float, cost: str = "cost_usd") -> DataFrame:
    """The longest prefix of the queue, by enqueued_at and uid, whose expected costs fit the budget.

    Running sums are built by ranges of the queue, so only one row a range meets in a single task.
    """
    return running_sum(pending, ["enqueued_at", "drawer_uid"], F.col(cost), "spent_usd").where(F.col("spent_usd") <= budget)


def enqueue(pending: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new rows; a drawer that waits already keeps its first place."""
    return pending.unionByName(new.dropDuplicates(["drawer_uid"]).join(pending, "drawer_uid", "left_anti").select(*pending.columns))


def next_pending(pending: DataFrame, limit: int) -> DataFrame:
    return pending.orderBy("enqueued_at", "drawer_uid").limit(max(1, limit))


def run_status(runs: DataFrame) -> DataFrame:
    """By drawer: its latest run, how many there are, and what they cost."""
    return runs.groupBy("drawer_uid").agg(
        F.max_by(F.struct("id", "status", "model", "prompt_version", "started_at"), F.struct("started_at", "id")).alias("latest"),
        F.count("*").alias("run_count"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    ).select("drawer_uid", "latest.*", "run_count", "total_cost_usd")


def parse_response(text: str | None) -> tuple[list, bool]:
    """(entities, partial) of a model's answer: JSON, alone, fenced, or the first object or array within prose.

    No answer gives nothing; an answer of another shape gives nothing, and counts as partial.
    """
    text = (text or "").strip()
    if not text:
        return [], False
    if text.startswith("```"):
        text = text.partition("\n")[2] if "\n" in text else text
        text = text.removesuffix("```").strip()
    if text[:1] not in ("{", "["):
        begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=None)
        if begin is not None:
            text = _balanced(text[begin:]) or text
    try:
        value = json.loads(text)
    except ValueError:
        return [], True
    value = value.get("entities", []) if isinstance(value, dict) else value
    return (value, False) if isinstance(value, list) else ([], True)


def _balanced(text: str) -> str:
    opener, closer, depth = text[0], {"{": "}", "[": "]"}[text[0]], 0
    for i, c in enumerate(text):
        depth += (c == opener) - (c == closer)
        if not depth:
            return text[: i + 1]
    return ""


def parsed(answers: Column) -> Column:
    """A struct of entities, as JSON text, and partial for each answer."""

    @F.pandas_udf("entities string, partial boolean")
    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [parse_response(t) for t in texts]
        return pd.DataFrame({"entities": [json.dumps(e) for e, _ in found], "partial": [p for _, p in found]})

    return parse(answers)


@dataclass(frozen=True)
class Answer:
    text: str
    tokens_input: int
    tokens_output: int


class Provider(Protocol):
    def complete(self, prompt: str) -> Answer: ...


@dataclass
class Runner:
    """Runs the queue in order through a provider. What each call costs decides whether the next may start, so calls are
    sequential by definition; the tables around them are DataFrames."""

    spark: SparkSession
    model: str
    provider: Provider
    budget_usd: float = BUDGET
    prompt_version: str = PROMPT_VERSION
    clock: Callable[[], float] = time.time
    spent_usd: float = 0.0
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.budget_usd < 0 or not self.model or not self.prompt_version:
            raise ValueError("a runner needs a model, a prompt version and a budget of 0 or more")

    def run_one(self, uid: str, prompt: str, version: str | None = None) -> dict:
        started, tokens, cost, entities, error = int(self.clock()), (0, 0), 0.0, [], None
        expected = cost_of(self.model, max(1, int(len(prompt) / CHARS_A_TOKEN)), EXPECTED_OUTPUT)
        if self.spent_usd + expected > self.budget_usd:
            status, error = "budget_exhausted", f"expected cost {expected:.4f} on top of {self.spent_usd:.4f} exceeds {self.budget_usd:.2f} USD"
        else:
            try:
                answer = self.provider.complete(prompt)
            except Exception as e:  # noqa: BLE001  any provider may fail; the ledger says how
                status, error = "failed", f"{type(e).__name__}: {e}"
            else:
                tokens = (answer.tokens_input, answer.tokens_output)
                cost = cost_of(self.model, *tokens)
                self.spent_usd += cost
                entities, partial = parse_response(answer.text)
                status = "partial" if partial else "success"
        self.rows.append((len(self.rows) + 1, uid, started, int(self.clock()), status, self.model, version or self.prompt_version, *tokens, cost, json.dumps(entities), error))
        return {"drawer_uid": uid, "status": status, "cost_usd": cost, "entities": entities, "error_message": error}

    def run_drawer(self, uid: str, drawers: DataFrame, pending: DataFrame, template: str = "{content}", version: str | None = None) -> dict:
        """The result of one drawer, with the template and version it waits with, if it waits; LookupError for an unknown uid."""
        work = drawers.where(F.col("drawer_uid") == uid).select("drawer_uid", "content").limit(1).join(pending, "drawer_uid", "left")
        row = work.select(render(F.coalesce("prompt_template", F.lit(template)), F.col("content")).alias("prompt"), "prompt_version").first()
        if row is None:
            raise LookupError(f"no drawer {uid!r}")
        return self.run_one(uid, row["prompt"], row["prompt_version"] or version)

    def run_pending(self, pending: DataFrame, drawers: DataFrame, template: str = "{content}", batch: int = 10) -> tuple[list[dict], DataFrame]:
        """Results of up to `batch` drawers, stopping where the budget ends, and the queue that is left."""
        work = next_pending(pending, batch).join(drawers.select("drawer_uid", "content"), "drawer_uid")
        work = work.withColumn("prompt", render(F.coalesce("prompt_template", F.lit(template)), F.col("content"))).orderBy("enqueued_at", "drawer_uid")
        out: list[dict] = []
        for row in work.select("drawer_uid", "prompt", "prompt_version").toLocalIterator():
            out.append(self.run_one(row["drawer_uid"], row["prompt"], row["prompt_version"]))
            if out[-1]["status"] == "budget_exhausted":
                break
        done = [(r["drawer_uid"],) for r in out if r["status"] in ("success", "partial")]
        return out, pending.join(self.spark.createDataFrame(done, "drawer_uid string"), "drawer_uid", "left_anti").select(*PENDING.names)

    def runs(self, begin: int = 0) -> DataFrame:
        """The runs so far, from the one with this place on, numbered from 1."""
        return self.spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(self.rows[begin:], 1)], RUNS)
