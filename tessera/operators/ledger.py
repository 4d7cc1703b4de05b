"""Costs and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: US dollars a token, and by model a thousand tokens; the flat cost of an unknown model.
INPUT_COST, OUTPUT_COST, EMBEDDING_COST, UNKNOWN_COST = 0.000005, 0.000015, 0.02 / 1_000_000, 0.0001
MODEL_COSTS = {"gpt-3.5-turbo": 0.002, "gpt-4": 0.03, "gpt-4-32k": 0.06, "gpt-4o": 0.00001, "gpt-4o-mini": 0.000001, "o3-mini": 0.0000005}


def approximate_tokens(text: Column) -> Column:
    """A built-in stand-in for a tokenizer: words and signs, long words in pieces of six."""
    return F.regexp_count(text, F.lit(r"(?U)\w{1,6}|[^\w\s]"))


def llm_cost(prompt: Column, answer: Column, count: Callable[[Column], Column] = approximate_tokens) -> Column:
    """F35, with any token counter."""
    return count(prompt) * INPUT_COST + count(answer) * OUTPUT_COST


def embedding_cost(text: Column, count: Callable[[Column], Column] = approximate_tokens) -> Column:
    return count(text) * EMBEDDING_COST


def model_cost(prompt_tokens: Column, answer_tokens: Column, model: Column) -> Column:
    """F36."""
    price = F.create_map(*[x for m, c in MODEL_COSTS.items() for x in (F.lit(m), F.lit(c))])[F.lower(model)]
    return F.coalesce((prompt_tokens + answer_tokens) / 1000 * price, F.lit(UNKNOWN_COST))


def with_commas(n: Column) -> Column:
    """a count with commas."""
    return F.format_number(n, 0)


def step_costs(costs: DataFrame, step: str = "step", cost: str = "cost") -> DataFrame:
    """A4: by step and, with a null step, in all; one pass."""
    return costs.rollup(step).agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))
