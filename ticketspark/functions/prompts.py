"""Prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt wording. ``{name}`` marks a column, ``{n}`` the number of scenarios.
SYSTEM_PROMPT = "You are simulating a customer contacting e-commerce support."

SCENARIO = """\
Write a single customer support message of 3-5 sentences (75-150 words) with these characteristics:
- Issue area: {issue_area}
- Issue category: {issue_category}
- Sub-category: {issue_sub_category}
- Product: {product_sub_category} ({product_category})
- Customer sentiment: {customer_sentiment}
- Issue complexity: {issue_complexity}

Write only the customer's message. Do not include agent replies, greetings from the agent, or any metadata.
The priority signal (urgency, frustration, complexity) should be clear from the language itself — not stated explicitly."""

BATCH = """\
Given the following {n} customer support scenarios, write one ticket message (3-5 sentences, 75-150 words) for each.
Return a JSON array of exactly {n} strings in the same order. No other text outside the JSON array.

Scenarios:
{numbered_scenarios}"""


def _fill(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` marks replaced by columns, as one ``concat``."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(text), values.get(name, F.col(name))] if text else [values.get(name, F.col(name))]
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def scenario_text() -> Column:
    """F15. The scenario block of one grid row."""
    return _fill(SCENARIO)


def batch_prompt(scenarios: Column) -> Column:
    """F15. One prompt for an ordered array of scenario blocks, numbered from 1."""
    numbered = F.transform(
        scenarios, lambda text, i: F.concat((i + 1).cast("string"), F.lit(". "), text)
    )
    return _fill(BATCH, n=F.size(scenarios).cast("string"), numbered_scenarios=F.array_join(numbered, "\n"))
