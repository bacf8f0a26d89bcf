"""Checks on columns, labels and keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketspark import schemas as S


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """P12. Fails with the names that are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unknown_labels(df: DataFrame, label: str) -> DataFrame:
    """P11, U2. Distinct labels outside the vocabulary."""
    return df.select(F.col(label).alias("label")).where(~F.col("label").isin(S.LABELS)).distinct()


def require_known_labels(df: DataFrame, label: str) -> DataFrame:
    """P11. Fails while the rows are read, naming the label, so no separate pass is needed."""
    message = F.concat(F.lit("unknown priority label: "), F.col(label))
    checked = F.when(F.col(label).isin(S.LABELS), F.col(label)).otherwise(F.raise_error(message).cast("string"))
    return df.withColumn(label, checked)


@dataclass(frozen=True)
class Contract:
    """What one table promises."""

    not_null: Sequence[str] = ()
    domains: Mapping[str, Sequence] = field(default_factory=dict)
    keys: Sequence[Sequence[str]] = ()
    # column -> (other table, other column)
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)


CONTRACTS = {
    "tickets": Contract(
        not_null=["ticket_id", "text", "source", "user_id", "created_at"], keys=[["ticket_id"]]
    ),
    "predictions": Contract(
        not_null=["prediction_id", "ticket_id", "predicted_priority", "confidence", "model_version", "created_at"],
        keys=[["prediction_id"]],
        references={"ticket_id": ("tickets", "ticket_id")},
    ),
    "feedback": Contract(
        not_null=["prediction_id", "verdict"],
        domains={"verdict": S.VERDICTS},
        references={"prediction_id": ("predictions", "prediction_id")},
    ),
    "rate_limit_counters": Contract(
        not_null=["user_id", "window_start", "count"], keys=[["user_id", "window_start"]]
    ),
}


def _value(columns: Sequence[str]) -> Column:
    """A key as text; NULLs in it stay told apart."""
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))


def contract_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract] = CONTRACTS) -> DataFrame:
    """P15. (table_name, rule, violations) for every promise, kept or broken.

    Each table is scanned once. A row tells of its keys, its references and what it breaks, each as (space, value, role):
    a space is one key of one table, or one null or domain rule. Facts of all tables are counted by space and value,
    on the map side first, and that one shuffle answers uniqueness and references alike: a value with several owners
    breaks the key (its surplus rows count), one with referrers and no owner is an orphan.
    """
    facts: dict[str, list[Column]] = {name: [] for name in contracts if name in tables}
    spaces: dict[tuple, int] = {}
    rules: list[tuple[str, str, Column]] = []
    referrers = 0

    def fact(space: int, value: Column, role: int) -> Column:
        return F.struct(F.lit(space).alias("space"), value.alias("value"), F.lit(role).alias("role"))

    def space_of(table: str, columns: Sequence[str]) -> int:
        """The space of a key; its owners are told of when it is first asked for."""
        named = (table, *columns)
        if named not in spaces:
            spaces[named] = len(spaces)
            facts.setdefault(table, []).append(fact(spaces[named], _value(columns), 0))
        return spaces[named]

    def counted(where: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, what)), F.lit(0)).cast("long")

    for name, contract in contracts.items():
        if name not in tables:
            continue
        broken = {f"not_null({c})": F.col(c).isNull() for c in contract.not_null}
        broken |= {f"domain({c})": ~F.col(c).isin(list(allowed)) for c, allowed in contract.domains.items()}
        for rule, bad in broken.items():
            spaces[name, rule, None] = space = len(spaces)
            facts[name].append(F.when(bad, fact(space, F.lit(None).cast("string"), 0)))
            rules.append((name, rule, counted(F.col("space") == space, F.col("role0"))))
        for key in contract.keys:
            surplus = (F.col("space") == space_of(name, key)) & (F.col("role0") > 1)
            rules.append((name, f"unique({','.join(key)})", counted(surplus, F.col("role0") - 1)))
        for column, (other, target) in contract.references.items():
            rule = f"reference({column}->{other})"
            if other not in tables:
                # Not checkable: the other table is not at hand.
                rules.append((name, rule, F.lit(None).cast("long")))
                continue
            referrers += 1
            space = space_of(other, [target])
            facts[name].append(F.when(F.col(column).isNotNull(), fact(space, _value([column]), referrers)))
            orphan = (F.col("space") == space) & (F.col("role0") == 0)
            rules.append((name, rule, counted(orphan, F.col(f"role{referrers}"))))

    told = None
    for name, parts in facts.items():
        if parts:
            rows = tables[name].select(F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))
            told = rows if told is None else told.unionByName(rows)
    roles = [F.count_if(F.col("role") == role).alias(f"role{role}") for role in range(referrers + 1)]
    totals = told.groupBy("space", "value").agg(*roles).agg(*[rule.alias(f"r{i}") for i, (_, _, rule) in enumerate(rules)])
    rows = F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, (name, rule, _) in enumerate(rules)
    ])
    return totals.select(F.inline(rows))
