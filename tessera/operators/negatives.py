"""Hard negatives: generated candidates that pass, filled up by rules."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import RULES, WordGroups, parse_lines, replacements

MIN_RATIO = 0.5
PER_EXPRESSION = 2


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings (2 * matches / total length); null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """At least ``sequence_ratio``, by built-in functions alone: no matching can take a character more often than both have it."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    both = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * both / total).otherwise(F.when(total == 0, F.lit(1.0)))


def plausible(expr: Column, neg: Column) -> Column:
    """The cheap part of the check: not empty, another text, a length of 0.4 to 2.5 times."""
    n, m = F.length(expr), F.length(neg)
    return (m > 0) & (neg != expr) & (m >= 0.4 * n) & (m <= 2.5 * n)


def valid_negatives(pairs: DataFrame, expr: str = "expr", neg: str = "neg", min_ratio: float = MIN_RATIO) -> DataFrame:
    """Rows whose negative is plausible and similar enough, with ``ratio``.

    Only what is plausible, and whose characters could make up the ratio at all, reaches Python.
    """
    rows = pairs.filter(F.coalesce(plausible(F.col(expr), F.col(neg)), F.lit(False)))
    rows = rows.filter(ratio_bound(F.col(expr), F.col(neg)) >= min_ratio)
    return rows.withColumn("ratio", sequence_ratio(expr, neg)).filter(F.col("ratio") >= min_ratio)


def rule_negatives(expr: Column, rules: WordGroups = RULES, seed: int = 42) -> Column:
    """Array of rule-made negatives in priority order, two tries a strategy, without repeats."""
    made = [replacements(expr, groups, seed) for groups in rules.strategies]
    return F.array_except(F.array_distinct(F.concat(*made)), F.array(expr))


def hard_negatives(rows: DataFrame, raw: str = "raw", expr: str = "expr", k: int = PER_EXPRESSION, rules: WordGroups = RULES, seed: int = 42, keep: tuple[str, ...] = ("image",)) -> DataFrame:
    """keep, expr, hard: up to k negatives, generated lines in order first, then rules; rows with none go.

    ``keep`` and ``expr`` together must tell rows apart.
    """
    keys = [*keep, expr]
    lines = rows.select(*keys, F.posexplode_outer(F.array_distinct(parse_lines(F.col(raw)))).alias("_i", "neg"))
    good = valid_negatives(lines.filter(F.col("neg").isNotNull()), expr, "neg")
    kept = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "neg"))).alias("_c"))  # lines of one answer
    out = rows.select(*keys).distinct().join(kept, keys, "left")
    ours = F.slice(F.transform(F.coalesce("_c", F.expr("cast(array() as array<struct<_i:int,neg:string>>)")), lambda c: c["neg"]), 1, k)
    out = out.withColumn("_llm", ours)
    filled = F.slice(F.concat("_llm", F.array_except(rule_negatives(F.col(expr), rules, seed), F.col("_llm"))), 1, k)
    return out.withColumn("hard", filled).filter(F.size("hard") > 0).select(*keys, "hard")
