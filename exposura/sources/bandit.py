"""Bandit feedback: one row per round, checked while it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposura.functions.checks import enforce, is_finite, require_columns

REQUIRED = ("context", "action", "reward", "pscore")


def _rules(n_actions: int) -> dict[str, Column]:
    """Violations by name, as row conditions."""
    finite = lambda column: F.coalesce(is_finite(column.cast("double")), F.lit(False))
    pscore, action = F.col("pscore"), F.col("action")
    return {
        "action_out_of_range": ~F.coalesce((action >= 0) & (action < n_actions), F.lit(False)),
        "context_not_finite": ~F.coalesce(F.forall("context", finite), F.lit(False)),
        "reward_not_finite": ~finite(F.col("reward")),
        "pscore_invalid": ~(finite(pscore) & (pscore > 0) & (pscore <= 1)),
    }


def bandit_audit(rounds: DataFrame, n_actions: int) -> DataFrame:
    """One row: rounds, violations per rule, context width, and ``valid``."""
    require_columns(rounds, REQUIRED, "bandit feedback")
    if n_actions < 1:
        raise ValueError("bandit feedback needs at least one action")
    rules = _rules(n_actions)
    counted = rounds.agg(
        F.count(F.lit(1)).alias("rounds"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
        F.min(F.size("context")).alias("min_context"), F.max(F.size("context")).alias("max_context"),
    )
    valid = (F.col("rounds") > 0) & F.coalesce(F.col("min_context") == F.col("max_context"), F.lit(False))
    for name in rules:
        valid = valid & (F.col(name) == 0)
    return counted.withColumn("valid", valid)


def checked_bandit(rounds: DataFrame, n_actions: int) -> DataFrame:
    """The rounds themselves; a row that breaks a rule, or whose context is wider than another's, raises when it is read."""
    require_columns(rounds, REQUIRED, "bandit feedback")
    narrowest = rounds.agg(F.min(F.size("context")).alias("n")).scalar()
    result = enforce(rounds, F.size("context") == narrowest, "bandit feedback: contexts of more than one width")
    for name, violated in _rules(n_actions).items():
        result = enforce(result, ~violated, f"bandit feedback: {name}")
    return result


def behavior_and_truth(log: DataFrame, behavior_policy: str, truth_policy: str = "random") -> tuple[DataFrame, DataFrame]:
    """The propensity log of one policy and the disjoint on-policy log, from one table with ``policy``."""
    return log.where(F.col("policy") == behavior_policy), log.where(F.col("policy") == truth_policy)
