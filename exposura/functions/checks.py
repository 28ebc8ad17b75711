"""Input contracts.

Row rules are enforced inside the plan (one pass, nothing collected): the offending row raises when it
is read. Rules about a whole table are one aggregate whose single row is looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns {missing}")
    return df


def enforce(df: DataFrame, valid: Column, message: str) -> DataFrame:
    """Keep every row, but raise ``message`` on the first row that is not ``valid`` (null = invalid).

    The row number in the message makes the condition non-deterministic on purpose: the optimizer then
    leaves it where it stands. Merged with a caller's filter it could be evaluated first, on rows that
    filter drops, with the filter's constants already substituted.
    """
    row = F.monotonically_increasing_id().cast("string")
    failure = F.raise_error(F.concat(F.lit(f"{message} (row "), row, F.lit(")"))).cast("boolean")
    return df.where(F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(failure))


def standard_only(df: DataFrame, what: str) -> DataFrame:
    """Training guard: randomized-policy rows are evaluation data."""
    return enforce(df, F.col("is_random") == 0, f"{what} may be fitted on standard logs only")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.count_if(F.col("copies") > 1).alias("duplicate_keys"))
    )


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Join contract: the right side of a many-to-one join has one row per key."""
    if duplicate_count(df, keys).first()["duplicate_keys"]:
        raise ValueError(f"{what} has more than one row for some {keys}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def is_finite(column: Column) -> Column:
    """False for NaN and both infinities, null for null."""
    infinity = float("inf")
    return ~F.isnan(column) & (column != infinity) & (column != -infinity)
