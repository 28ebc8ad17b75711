"""Named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from exposura.plans.views import PRELUDE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6
# Added before rounding, so that values exactly halfway do not hang on the last bit of a sum.
NUDGE = "1e-9"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, with no negative zero, so that two engines print the same value."""
    def clean(field: T.StructField):
        if not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.col(field.name)
        value = F.round(F.col(field.name).cast("double") + float(NUDGE), DECIMALS)
        return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(field.name)

    return df.select(*[clean(field) for field in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use every view of the prelude.

    ``R6(x)`` in the text is replaced by rounding to six decimals without negative zero.
    """
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, folder: rounded(function(spark, folder))
        if sql is not None:
            # the greedy rerank is a recursive table expression, which DuckDB asks to be announced up front
            start = PRELUDE.strip().replace("with ", "with recursive ", 1)
            ORACLES[name] = _expand(f"{start}\n{sql}")
        return function

    return register


def _expand(text: str) -> str:
    """Replace R6(expression) by its rounded form, innermost first."""
    while "R6(" in text:
        start = text.rindex("R6(")
        depth, end = 1, start + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[start + 3:end - 1]
        value = f"round(({inner}) + {NUDGE}::double, {DECIMALS})"
        text = text[:start] + f"(case when {value} = 0 then 0.0 else {value} end)" + text[end:]
    return text
