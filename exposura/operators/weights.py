"""Density-ratio weights and diagnostics of any weight column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposura.functions.checks import enforce, is_finite
from exposura.functions.columns import ratio
from exposura.functions.scale import ROWS_PER_TASK, exact_percentiles
from exposura.operators.popularity import checked_weights

PROBABILITY_FLOOR = 1e-5


def density_weights(
    rows: DataFrame, random_prior: float, clip_max: float | None = 10.0, self_normalize: bool = False,
    probability: str = "domain_probability", name: str = "weight",
) -> DataFrame:
    """Add the odds of the randomized domain, corrected for the classifier's class prior.

    weight = q/(1-q) · (1-π)/π with q kept inside [1e-5, 1-1e-5], then optionally clipped and divided
    by the mean over all rows.
    """
    if clip_max is not None and not 0 < clip_max < float("inf"):
        raise ValueError(f"weights can only be clipped at a finite number above zero, not {clip_max}")
    if not 0 < random_prior < 1:
        raise ValueError("random_prior must lie strictly between 0 and 1")
    checked = enforce(rows, is_finite(F.col(probability)), "domain classifier produced non-finite probabilities")
    q = F.greatest(F.least(F.col(probability), F.lit(1 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))
    weight = q / (1 - q) * F.lit((1 - random_prior) / random_prior)
    if clip_max is not None:
        weight = F.least(weight, F.lit(float(clip_max)))
    weighted = checked.withColumn(name, weight)
    if not self_normalize:
        return weighted
    mean = rows.agg(F.avg(weight).alias("mean"))
    return weighted.withColumn(name, F.col(name) / mean.scalar())


def weight_diagnostics(rows: DataFrame, weight: str = "weight", min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """One row: mean, population deviation, max, 1/50/99 % points and effective sample size."""
    w = F.col(weight).cast("double")
    checked = checked_weights(rows, weight)
    moments = checked.agg(
        F.avg(w).alias("weight_mean"), F.stddev_pop(w).alias("weight_std"), F.max(w).alias("weight_max"),
        F.coalesce(ratio(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("effective_sample_size"),
        F.count(F.lit(1)).alias("_rows"),
    )
    nonempty = enforce(moments, F.col("_rows") > 0, "weight diagnostics need at least one row").drop("_rows")
    points = exact_percentiles(checked, weight, {"weight_p01": 1, "weight_p50": 50, "weight_p99": 99}, min_rows=min_rows)
    packed = points.agg(F.first(F.struct("weight_p01", "weight_p50", "weight_p99")).alias("p")).scalar()
    return nonempty.withColumns({name: packed[name] for name in ("weight_p01", "weight_p50", "weight_p99")})


def clip_at_percentiles(
    rows: DataFrame, weight: str = "weight", low: float = 1.0, high: float = 99.0, name: str = "clipped_weight",
    min_rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Clip weights to their own ``low`` and ``high`` percent points."""
    points = exact_percentiles(rows, weight, {"lo": low, "hi": high}, min_rows=min_rows)
    bounds = points.agg(F.first(F.struct("lo", "hi")).alias("b")).scalar()
    return rows.withColumn(name, F.greatest(F.least(F.col(weight), bounds["hi"]), bounds["lo"]))


def weight_histogram(
    rows: DataFrame, weight: str = "weight", bins: int = 50, cap: float = 99.5, min_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Equal-width histogram from the minimum to the ``cap`` percent point; larger weights fall in the last bin.

    Every bin has a row, also one without weights.
    """
    top = exact_percentiles(rows, weight, {"hi": cap}, min_rows=min_rows).select("hi").scalar()
    low = rows.agg(F.min(weight).alias("lo")).scalar()
    value = F.least(F.col(weight), top)
    width = (top - low) / bins
    number = F.least(F.floor(F.coalesce(F.try_divide(value - low, width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = rows.select(number.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return filled.withColumns(
        {"lower_edge": low + width * F.col("bin"), "upper_edge": low + width * (F.col("bin") + 1)}
    )
