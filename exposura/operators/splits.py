"""Calendar splits. The integer ``date`` column decides, never the millisecond clock."""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from exposura.functions.checks import enforce, require_columns
from exposura.functions.scale import values_at
from exposura.session import stored_once

SPLITS = ("train", "validation", "standard_test", "randomized_test")


@dataclass(frozen=True)
class SplitBounds:
    """Inclusive ``yyyymmdd`` bounds."""

    train_end: int
    validation: tuple[int, int]
    standard_test: tuple[int, int]
    randomized_test: tuple[int, int]
    adaptation_end: int
    holdout_start: int


def assign_splits(log: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Add ``split``; a row that no range covers is an error. Where ranges overlap the later one wins."""
    require_columns(log, ["date", "is_random"], "interaction log")
    standard, random, date = F.col("is_random") == 0, F.col("is_random") == 1, F.col("date")
    split = (
        F.when(random & date.between(*bounds.randomized_test), "randomized_test")
        .when(standard & date.between(*bounds.standard_test), "standard_test")
        .when(standard & date.between(*bounds.validation), "validation")
        .when(standard & (date <= bounds.train_end), "train")
    )
    return enforce(
        log.withColumn("split", split), F.col("split").isNotNull(), "some interactions lie outside all split bounds"
    )


def stored_splits(raw: DataFrame, bounds: SplitBounds, made_of: Hashable) -> DataFrame:
    """``assign_splits`` of a raw log, checked and written once as a table with one folder for each split.

    A row outside all bounds raises while the table is written. Whoever reads one split afterwards lists and scans the files
    of that split only, static filters and those found by a join alike, and its filters are pushed to the scan:
    the row rule of ``assign_splits`` is no longer in the plan. ``made_of`` names the input and its state; see ``stored_once``.
    """
    return stored_once(raw.sparkSession, (made_of, bounds), lambda: assign_splits(raw, bounds), ["split"])


def validate_splits(log: DataFrame) -> DataFrame:
    """One row with the evidence for each rule and ``valid``. Call :func:`require_valid_splits` to raise."""
    split, random = F.col("split"), F.col("is_random")
    report = log.agg(
        F.count_if((split == "train") & (random == 1)).alias("random_rows_in_train"),
        F.count_if((split == "randomized_test") & (random == 0)).alias("standard_rows_in_randomized"),
        F.max(F.when(split == "train", F.col("date"))).alias("train_max_date"),
        F.min(F.when(split.isin("validation", "standard_test"), F.col("date"))).alias("later_standard_min_date"),
        F.count_distinct(split).alias("splits_present"),
        F.count_if(~F.coalesce(split, F.lit("")).isin(*SPLITS)).alias("unknown_split_rows"),
    )
    no_overlap = F.coalesce(F.col("train_max_date") < F.col("later_standard_min_date"), F.lit(True))
    return report.withColumn(
        "valid",
        (F.col("random_rows_in_train") == 0)
        & (F.col("standard_rows_in_randomized") == 0)
        & no_overlap
        & (F.col("splits_present") == len(SPLITS))
        & (F.col("unknown_split_rows") == 0),
    )


def require_valid_splits(log: DataFrame) -> DataFrame:
    row = validate_splits(log).first()
    if not row["valid"]:
        raise ValueError(f"splits break the temporal contract: {row.asDict()}")
    return log


def random_domain_slices(log: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Randomized rows with ``domain_slice`` adaptation / holdout; rows between the two are left out."""
    if bounds.adaptation_end >= bounds.holdout_start:
        raise ValueError("adaptation and holdout dates overlap")
    date = F.col("date")
    named = F.when(date <= bounds.adaptation_end, "adaptation").when(date >= bounds.holdout_start, "holdout")
    return (
        log.where(F.col("split") == "randomized_test")
        .withColumn("domain_slice", named)
        .where(F.col("domain_slice").isNotNull())
    )


def require_domain_slices(sliced: DataFrame) -> DataFrame:
    """The rows of ``random_domain_slices``; a slice without any row raises, since nothing could be fitted or measured on it."""
    found = {row["domain_slice"] for row in sliced.select("domain_slice").distinct().collect()}  # two names at most
    if missing := sorted({"adaptation", "holdout"} - found):
        raise ValueError(f"no randomized rows in the slices {missing}")
    return sliced


def temporal_cutoff(train: DataFrame, holdout_fraction: float) -> DataFrame:
    """One row ``cutoff_ms``: the last timestamp of the earlier share of the distinct timestamps."""
    if not 0 < holdout_fraction < 1:
        raise ValueError("holdout_fraction must lie strictly between 0 and 1")
    kept = F.least(F.greatest(F.floor(F.col("_n") * F.lit(1 - holdout_fraction)), F.lit(1)), F.col("_n") - 1)
    stats = values_at(train.select("timestamp_ms").distinct(), "timestamp_ms", {"cutoff_ms": kept - 1})
    return enforce(stats, F.col("_n") >= 2, "a temporal slice needs at least two timestamps").select("cutoff_ms")


def temporal_slice(train: DataFrame, holdout_fraction: float = 0.2) -> DataFrame:
    """Add ``ranker_slice``: source up to the cutoff, ranker strictly after it."""
    cutoff = temporal_cutoff(train, holdout_fraction).scalar()
    return train.withColumn("ranker_slice", F.when(F.col("timestamp_ms") <= cutoff, "source").otherwise("ranker"))


def split_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.min("timestamp_ms").alias("min_timestamp_ms"),
        F.max("timestamp_ms").alias("max_timestamp_ms"),
    )
