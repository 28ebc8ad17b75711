"""Bootstrap intervals whose draws are keyed, so every replicate can be recomputed anywhere.

Units are numbered within their group (``by``) and cut into slices. A replicate's n draws are dealt over the slices by
keyed binomial splits, a multinomial draw that every task works out for itself; the draws that fall into a slice
are then made where the slice's values are. One row for each slice and replicate is shuffled, never one for each draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from exposura.functions.checks import enforce, is_finite
from exposura.functions.scale import ROWS_PER_TASK, running_totals
from exposura.session import materialize

# Units of one slice: its values and one replicate's draws are arrays in one task.
SLICE_UNITS = 100_000
# The constants of the splitmix64 generator.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

# Cumulative Poisson(1) probabilities P(X <= 0) ... P(X <= 15).
POISSON_ONE_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
    0.9999999999363916, 0.9999999999954763, 0.9999999999996967, 0.9999999999999811,
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(31))


def draw_places(seed: int, replicate: int, part: int, draws: int, size: int) -> np.ndarray:
    """``draws`` places below ``size``: the splitmix64 stream of (seed, replicate, slice)."""
    start = np.uint64(0)
    with np.errstate(over="ignore"):
        for key in (seed, replicate, part):
            start = _mixed((start ^ np.uint64(key)) + np.uint64(_STEP))
        stream = _mixed(start + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(_STEP))
    return ((stream >> np.uint64(11)).astype(np.float64) / float(1 << 53) * size).astype(np.int64)


def draws_of_slice(samples: int, units: int, slice_units: int, part: int, seed: int) -> np.ndarray:
    """How many of the ``units`` draws of each replicate fall into slice ``part``; over all slices they add up."""
    low, high = 0, max(1, -(-units // slice_units))
    draws = np.full(samples, units, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * slice_units / (min(high * slice_units, units) - low * slice_units)
        left = np.random.Generator(np.random.Philox(key=[seed, low << 32 | high])).binomial(draws, share)
        draws, low, high = (left, low, middle) if part < middle else (draws - left, middle, high)
    return draws


def bootstrap_means(
    values: DataFrame, unit: str, value: str, samples: int = 500, seed: int = 42, by: Sequence[str] = (),
    min_rows: int = ROWS_PER_TASK, slice_units: int | None = None,
) -> DataFrame:
    """``(*by, replicate, replicate_mean)``: each group's units resampled with replacement, n draws per replicate.

    ``unit`` is unique within a group. Null values are drawn but not averaged.
    """
    if samples < 1:
        raise ValueError("a bootstrap needs at least one resample")
    by, size = list(by), slice_units or SLICE_UNITS
    clean = values.select(*by, F.col(unit).alias("_unit"), F.col(value).cast("double").alias("_v"))
    placed = running_totals(clean, F.col("_unit"), {"_i": F.lit(1)}, by, min_rows=min_rows)
    slices = placed.groupBy(*by, F.floor(F.col("_i") / size).cast("long").alias("_part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda r: F.coalesce(r["_v"], F.lit(float("nan")))).alias("_values")
    )
    counts = slices.groupBy(*by).agg(F.sum(F.size("_values")).alias("_units"))
    sized = slices.join(counts, by) if by else slices.withColumn("_units", counts.scalar())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, units = batch.column("_part")[at].as_py(), batch.column("_units")[at].as_py()
                held = batch.column("_values")[at].values.to_numpy(zero_copy_only=False)
                known, filled = ~np.isnan(held), np.nan_to_num(held)
                totals, kept = np.zeros(samples), np.zeros(samples, np.int64)
                for replicate, draws in enumerate(draws_of_slice(samples, units, size, part, seed)):
                    drawn = draw_places(seed, replicate, part, int(draws), len(held))
                    totals[replicate], kept[replicate] = filled[drawn].sum(), known[drawn].sum()
                again = pa.array(np.full(samples, at))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(again) for c in by], pa.array(np.arange(samples, dtype=np.int32)), pa.array(totals), pa.array(kept)],
                    [*by, "replicate", "_total", "_draws"],
                )

    schema = T.StructType([
        *[sized.schema[c] for c in by], T.StructField("replicate", T.IntegerType()),
        T.StructField("_total", T.DoubleType()), T.StructField("_draws", T.LongType()),
    ])
    drawn = sized.select(*by, "_part", "_units", "_values").mapInArrow(work, schema)
    return drawn.groupBy(*by, "replicate").agg(F.try_divide(F.sum("_total"), F.sum("_draws")).alias("replicate_mean"))


def _interval(
    values: DataFrame, value: str, means: DataFrame, names: Mapping[str, str], by: Sequence[str] = (), with_error: bool = False
) -> DataFrame:
    """Estimate and percentile interval of each group; the replicates are few, so ``percentile`` is fine."""
    stats = means.groupBy(*by).agg(
        F.percentile("replicate_mean", F.lit(0.025)).alias(names["low"]),
        F.percentile("replicate_mean", F.lit(0.975)).alias(names["high"]),
        F.coalesce(F.stddev_samp("replicate_mean"), F.lit(0.0)).alias("bootstrap_standard_error"),
    )
    result = values.groupBy(*by).agg(F.avg(value).alias(names["mean"]), F.count(F.lit(1)).alias(names["n"]))
    if by:
        result = result.join(stats, list(by))
    else:
        packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
        result = result.withColumns({c: packed[c] for c in stats.columns})
    return result if with_error else result.drop("bootstrap_standard_error")


def user_means(per_group: DataFrame, metric: str = "ndcg", k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return per_group.where(F.col("k") == k).groupBy(*by, "user_id").agg(F.avg(metric).alias("value"))


def bootstrap_user_metric(
    per_group: DataFrame, metric: str = "ndcg", k: int = 10, samples: int = 500, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over users of a user's mean metric, with a user-level 95 % percentile interval, for each group of ``by``.

    All groups, such as every model on every domain, are one job.
    """
    users = materialize(user_means(per_group, metric, k, by))
    means = bootstrap_means(users, "user_id", "value", samples, seed, by)
    return _interval(users, "value", means, {"mean": "mean", "low": "ci_low", "high": "ci_high", "n": "n_users"}, by)


def _difference_intervals(paired: DataFrame, by: Sequence[str], samples: int, seed: int) -> DataFrame:
    differences = materialize(
        paired.select(*by, "user_id", (F.col("_left") - F.col("_right")).alias("value")).where("value is not null")
    )
    means = bootstrap_means(differences, "user_id", "value", samples, seed, by)
    return _interval(
        differences, "value", means, {"mean": "mean_difference", "low": "ci_low", "high": "ci_high", "n": "n_users"}, by
    )


def paired_user_bootstrap(
    left: DataFrame, right: DataFrame, metric: str = "ndcg", k: int = 10, samples: int = 500, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Interval of left minus right over the users both sides have, for each group of ``by``."""
    paired = user_means(left, metric, k, by).withColumnRenamed("value", "_left").join(
        user_means(right, metric, k, by).withColumnRenamed("value", "_right"), [*by, "user_id"]
    )
    return _difference_intervals(paired, by, samples, seed)


def paired_bootstrap_of_all(
    per_group: DataFrame, side: str = "model", metric: str = "ndcg", k: int = 10, samples: int = 500, seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """``paired_user_bootstrap`` of every two values of ``side`` in one job: ``(*by, left_side, right_side, …)``.

    The means of a user's sides meet in one row of at most as many entries as there are sides.
    """
    means = user_means(per_group, metric, k, [*by, side]).groupBy(*by, "user_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(side).alias("name"), "value"))).alias("_s")
    )
    left, right = f"left_{side}", f"right_{side}"
    pairs = means.select(*by, "user_id", "_s", F.explode("_s").alias("_a")).select(
        *by, "user_id", "_a", F.explode(F.filter("_s", lambda s: s["name"] > F.col("_a.name"))).alias("_b")
    ).select(
        *by, "user_id", F.col("_a.name").alias(left), F.col("_b.name").alias(right), F.col("_a.value").alias("_left"), F.col("_b.value").alias("_right")
    )
    return _difference_intervals(pairs, [*by, left, right], samples, seed)


def bootstrap_mean(rows: DataFrame, unit: str, value: str, samples: int = 200, seed: int = 42) -> DataFrame:
    """Mean of a finite column with a percentile interval and the replicates' standard error."""
    clean = enforce(
        rows.select(unit, F.col(value).cast("double").alias(value)), is_finite(F.col(value)), "bootstrap values must be finite"
    )
    means = bootstrap_means(clean, unit, value, samples, seed)
    return _interval(
        clean, value, means, {"mean": "estimate", "low": "lower_95", "high": "upper_95", "n": "rows"}, with_error=True
    ).withColumn("bootstrap_samples", F.lit(samples))


# Rows whose draws are one matrix, and groups that a task adds up before it hands them on.
_CHUNK_ROWS, _HELD_GROUPS = 2048, 512


def _poisson_counts(keys: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Rows by replicates: Poisson(1) counts by inverting the distribution function, keyed by (seed, row key, replicate)."""
    with np.errstate(over="ignore"):
        start = _mixed(np.full(1, seed, np.uint64) + np.uint64(_STEP))
        start = _mixed((start ^ keys) + np.uint64(_STEP))
        stream = _mixed(start[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(_STEP))
    u = (stream >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(POISSON_ONE_CDF, u, side="right")


def poisson_replicates(
    rows: DataFrame, unit: str, sums: Mapping[str, Column], by: Sequence[str] = (), samples: int = 200, seed: int = 42
) -> DataFrame:
    """Weighted sums per replicate, each row entering replicate b Poisson(1) times: ``(*by, replicate, _n, *sums)``.

    This stands in for drawing n rows with replacement: it needs no row index and no join. Every task multiplies the matrix
    of its rows' counts with their values and hands on one vector of replicates per group, so what is shuffled hangs on
    tasks and groups, not on rows. Nulls count as 0. Rows of one unit share their draws.
    """
    if samples < 1:
        raise ValueError("a bootstrap needs at least one resample")
    by, names = list(by), list(sums)
    key = F.col(unit).cast("long") if isinstance(rows.schema[unit].dataType, T.IntegralType) else F.xxhash64(unit)
    narrow = rows.select(
        *by, F.coalesce(key, F.lit(0)).alias("_key"), F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in sums.values()]).alias("_v")
    )
    kinds = [narrow.schema[c] for c in by]
    schema = T.StructType([*kinds, T.StructField("replicate", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("_n", *names)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types = None

        def handed_on():
            for group, total in held.items():
                columns = [pa.array([value] * samples, kind) for value, kind in zip(group, types)]
                columns.append(pa.array(np.arange(samples, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in total.T.copy()]], [*by, "replicate", "_n", *names])
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys = batch.column("_key").to_numpy().view(np.uint64)
            values = np.column_stack([np.ones(batch.num_rows), batch.column("_v").flatten().to_numpy().reshape(batch.num_rows, -1)])
            groups = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            codes: dict[tuple, int] = {}
            code = np.fromiter((codes.setdefault(g, len(codes)) for g in groups), np.int64, len(groups))
            for start in range(0, batch.num_rows, _CHUNK_ROWS):
                part = slice(start, start + _CHUNK_ROWS)
                counts, own = _poisson_counts(keys[part], samples, seed), code[part]
                for group, number in codes.items():
                    some = own == number
                    if some.any():
                        total = counts[some].T.astype(float) @ values[part][some]
                        held[group] = held[group] + total if group in held else total
            if len(held) > _HELD_GROUPS:
                yield from handed_on()
        yield from handed_on()

    partial = narrow.mapInArrow(work, schema)
    return partial.groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in ("_n", *names)])
