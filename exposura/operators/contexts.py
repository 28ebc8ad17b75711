"""Ranking contexts: sessions cut at gaps, then windows of a fixed number of impressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from exposura.functions.checks import require_columns
from exposura.functions.columns import uniform_hash
from exposura.functions.scale import HOT_SHARE, ROWS_PER_TASK, SLICE_MS, find_hot_keys, values_at, with_time_slice
from exposura.session import materialize


def ranking_contexts(
    log: DataFrame,
    max_gap_minutes: int = 30,
    window_size: int = 20,
    by: Sequence[str] = (),
    slice_width: int = SLICE_MS,
    min_rows: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Add ``session_position`` (0-based in the session) and ``context_id`` = ``user:session:window``.

    Rows are ordered by (timestamp, item) per user; a session starts at a user's first row and where
    the gap exceeds the limit. Window number = position // size. One shuffle by user serves all
    windows. Where some users are hot, it is by (user, time slice), and what a slice needs from the
    earlier ones (last timestamp, sessions, rows, last session start) comes from a slice summary.
    With ``by`` every group of those columns (say, each exposure domain) has contexts of its own.
    """
    require_columns(log, ["user_id", "timestamp_ms", "item_id"], "ranking context input")
    if max_gap_minutes <= 0 or window_size <= 0:
        raise ValueError("a session needs a gap and a window above zero")
    keys, limit = [*by, "user_id"], max_gap_minutes * 60_000
    hot = find_hot_keys(log, keys, min_rows, share)
    if hot is None:
        return _named(_plain_sessions(log, keys, limit), log.columns, window_size)
    return _named(_sliced_sessions(with_time_slice(log, keys, "timestamp_ms", hot, slice_width), keys, limit), log.columns, window_size)


def _named(rows: DataFrame, columns: list[str], window_size: int) -> DataFrame:
    """Session and position columns to the public ones."""
    position = F.col("_position").cast("long")
    return rows.select(
        *columns,
        position.alias("session_position"),
        F.concat_ws(
            ":", F.col("user_id").cast("string"), F.col("_session").cast("string"),
            F.floor(position / window_size).cast("string"),
        ).alias("context_id"),
    )


def _flagged(rows: DataFrame, inside: WindowSpec, previous: Column, limit: int) -> DataFrame:
    """``_starts`` marks the first row of a session, ``_row`` numbers the rows of the window partition."""
    starts = F.coalesce(F.col("timestamp_ms") - previous > limit, F.lit(True))
    return rows.withColumns({"_starts": starts.cast("int"), "_row": F.row_number().over(inside)})


def _counted(rows: DataFrame, inside: WindowSpec) -> DataFrame:
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {
            "_sessions": F.sum("_starts").over(upto),
            "_start_row": F.max(F.when(F.col("_starts") == 1, F.col("_row"))).over(upto),
        }
    )


def _plain_sessions(log: DataFrame, keys: list[str], limit: int) -> DataFrame:
    inside = Window.partitionBy(*keys).orderBy("timestamp_ms", "item_id")
    rows = _counted(_flagged(log, inside, F.lag("timestamp_ms").over(inside), limit), inside)
    return rows.withColumns({"_session": F.col("_sessions") - 1, "_position": F.col("_row") - F.col("_start_row")})


def _sliced_sessions(sliced: DataFrame, keys: list[str], limit: int) -> DataFrame:
    part = [*keys, "_slice"]
    inside = Window.partitionBy(*part).orderBy("timestamp_ms", "item_id")
    earlier_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last_seen = (
        sliced.where(F.col("_hot")).groupBy(*part).agg(F.max("timestamp_ms").alias("_slice_last"))
        .select(*part, F.max("_slice_last").over(earlier_slices).alias("_carry_last"))
    )
    previous = F.coalesce(F.lag("timestamp_ms").over(inside), F.col("_carry_last"))
    flagged = _flagged(sliced.join(last_seen, part, "left"), inside, previous, limit)
    zero = F.lit(0)
    summary = (
        flagged.where(F.col("_hot")).groupBy(*part)
        .agg(
            F.sum("_starts").alias("_n_sessions"),
            F.count(F.lit(1)).alias("_n_rows"),
            F.max(F.when(F.col("_starts") == 1, F.col("_row"))).alias("_last_start"),
        )
        .withColumn("_carry_sessions", F.coalesce(F.sum("_n_sessions").over(earlier_slices), zero))
        .withColumn("_carry_rows", F.coalesce(F.sum("_n_rows").over(earlier_slices), zero))
        .withColumn("_carry_start", F.max(F.col("_carry_rows") + F.col("_last_start")).over(earlier_slices))
        .select(*part, "_carry_sessions", "_carry_rows", "_carry_start")
    )
    placed = _counted(flagged, inside).join(summary, part, "left")
    row = F.col("_row") + F.coalesce("_carry_rows", zero)
    start = F.coalesce(F.col("_start_row") + F.coalesce("_carry_rows", zero), F.col("_carry_start"))
    return placed.withColumns(
        {"_session": F.col("_sessions") + F.coalesce("_carry_sessions", zero) - 1, "_position": row - start}
    )


def sample_contexts(rows: DataFrame, maximum: int, seed: int = 42, column: str = "context_id") -> DataFrame:
    """All rows of at most ``maximum`` contexts, chosen by a seeded hash of the context.

    Contexts are ranked by hash; the cutoff is an order statistic, so no sort of all contexts is
    needed and the chosen ids reach the rows through a semi join.
    """
    hashed = materialize(rows.select(column).distinct().withColumn("_u", uniform_hash(F.col(column), seed)))
    cutoff = values_at(hashed, "_u", {"_cut": F.least(F.col("_n"), F.lit(maximum)) - 1}).select("_cut")
    chosen = hashed.where(F.col("_u") <= cutoff.scalar()).select(column)
    return rows.join(chosen, column, "left_semi")


def context_starts(rows: DataFrame) -> DataFrame:
    """The earliest row of every context: candidates are fetched as of the context's beginning."""
    first = Window.partitionBy("context_id").orderBy("timestamp_ms", "item_id")
    return rows.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).drop("_first")


def window_size_report(
    log: DataFrame, sizes: Sequence[int] = (10, 20, 50), max_gap_minutes: int = 30, min_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Contexts, rows and contexts with a positive among two rows or more, for each window size, from one session pass.

    Rows are added up over stretches as long as the sizes' greatest common divisor; windows are made of those.
    """
    if not sizes or min(sizes) < 1:
        raise ValueError("window sizes are above zero")
    unit = gcd(*sizes)
    session = F.regexp_replace("context_id", ":[^:]*$", "")  # user and session; the window number is dropped
    stretches = ranking_contexts(log, max_gap_minutes, unit, min_rows=min_rows).groupBy(
        session.alias("session"), F.floor(F.col("session_position") / unit).alias("part")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("long_view").alias("p"))
    windows = stretches.withColumn("window_size", F.explode(F.array(*[F.lit(s) for s in sorted(set(sizes))]))).groupBy(
        "window_size", "session", F.floor(F.col("part") * unit / F.col("window_size")).alias("window")
    ).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return windows.groupBy("window_size").agg(
        F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("rows"),
        F.count_if((F.col("n") >= 2) & (F.col("p") > 0)).alias("eligible_contexts"),
    )
