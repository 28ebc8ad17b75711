"""Running totals, positions and percentiles that never gather a hot key in one task.

A plain window puts a whole partition key, or the whole table when there is no key, into a single
task. The helpers here work in two levels instead: rows are cut into ordered slices, each slice is
summarised (with map-side combine), the few slice totals are accumulated, and the window runs only
inside a slice. All results are exact; slicing decides only how the work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.session import materialize

# A single task sorts this many narrow rows without trouble, so smaller inputs are not sliced.
ROWS_PER_TASK = 1_000_000
# A key may further have to hold this share of all rows to count as hot. None by default: the bound is rows per
# task, and the list of hot keys is a table whose join Spark plans by its size.
HOT_SHARE = 0.0
# Time slice of a hot key's rows.
SLICE_MS = 60_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], min_rows: int = ROWS_PER_TASK, share: float = HOT_SHARE
) -> DataFrame:
    """Keys with more than ``min_rows`` rows and more than ``share`` of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > min_rows)
    if share > 0:
        hot = hot.where(F.col("_rows") > F.lit(float(share)) * counts.agg(F.sum("_rows").alias("n")).scalar())
    return hot.select(*keys)


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], min_rows: int = ROWS_PER_TASK, share: float = HOT_SHARE
) -> DataFrame | None:
    """The stored list of hot keys, or None where there are none and a plain window will do.

    This is one job over the key columns with map-side combine. Knowing the answer before the main
    plan is built keeps that plan to a single shuffle on ordinary data.
    """
    hot = materialize(hot_keys(df, keys, min_rows, share))  # once; asking first would count the keys twice
    return None if hot.isEmpty() else hot


def with_time_slice(df: DataFrame, keys: Sequence[str], order: str, hot: DataFrame, slice_width: int = SLICE_MS) -> DataFrame:
    """Add ``_slice``: the time slice of a hot key's row, the constant 0 for every other key.

    The added ``_hot`` flag tells the two apart. ``hot`` is a stored table, so Spark knows its size when it joins.
    """
    marked = df.join(hot.withColumn("_hot", F.lit(True)), list(keys), "left").withColumn(
        "_hot", F.coalesce("_hot", F.lit(False))
    )
    return marked.withColumn(
        "_slice", F.when(F.col("_hot"), F.floor(F.col(order) / slice_width)).otherwise(F.lit(0)).cast("long")
    )


def earlier_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, Column],
    inclusive: bool = False,
    slice_width: int = SLICE_MS,
    min_rows: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
    counted: DataFrame | None = None,
    combine: str = "sum",
) -> DataFrame:
    """For every row, the sum of each measure over the key's rows with a strictly smaller ``order``.

    With ``combine="max"`` it is the largest value instead, null where there is no such row.

    Rows that share the ``order`` value never see each other; with ``inclusive`` they all do. Without
    hot keys this is one shuffle and one range-frame window. Otherwise the rows of hot keys are
    spread over ``(key, slice)`` and get the totals of the earlier slices from a small table. Hot
    keys are looked for in ``counted``, a cheaper frame with the same keys, where ``df`` is a long plan.
    """
    last = 0 if inclusive else -1
    fold = {"sum": F.sum, "max": F.max}[combine]

    def or_empty(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)) if combine == "sum" else value

    def over_earlier(rows: DataFrame, part: Sequence[str], measures: Mapping[str, Column] = measures) -> DataFrame:
        inside = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, last)
        return rows.withColumns({name: or_empty(fold(value).over(inside)) for name, value in measures.items()})

    hot = find_hot_keys(df if counted is None else counted, keys, min_rows, share)
    if hot is None:
        return over_earlier(df, keys)
    sliced = with_time_slice(df, keys, order, hot, slice_width)
    part = [*keys, "_slice"]
    per_slice = (
        sliced.where(F.col("_hot")).groupBy(*part)
        .agg(*[fold(value).alias(f"_slice_{name}") for name, value in measures.items()])
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *part, *[fold(f"_slice_{name}").over(before).alias(f"_carry_{name}") for name in measures]
    )

    def merged(name: str) -> Column:
        carry = or_empty(F.col(f"_carry_{name}"))
        return F.col(name) + carry if combine == "sum" else F.greatest(F.col(name), carry)

    # rows of a hot key that share the order value are one row inside the window, and get its result by a join
    own = {name: F.col(f"_own_{name}") for name in measures}
    moments = sliced.where(F.col("_hot")).groupBy(*part, order).agg(
        *[fold(value).alias(f"_own_{name}") for name, value in measures.items()]
    )
    placed = over_earlier(moments, part, own).join(carried, part, "left").select(
        *keys, order, *[merged(name).alias(f"_at_{name}") for name in measures]
    )
    spread = sliced.where(F.col("_hot")).join(placed, [*keys, order]).select(
        *df.columns, *[F.col(f"_at_{name}").alias(name) for name in measures]
    )
    ordinary = over_earlier(sliced.where(~F.col("_hot")), keys)
    return ordinary.select(*df.columns, *measures).unionByName(spread)


def running_totals(
    df: DataFrame,
    order: Column,
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    min_rows: int = ROWS_PER_TASK,
    ties: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Exclusive running sums along ``order``, without a single-task sort.

    ``order`` is unique within ``by``, or made so by the ``ties`` columns. The input is read more than
    once, so it is stored first unless the caller says it already is.

    Inputs of at most ``min_rows`` rows use one window. Larger ones are range-partitioned along ``by`` and ``order``
    into slices of about ``min_rows`` rows and stored; the totals of the slices are accumulated apart and joined back.
    """
    by = list(by)
    df = df if stored else materialize(df)
    slices = -(-df.count() // max(1, min_rows))
    work = df.withColumn("_slice", F.lit(0))
    if slices > 1:
        cut = df.withColumn("_order", order).repartitionByRange(slices, *by, "_order", *ties)
        work = materialize(cut.withColumn("_slice", F.spark_partition_id()).drop("_order"))
    inside = Window.partitionBy(*by, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    detail = work.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in measures.items()})
    if slices <= 1:
        return detail.drop("_slice")
    totals = work.groupBy(*by, "_slice").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in measures.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by, "_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in measures]
    )
    return detail.join(carried, [*by, "_slice"]).select(
        *df.columns, *[(F.col(n) + F.col(f"_carry_{n}")).alias(n) for n in measures]
    )


def ordered_position(
    df: DataFrame,
    primary: Column,
    tie_break: str,
    name: str = "position",
    by: Sequence[str] = (),
    min_rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """1-based position by (``primary`` ascending, ``tie_break`` ascending) within ``by``.

    Equal primary values are counted once first, so the running total goes over distinct values, and
    the positions inside one value are sliced by ``tie_break``. ``tie_break`` must be unique there.
    """
    by = list(by)
    keyed = materialize(df.withColumn("_primary", primary))
    values = keyed.groupBy(*by, "_primary").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_totals(values, F.col("_primary"), {"_offset": F.col("_rows")}, by, min_rows=min_rows)
    inner = running_totals(
        keyed, F.col(tie_break), {"_inner": F.lit(1)}, [*by, "_primary"], min_rows=min_rows, stored=True
    )
    return inner.join(offsets.drop("_rows"), [*by, "_primary"]).select(
        *df.columns, (F.col("_offset") + F.col("_inner") + 1).cast("long").alias(name)
    )


def values_at(
    df: DataFrame, value: str, indices: Mapping[str, Column], by: Sequence[str] = (), min_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Order statistics: the value at each 0-based sorted index, one row per ``by`` group.

    ``indices`` are expressions over the group size ``_n``. Only distinct values with their counts
    are sorted.
    """
    by = list(by)
    counts = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_copies"))
    )
    below = running_totals(counts, F.col(value), {"_below": F.col("_copies")}, by, min_rows=min_rows, stored=True)
    sizes = counts.groupBy(*by).agg(F.sum("_copies").alias("_n"))
    if by:
        placed = below.join(sizes, by)
    else:
        placed = below.withColumn("_n", sizes.scalar())
    picks = [
        F.max(F.when((F.col("_below") <= index) & (index < F.col("_below") + F.col("_copies")), F.col(value))).alias(name)
        for name, index in indices.items()
    ]
    return placed.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)


def exact_percentiles(
    df: DataFrame, value: str, percents: Mapping[str, float], by: Sequence[str] = (), min_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """Linear-interpolated percentiles, exact, one row per ``by`` group.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer; this picks the two
    neighbouring order statistics from a sliced running count instead.
    """
    place = {name: F.lit(percent / 100.0) * (F.col("_n") - 1) for name, percent in percents.items()}
    indices: dict[str, Column] = {}
    for name, position in place.items():
        indices[f"_lo_{name}"] = F.floor(position)
        indices[f"_hi_{name}"] = F.least(F.floor(position) + 1, F.col("_n") - 1)
    stats = values_at(df, value, indices, by, min_rows)
    return stats.select(
        *by,
        *[
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (position - F.floor(position))).alias(name)
            for name, position in place.items()
        ],
    )
