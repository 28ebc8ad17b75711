"""Places of rows along an order inside groups of any size, and joins that shuffle no more than they have to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from exposura.functions.scale import running_totals
from exposura.session import materialize

# Rows of one slice of the sorted table, which one task numbers. Large tables get larger slices, so that the
# number of slices stays one that Spark can plan.
SLICE_ROWS = 10_000
MOST_SLICES = 4_000


def with_place(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add each row's place in its group ``by``: 0, 1, … without gaps, by ``order``, nulls first, then by ``ties``.

    The sorted table is cut into slices, which are numbered apart and shifted by the rows before them. Rows that are
    equal in all of that are told apart by their place in the stored input, so even one repeated row that fills
    most of a group is cut. Pass narrow rows: they are stored. Null groups are one group.
    """
    # a struct of nulls is equal to itself, so rows of null groups find the totals of their slices again
    group = {"_group": F.struct(*[F.col(f"`{c}`") for c in by])} if by else {}
    stored = materialize(df.withColumns({**group, "_row": F.monotonically_increasing_id()}))
    rows = max(slice_rows, stored.count() // MOST_SLICES)
    placed = running_totals(stored, F.col(f"`{order}`"), {name: F.lit(1)}, list(group), rows, [*ties, "_row"], stored=True)
    return placed.withColumn(name, F.col(name).cast("long")).drop("_row", "_group")


# Keys that hold more than one in so many rows are joined apart; there are fewer than that of them.
HOT_KEYS = 1000


def join_unique(rows: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner", hot_keys: int | None = None) -> DataFrame:
    """``rows`` joined with ``unique``, which has at most one row for each of ``keys``; how: inner, left or left_semi.

    Rows of a key with more than its ``1 / hot_keys`` of all rows stay where they are and meet their partner by broadcast:
    fewer than ``hot_keys`` rows, whatever the size. All other rows are joined by shuffle. ``rows`` is read several times
    and has to be a stored table.
    """
    keys, share = list(keys), hot_keys or HOT_KEYS
    counts = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.where(F.col("_n") > rows.count() // share).select(*keys))
    if hot.isEmpty():
        return rows.join(unique, keys, how)
    few = F.broadcast(hot)
    apart = rows.join(few, keys, "left_semi").join(F.broadcast(unique.join(few, keys, "left_semi")), keys, how)
    return rows.join(few, keys, "left_anti").join(unique, keys, how).unionByName(apart)


# Bits of a map of hashed keys: 512 rows of 4 KB, whatever the number of keys. The more keys, the less it rules out.
MAP_BITS = 1 << 24


def _named(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns]


def _mark_partners(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_may``: false where no row of ``keys`` has the row's key, by a bitmap of hashed keys that is broadcast."""
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))

    marks = keys.select(place(F.col(key)).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    )
    own = place(F.col(key).cast(keys.schema[key].dataType))  # another type would have another hash
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(own)).join(F.broadcast(marks), "_bucket", "left")
    return marked.select(*_named(rows), F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("_may"))


def join_few(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of wide ``rows`` with ``few``, a stored table: rows without a partner are hardly ever shuffled."""
    return _mark_partners(rows, few, key).where("_may").drop("_may").join(few, key)


def drop_few(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Anti join of wide ``rows`` with ``few``, a stored table: rows that stay are hardly ever shuffled. Null keys stay.

    ``rows`` is read twice, so it should be a stored table.
    """
    marked = _mark_partners(rows, few, key)
    apart = marked.where("_may").drop("_may").join(few.select(key), key, "left_anti").select(*_named(rows))
    return marked.where("not _may").drop("_may").unionByName(apart)
