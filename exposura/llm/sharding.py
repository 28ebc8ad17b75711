"""Shards of a dataset by rendezvous hashing of record keys over weighted shards (built-in expressions only).

Every shard draws a number for every key, and the key goes to the shard of the smallest. A key's draw
for a shard depends on nothing but the two, so one more shard takes keys from all others into itself
and moves nothing between them. Shard ``s`` of weight ``w`` draws ``-ln(u) / w`` with ``u`` uniform
over (0, 1): the shares of the shards are then in proportion to their weights.

Draws are MD5, so that any other program finds a key's shard too: ``u`` is the first 13 hex digits of
the digest of the key, ``:`` and the shard's number, plus one half, over 2**52.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from exposura.llm.ordering import with_place


def key_text(*columns: Column) -> Column:
    """The stable key of a record: its values as text, joined by ``|``; a null is the word null."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])


def _draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.log(uniform) / weight).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard, from 0, that ``key`` belongs to. Ties go to the smaller number."""
    checked = [float(w) for w in weights]
    if not checked or not all(w > 0 and math.isfinite(w) for w in checked):
        raise ValueError("weights are positive and finite, one for each shard")
    return F.array_min(F.array(*[_draw(key, shard, w) for shard, w in enumerate(checked)]))["shard"]


def assign_shards(
    df: DataFrame, keys: Sequence[str], weights: Sequence[float], grown_by: float | None = None,
    name: str = "shard", grown: str = "grown_shard",
) -> DataFrame:
    """All rows and columns of ``df`` with the shard of each row's key.

    With ``grown_by``, the weight of one more shard, ``grown`` is the shard under the longer list: either the
    same one, or the new one. No shuffle: a row's shard hangs on its key alone. Rows that share a key share a
    shard, null keys are one key, an empty table gives no rows; columns called like the results are replaced.
    """
    if name == grown:
        raise ValueError("the two results need different names")
    key = key_text(*[F.col(f"`{k}`") for k in keys])
    added = {name: shard_of(key, weights)}
    if grown_by is not None:
        added[grown] = shard_of(key, [*weights, grown_by])
    return df.withColumns(added)


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digest of a sharded text table, one row per row of ``docs``.

    Columns: the key, ``size`` (bytes of the text and one), ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard``. A null text has no bytes and the check sum of none. Slots count from 0 in each shard without gaps, by
    key, nulls first, then by check sum and size; a shard of any size is numbered in slices.
    """
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(f"`{key}`"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = assign_shards(narrow, [key], weights, grown_by)
    return with_place(sharded, ["shard"], key, ["text_crc32", "size"], "slot").select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(df: DataFrame, path: str, keys: Sequence[str], weights: Sequence[float], parts: int = 1) -> None:
    """Write the whole of ``df`` as Parquet, one folder ``shard=N`` for each shard, in ``parts`` files or so.

    A shard's rows are dealt over ``parts`` tasks by the digest of the whole row, so neither a shard nor a frequent key
    is one task unless its rows are all equal. Folders of an earlier run are replaced.
    """
    sharded = assign_shards(df, keys, weights)
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts))
    count = parts * len(list(weights))
    sharded.repartition(count, "shard", deal).write.partitionBy("shard").mode("overwrite").parquet(path)


def moves(df: DataFrame, keys: Sequence[str], before: Sequence[float], after: Sequence[float]) -> DataFrame:
    """``(shard_before, shard_after, rows)`` for every pair of shards that rows would go between, the stayers included."""
    key = key_text(*[F.col(f"`{k}`") for k in keys])
    return df.select(shard_of(key, before).alias("shard_before"), shard_of(key, after).alias("shard_after")).groupBy(
        "shard_before", "shard_after"
    ).agg(F.count(F.lit(1)).alias("rows"))
