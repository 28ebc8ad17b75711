"""Greedy calibrated reranking: relevance against distance from the user's category preference."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from exposura.operators.reports import category_or_unknown

RELEVANCE_WEIGHTS = (1.0, 0.9, 0.75, 0.5)
# Lists whose greedy steps are taken together, which bounds the memory of a task.
LISTS_AT_A_TIME = 2_048


def _greedy(sizes: np.ndarray, starts: np.ndarray, preference: np.ndarray, heads: np.ndarray, rank: np.ndarray, relevance: np.ndarray, weight: float, k: int) -> np.ndarray:
    """Candidate ranks chosen greedily, a row for each list, 0 beyond its size.

    List ``i`` has the queues ``starts[i]`` to ``starts[i + 1]``, one per category of its universe: a preference and the list's
    best candidates of that category in rank order, ``rank`` and ``relevance`` from ``heads[q]`` to ``heads[q + 1]``. Within a
    category all candidates pay the same distance, so only the head of each queue can be chosen; a step compares the heads of
    all lists. Utilities are compared at nine decimals and ties go to the better rank; a null relevance, passed as -inf, goes
    last, NaN first.
    """
    first, widths = starts[:-1], np.diff(starts)
    taken, picked, none = np.zeros(len(preference), np.int64), np.zeros((len(sizes), k), np.int32), np.iinfo(np.int64).max
    rank, relevance = np.append(rank.astype(np.int64), none), np.append(relevance, -np.inf)
    for number in range(1, k + 1):
        left = heads[:-1] + taken < heads[1:]
        at = np.where(left, heads[:-1] + taken, len(rank) - 1)
        own = np.abs(taken / number - preference)
        base = np.repeat(np.add.reduceat(own, first), widths)
        with np.errstate(invalid="ignore"):  # masked ones are set below
            utility = weight * relevance[at] - (1 - weight) * (base - own + np.abs((taken + 1) / number - preference)) / 2
        utility = np.where(relevance[at] == -np.inf, -np.inf, np.where(np.isnan(utility), np.inf, np.round(utility, 9)))
        best = np.repeat(np.maximum.reduceat(utility, first), widths)
        chosen = np.minimum.reduceat(np.where(utility == best, rank[at], none), first)
        open_lists = sizes >= number
        if not open_lists.any():
            break
        picked[open_lists, number - 1] = chosen[open_lists]
        taken += left & (rank[at] == np.repeat(chosen, widths))
    return picked


def _picks(weights: Sequence[float], k: int, carried: int):
    """Over rows of ``carried`` columns, ``_size`` and ``_queues``: the carried columns, each weight and the ranks it picks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LISTS_AT_A_TIME):
                batch = whole.slice(at, LISTS_AT_A_TIME)
                sizes = np.minimum(batch.column(carried).to_numpy(), k)
                queues = batch.column(carried + 1)
                starts = np.r_[0, np.cumsum(pc.list_value_length(queues).to_numpy())]
                queues = queues.flatten()
                entries = queues.field("heads")
                heads = np.r_[0, np.cumsum(pc.list_value_length(entries).to_numpy())]
                entries = entries.flatten()
                scores = entries.field("relevance")
                relevance = np.where(scores.is_null().to_numpy(zero_copy_only=False), -np.inf, scores.to_numpy(zero_copy_only=False))
                given = starts, queues.field("preference").to_numpy(), heads, entries.field("rank").to_numpy(), relevance
                for weight in weights:
                    picked = _greedy(sizes, *given, weight, k)
                    ranks = pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(picked[np.arange(k) < sizes[:, None]], pa.int32())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:carried], pa.array(np.full(len(sizes), weight)), ranks],
                        [*batch.schema.names[:carried], "relevance_weight", "_picked"],
                    )

    return work


def rerank_frontier(
    candidates: DataFrame, profiles: DataFrame, weights: Sequence[float] = RELEVANCE_WEIGHTS, k: int = 10
) -> DataFrame:
    """All candidates of every context, once per relevance weight, with ``rerank_position``.

    The first ``k`` places are chosen greedily; the rest keep their score order. Relevance is scaled
    by the list's minimum and maximum, both taken together with 0. Users without a profile get a
    uniform preference over the list's categories. Only the first ``k`` candidates of each category
    can ever be chosen, so that is all that is gathered per context, however long its list is; the
    tail is placed by joins.
    """
    context = ["context_id", "user_id"]
    ordered = Window.partitionBy(*context).orderBy(F.desc("score"), "item_id", *(
        ["timestamp_ms"] if "timestamp_ms" in candidates.columns else []
    ))
    ranked = candidates.withColumns({"_category": category_or_unknown(), "_rank": F.row_number().over(ordered)})
    lists = candidates.groupBy(*context).agg(
        F.least(F.min("score"), F.lit(0.0)).alias("_low"), F.greatest(F.max("score"), F.lit(0.0)).alias("_high"),
        F.count(F.lit(1)).alias("_size"),
    )
    in_category = Window.partitionBy(*context, "_category").orderBy("_rank")
    heads = (
        ranked.select(*context, "_category", "_rank", "score")
        .withColumn("_place", F.row_number().over(in_category)).where(F.col("_place") <= k)
        .join(lists, context)
        .withColumn("_relevance", (F.col("score") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)))
        .groupBy(*context, "_category")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_relevance").alias("relevance")))
            ).alias("_heads")
        )
    )
    # the universe of a list: its own categories and those of the user's profile
    wanted = lists.select(*context).join(profiles.select("user_id", F.col("category").alias("_category"), "preference"), "user_id")
    universe = heads.join(wanted, [*context, "_category"], "full").groupBy(*context).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("_category").alias("category"), F.coalesce("preference", F.lit(0.0)).alias("preference"),
                    F.coalesce("_heads", F.array().cast("array<struct<rank:int,relevance:double>>")).alias("heads"),
                )
            )
        ).alias("_queues")
    )
    total = F.aggregate("_queues", F.lit(0.0), lambda s, q: s + q["preference"])
    normalized = F.transform(
        "_queues",
        lambda q: F.struct(
            q["heads"].alias("heads"),
            F.when(F.col("_total") == 0, F.lit(1.0) / F.size("_queues"))
            .otherwise(q["preference"] / F.greatest(F.col("_total"), F.lit(1e-300))).alias("preference"),
        ),
    )
    prepared = universe.join(lists.select(*context, "_size"), context).withColumn("_total", total).select(
        *context, "_size", normalized.alias("_queues")
    )
    added = [T.StructField("relevance_weight", T.DoubleType()), T.StructField("_picked", T.ArrayType(T.IntegerType()))]
    picked = prepared.mapInArrow(
        _picks([float(w) for w in weights], int(k), len(context)), T.StructType([*prepared.select(*context).schema.fields, *added])
    )
    # a candidate's place: its position among the picks, or k plus the unpicked ones before it
    place = F.array_position("_picked", F.col("_rank"))
    picked_before = F.size(F.filter("_picked", lambda r: r < F.col("_rank")))
    position = F.when(place > 0, place).otherwise(F.size("_picked") + F.col("_rank") - picked_before)
    return ranked.join(picked, context).select(
        *candidates.columns, "relevance_weight", position.cast("int").alias("rerank_position")
    )
