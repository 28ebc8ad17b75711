"""Labelled candidate sets and retrieval quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from exposura.functions.checks import require_columns
from exposura.functions.columns import discount, ideal_gain, ratio
from exposura.operators.contexts import context_starts

# The explicit actions that make a positive a graded one.
EXPLICIT_ACTIONS = ("is_like", "is_follow", "is_comment", "is_forward", "is_profile_enter")


def relevance_labels(exposed: DataFrame) -> DataFrame:
    """``(context_id, item_id, label_binary, label_graded)`` of positive rows, the best per pair."""
    present = [name for name in EXPLICIT_ACTIONS if name in exposed.columns]
    explicit = F.greatest(*[F.coalesce(F.col(n), F.lit(0)) for n in present], F.lit(0)) > 0 if present else F.lit(False)
    return (
        exposed.where(F.col("long_view") == 1)
        .groupBy("context_id", "item_id")
        .agg(
            F.lit(1).cast("tinyint").alias("label_binary"),
            (F.lit(1) + F.max(explicit.cast("int"))).cast("tinyint").alias("label_graded"),
        )
    )


def missing_positives(candidates: DataFrame, exposed: DataFrame) -> DataFrame:
    """Positive (context, item) pairs that the candidate set lacks."""
    return relevance_labels(exposed).join(candidates.select("context_id", "item_id"), ["context_id", "item_id"], "left_anti")


def attach_labels(candidates: DataFrame, exposed: DataFrame, mode: str = "binary") -> DataFrame:
    """Label the candidates and append missed positives as ``forced_positive`` rows.

    A forced row scores just below the lowest candidate score overall and ranks one behind its
    context's last candidate (1 if the context has none; several forced rows share the rank). The
    candidates are read several times: pass a stored table, not an unfinished retrieval.
    """
    if mode not in ("binary", "graded"):
        raise ValueError(f"labels are binary or graded, not {mode!r}")
    pair = ["context_id", "item_id"]
    labels = relevance_labels(exposed)
    zero = F.lit(0).cast("tinyint")
    labelled = candidates.join(labels, pair, "left").withColumns(
        {name: F.coalesce(F.col(name), zero) for name in ("label_binary", "label_graded")}
    )
    carried = [
        name for name in ("user_id", "timestamp_ms", "date", "tab", "session_position")
        if name in exposed.columns and name in candidates.columns
    ]
    floor = candidates.agg((F.min("retrieval_score") - F.lit(1e-6)).alias("floor"))
    last = candidates.groupBy("context_id").agg(F.max("retrieval_rank").alias("_last"))
    forced = (
        labels.join(candidates.select(*pair), pair, "left_anti")
        .join(context_starts(exposed).select("context_id", *carried), "context_id", "left")
        .join(last, "context_id", "left")
        .withColumn("retrieval_score", floor.scalar())
        .withColumn("retrieval_rank", F.coalesce(F.col("_last"), F.lit(0)) + 1)
    )
    columns = [*candidates.columns, "label_binary", "label_graded"]
    return (
        labelled.select(*columns, F.lit(0).alias("forced_positive"))
        .unionByName(
            forced.select(
                *[F.col(c) if c in forced.columns else F.lit(None).alias(c) for c in columns],
                F.lit(1).alias("forced_positive"),
            )
        )
        .withColumn("label", F.col(f"label_{mode}"))
    )


def candidate_diagnostics(candidates: DataFrame) -> DataFrame:
    """One row: how far forced positives shape a candidate set."""
    require_columns(candidates, ["context_id", "forced_positive"], "candidate diagnostics input")
    per_context = candidates.groupBy("context_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("forced_positive").alias("_forced"),
        F.count_if(F.col("label") > 0).alias("_positive"),
    )
    return per_context.agg(
        F.sum("_rows").alias("candidate_rows"),
        F.count(F.lit(1)).alias("candidate_contexts"),
        F.sum("_forced").alias("forced_positive_rows"),
        F.count_if(F.col("_forced") > 0).alias("forced_positive_contexts"),
        F.sum("_positive").alias("positive_candidate_rows"),
    ).withColumns(
        {
            "forced_positive_context_rate": ratio(
                F.col("forced_positive_contexts"), F.greatest(F.col("candidate_contexts"), F.lit(1))
            ),
            "forced_positive_share_of_positive_rows": ratio(
                F.col("forced_positive_rows"), F.greatest(F.col("positive_candidate_rows"), F.lit(1))
            ),
        }
    )


def retrieval_metrics(
    candidates: DataFrame, exposed: DataFrame, k_values: Sequence[int] = (50, 100, 200), by: Sequence[str] = ()
) -> DataFrame:
    """Catalog retrieval quality per ``k`` (and ``by`` group of the candidates), before any forcing.

    Averages run over contexts that have both positives and candidates.
    """
    by = list(by)
    truth = exposed.where(F.col("long_view") == 1).select("context_id", "item_id").distinct()
    sizes = truth.groupBy("context_id").agg(F.count(F.lit(1)).alias("_positives"))
    hits = candidates.join(truth.withColumn("_hit", F.lit(1)), ["context_id", "item_id"], "left")
    per_context = hits.groupBy(*by, "context_id").agg(*_hit_sums(F.col("_hit") == 1, k_values)).join(sizes, "context_id")
    return _mean_quality(per_context, candidates, sizes, k_values, by)


def user_list_metrics(
    lists: DataFrame, exposed: DataFrame, k_values: Sequence[int] = (50, 100, 200), by: Sequence[str] = ()
) -> DataFrame:
    """:func:`retrieval_metrics` of contexts that all take over the list of their user, which is never joined to them.

    ``lists`` holds ``(*by, user_id, item_id, retrieval_rank)`` of users who have contexts. Only positives meet the lists,
    so the work grows with positives and lists, not with contexts times the length of a list. ``lists`` is read several
    times: pass a stored table.
    """
    by = list(by)
    truth = exposed.where(F.col("long_view") == 1).select("context_id", "user_id", "item_id").distinct()
    sizes = truth.groupBy("context_id", "user_id").agg(F.count(F.lit(1)).alias("_positives"))
    hits = truth.join(lists.select(*by, "user_id", "item_id", "retrieval_rank"), ["user_id", "item_id"]).groupBy(
        *by, "context_id"
    ).agg(*_hit_sums(F.lit(True), k_values))
    served = lists.select(*by, "user_id").distinct().join(sizes, "user_id").drop("user_id")
    per_context = served.join(hits, [*by, "context_id"], "left").fillna(0, [f"_hits_{k}" for k in k_values])
    return _mean_quality(per_context, lists, sizes, k_values, by)


def _hit_sums(hit: Column, k_values: Sequence[int]) -> list[Column]:
    rank = F.col("retrieval_rank")
    return [
        *[F.count_if(hit & (rank <= k)).alias(f"_hits_{k}") for k in k_values],
        *[F.sum(F.when(hit & (rank <= k), discount(rank))).alias(f"_dcg_{k}") for k in k_values],
        F.min(F.when(hit, rank)).alias("_first"),
    ]


def _mean_quality(
    per_context: DataFrame, candidates: DataFrame, sizes: DataFrame, k_values: Sequence[int], by: list[str]
) -> DataFrame:
    rows = per_context.select(
        *by, "context_id",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        (F.col(f"_hits_{k}") / F.col("_positives")).alias("recall"),
                        F.when(F.col("_first") <= k, F.lit(1.0) / F.col("_first")).otherwise(F.lit(0.0)).alias("mrr"),
                        (F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0)) / ideal_gain(F.col("_positives"), F.lit(k))).alias("ndcg"),
                    )
                    for k in k_values
                ]
            )
        ).alias("_m"),
    ).select(*by, "_m.*")
    means = rows.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("evaluated_contexts"),
        F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"),
    )
    retrieved = candidates.groupBy(*by, "item_id").agg(F.count(F.lit(1))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("catalog_items_retrieved")
    )
    positive = sizes.agg(F.count(F.lit(1)).alias("n"))
    counted = means.join(retrieved, by) if by else means.withColumn("catalog_items_retrieved", retrieved.scalar())
    return counted.withColumn("positive_contexts", positive.scalar()).withColumn(
        "context_coverage", ratio(F.col("evaluated_contexts"), F.greatest(F.col("positive_contexts"), F.lit(1)))
    )
