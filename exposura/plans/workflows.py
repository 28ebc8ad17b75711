"""Plans that chain several operators: baseline evaluation, selection, recommendation, reranking frontier."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.columns import finite_or_zero
from exposura.functions.scale import running_totals
from exposura.operators.candidates import user_list_metrics
from exposura.operators.history import ranker_features
from exposura.operators.popularity import popularity_score
from exposura.operators.ranker import LinearRanker, fit_linear_ranker
from exposura.operators.ranking_metrics import ranking_metrics
from exposura.operators.reports import diversity, js_calibration, recommendation_behavior
from exposura.operators.retrieval import exact_topk, weighted_queries, with_popularity
from exposura.operators.rerank import RELEVANCE_WEIGHTS, rerank_frontier
from exposura.operators.splits import SplitBounds, assign_splits
from exposura.operators.weights import density_weights
from exposura.session import materialize

Scorer = Callable[[DataFrame], DataFrame]


def popularity_baseline(log: DataFrame, bounds: SplitBounds, k_values: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Split, fit popularity on train, score both test splits, evaluate by user and day: one job, two domains.

    A log that has its ``split`` already, such as the table of ``stored_splits``, is taken as it is.
    """
    split = log if "split" in log.columns else assign_splits(log, bounds)
    train = split.where("split = 'train'")
    test = split.where(F.col("split").isin("standard_test", "randomized_test")).withColumn(
        "domain", F.when(F.col("split") == "standard_test", "standard").otherwise("randomized")
    )
    return ranking_metrics(popularity_score(test, train), k_values, by=["domain"], group_by="user_date")


def linear_scorer(weights: Mapping[str, float]) -> Scorer:
    """Score = weighted sum of finite feature values."""
    def score(rows: DataFrame) -> DataFrame:
        total: Column = F.lit(0.0)
        for name, weight in weights.items():
            total = total + finite_or_zero(F.col(name)) * F.lit(float(weight))
        return rows.withColumn("score", total)

    return score


def recommend(
    requests: DataFrame, users: DataFrame, items: DataFrame, train: DataFrame | None = None, scorer: Scorer | None = None,
    candidate_k: int = 200, final_k: int = 10,
) -> DataFrame:
    """Top ``final_k`` per request ``(user_id, timestamp_ms)`` out of ``candidate_k`` retrieved items.

    Without a scorer the retrieval score decides. Requests of unknown users are not here: see
    :func:`unknown_requests`.
    """
    wanted = users.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    rows = requests.select("user_id", "timestamp_ms").join(exact_topk(wanted, items, candidate_k), "user_id")
    if scorer is None:
        scored = rows.withColumn("score", F.col("retrieval_score"))
    else:
        if train is None:
            raise ValueError("a ranker needs the training history for its features")
        blank = rows.withColumns({"tab": F.lit(0), "session_position": F.lit(0)})
        scored = scorer(ranker_features(blank, train))
    best = Window.partitionBy("user_id", "timestamp_ms").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= final_k)


def unknown_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users.select("user_id"), "user_id", "left_anti")


def select_variant(table: DataFrame, metric: str, *, tie_breakers: Sequence[Column]) -> DataFrame:
    """The row with the largest metric; NaN and null count as lowest, ``tie_breakers`` settle equal values."""
    value = F.when(F.isnan(F.col(metric)), F.lit(None)).otherwise(F.col(metric))
    return table.orderBy(value.desc_nulls_last(), *tie_breakers).limit(1)


def hybrid_sweep(
    contexts: DataFrame, users: DataFrame, items: DataFrame, prior: DataFrame, weights: Sequence[float] = (0.0, 0.1, 0.25, 0.5),
    candidate_k: int = 200, k_values: Sequence[int] = (50, 100, 200),
) -> DataFrame:
    """Retrieval metrics for every popularity weight in one job.

    A (user, weight) pair is a query whose extra coordinate is the weight, so all weights share one
    search over the catalog. The users' lists are stored before they are evaluated; contexts never carry copies of them.
    """
    known = users.join(contexts.select("user_id").distinct(), "user_id", "left_semi")
    queries = weighted_queries(
        known.select("*", F.explode(F.lit([float(w) for w in weights])).alias("popularity_weight")), F.col("popularity_weight")
    ).withColumn("query", F.concat_ws(":", F.col("user_id").cast("string"), F.col("popularity_weight").cast("string")))
    top = exact_topk(queries, with_popularity(items, prior), candidate_k, query_col="query").join(
        queries.select("query", "user_id", "popularity_weight"), "query"
    )
    lists = materialize(top.select("popularity_weight", "user_id", "item_id", "retrieval_rank"))
    return user_list_metrics(lists, contexts, k_values, by=["popularity_weight"])


def select_hybrid_weight(sweep: DataFrame, recall_k: int = 200) -> DataFrame:
    """Best weight by recall, then NDCG, then the smaller weight."""
    at_k = sweep.where(F.col("k") == recall_k)
    return select_variant(at_k, "recall", tie_breakers=[F.desc("ndcg"), F.col("popularity_weight")])


def frontier_report(
    candidates: DataFrame, profiles: DataFrame, catalog: DataFrame, weights: Sequence[float] = RELEVANCE_WEIGHTS, k: int = 10
) -> DataFrame:
    """Relevance, calibration, diversity and coverage for every relevance weight, over all contexts.

    Evaluation scores are the negated positions; the reranked rows are stored once because four
    reports read them.
    """
    reranked = materialize(
        rerank_frontier(candidates, profiles, weights, k).withColumn("score", -F.col("rerank_position").cast("double"))
    )
    by = ["relevance_weight"]
    relevance = ranking_metrics(reranked, (k,), by=by).select(*by, "ndcg", "recall", "mrr", "eligible_groups")
    calibration = js_calibration(reranked, profiles, k, by).select(*by, "js_divergence_mean")
    variety = diversity(reranked, k, by).drop("contexts", "k")
    behavior = recommendation_behavior(reranked, catalog, k, by)
    return relevance.join(calibration, by, "left").join(variety, by).join(behavior, by)


def clip_sweep(
    train: DataFrame, adaptation: DataFrame, random_prior: float, clips: Sequence[float] = (2.0, 5.0, 10.0, 20.0), k: int = 10,
) -> tuple[DataFrame, LinearRanker]:
    """Fit a density-weighted ranker per clip value and choose by NDCG on the adaptation slice.

    ``train`` carries ``domain_probability``. The few clip values are fitted one after the other, each
    fit being a distributed job; the models' scores on the adaptation rows are evaluated together.
    """
    models = {clip: fit_linear_ranker(density_weights(train, random_prior, clip), sample_weight="weight") for clip in clips}
    scored = None
    for clip, model in models.items():
        part = model.predict(adaptation).withColumn("clip", F.lit(float(clip)))
        scored = part if scored is None else scored.unionByName(part)
    table = ranking_metrics(scored, (k,), by=["clip"])
    best = select_variant(table, "ndcg", tie_breakers=[F.col("clip")]).first()
    return table, models[best["clip"] if best else clips[0]]


def implicit_factors(train: DataFrame, rank: int = 32, iterations: int = 12, regularization: float = 0.002, seed: int = 42):
    """User and item factor tables from implicit-feedback ALS on positive counts.

    ALS needs int ids, so both id spaces are numbered densely first.
    """
    positives = train.where("long_view = 1").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("float").alias("_n"))

    def numbered(key: str) -> DataFrame:
        ids = positives.select(key).distinct()
        return running_totals(ids, F.col(key), {f"_{key}": F.lit(1)}).withColumn(f"_{key}", F.col(f"_{key}").cast("int"))

    users, items = numbered("user_id"), numbered("item_id")
    model = ALS(
        rank=rank, maxIter=iterations, regParam=regularization, implicitPrefs=True, seed=seed,
        userCol="_user_id", itemCol="_item_id", ratingCol="_n",
    ).fit(positives.join(users, "user_id").join(items, "item_id"))

    def table(factors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        return factors.join(ids, factors["id"] == ids[f"_{key}"]).select(key, F.col("features").alias("embedding"))

    return table(model.userFactors, users, "user_id"), table(model.itemFactors, items, "item_id")
