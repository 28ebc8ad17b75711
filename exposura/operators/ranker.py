"""Learned ranking on MLlib: listwise row weights, linear ranker, calibrated probabilities.

A pairwise objective looks at pairs of a context's rows with different labels. There are two ways to it. The pointwise
one builds no pairs: the swap weights a row collects over all its opposite-label rows are prefix sums over
the context's ranking, which gives one weighted training row per candidate. The pairwise one draws a bounded number of
opponents for each row and learns from feature differences, so what all rows of a context share cancels out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.columns import discount, ideal_gain, uniform_hash
from exposura.operators.history import FEATURE_COLUMNS
from exposura.session import materialize

PROBABILITY_EDGE = 1e-6


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("context_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") > 0).alias("positives"))


def swap_weights(rows: DataFrame, sample_weight: str | None = None) -> DataFrame:
    """Add ``swap_weight``: the NDCG change summed over swaps with every opposite-label row of the context.

    With rows in retrieval order and discounts d, a row's weight is the sum of |d_i - d_j| over the
    rows j of the other class, divided by the ideal gain: what lies before and after the row enters
    through a count and a sum of discounts. Contexts without both classes get 0.
    """
    order = ["retrieval_rank", "item_id", *(["timestamp_ms"] if "timestamp_ms" in rows.columns else [])]
    context = Window.partitionBy("context_id")
    ranked = context.orderBy(*order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    positive = (F.col("label") > 0).cast("int")
    placed = rows.withColumn("_d", discount(F.row_number().over(ranked))).withColumn("_y", positive)
    d, y = F.col("_d"), F.col("_y")
    zero = F.lit(0.0)
    sums = placed.withColumns(
        {
            "_pos": F.sum("_y").over(context), "_rows": F.count(F.lit(1)).over(context),
            "_pos_d": F.sum(d * y).over(context), "_all_d": F.sum("_d").over(context),
            "_bpos": F.coalesce(F.sum("_y").over(before), F.lit(0)), "_bpos_d": F.coalesce(F.sum(d * y).over(before), zero),
            "_brows": F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)), "_ball_d": F.coalesce(F.sum("_d").over(before), zero),
        }
    )
    # counts and discount sums of the other class, before and after the row
    def other(total: str, positives: str):
        return F.when(y == 1, F.col(total) - F.col(positives)).otherwise(F.col(positives))

    n_before, d_before = other("_brows", "_bpos"), other("_ball_d", "_bpos_d")
    n_after, d_after = other("_rows", "_pos") - n_before, other("_all_d", "_pos_d") - d_before
    change = (d_before - n_before * d) + (n_after * d - d_after)
    weight = F.when(
        (F.col("_pos") > 0) & (F.col("_pos") < F.col("_rows")),
        F.greatest(change, zero) / ideal_gain(F.col("_pos"), F.col("_rows")),
    ).otherwise(zero)
    if sample_weight is not None:
        weight = weight * F.col(sample_weight)
    return sums.select(*rows.columns, weight.alias("swap_weight"))


def _assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)


@dataclass
class LinearRanker:
    model: LogisticRegressionModel
    features: tuple[str, ...]

    def predict(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Score = weights · features. The intercept is the same for all rows and cannot change an order."""
        score = sum((F.col(f) * F.lit(float(w)) for f, w in zip(self.features, self.model.coefficients)), F.lit(0.0))
        return rows.withColumn(name, score)

    def feature_importance(self, rows: DataFrame) -> DataFrame:
        """Absolute weight times the feature's deviation in ``rows``, largest first; one row per feature."""
        entries = F.array(*[
            F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("weight"), F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias("deviation"))
            for f, w in zip(self.features, self.model.coefficients)
        ])
        table = rows.agg(entries.alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
        return table.withColumn("importance", F.abs("weight") * F.col("deviation")).orderBy(F.desc("importance"), "feature")


def _graded_gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def _bounded_discount(rank: Column, depth: int) -> Column:
    return F.when(rank <= depth, discount(rank)).otherwise(F.lit(0.0))


def pairwise_rows(
    rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, keys: Sequence[str] = ("context_id",), opponents: int = 16,
    pool: int = 64, depth: int = 200, seed: int = 42, sample_weight: str | None = None,
) -> DataFrame:
    """Pairs of a context's rows in which the first has the higher graded label, with what swapping them would change.

    Columns: the keys, ``winner_item``, ``loser_item``, ``winner_label``, ``loser_label``, ``delta_ndcg``, ``pair_weight``
    and ``d_<feature>``, winner minus loser. ``delta_ndcg`` is |difference of gains 2^label - 1| times |difference of the
    discounts of the two retrieval ranks| over the ideal gain of the first ``depth`` ranks, beyond which discounts are 0.

    Every row meets at most ``opponents`` of the rows below it, so a context with many rows gives many pairs, not their
    square. Opponents are drawn by a keyed hash from the context's pool: the ``pool`` rows of each label with the
    least hash, found as a bounded group limit before the shuffle. ``pair_weight`` scales each pair up to the rows its
    draw stands for, so weights sum to what all pairs would on average. One row per context is joined back: a context
    with a large share of all rows is split by the skew join. Items are unique within a context; contexts with one
    label give no pairs.
    """
    keys = list(keys)
    weight = F.col(sample_weight).cast("double") if sample_weight else F.lit(1.0)
    work = rows.select(
        *keys, "item_id", F.col("label").cast("int").alias("label"), F.col("retrieval_rank").alias("_rank"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), weight.alias("_w"),
    )
    key = [F.col(k) for k in keys]
    least = Window.partitionBy(*keys, "label").orderBy(uniform_hash(*key, F.col("item_id"), "pool", seed), "item_id")
    pooled = work.withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= pool).groupBy(*keys).agg(
        F.collect_list(F.struct("label", "item_id", "_rank", "_x")).alias("_pool")
    )
    levels = work.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("label", "n")), asc=False).alias("_levels")
    )

    def placed(state: Column, level: Column) -> Column:  # ranks of a label in the ideal order follow those of higher ones
        last = F.least(state["at"] + level["n"], F.lit(depth))
        ranks = F.when(last > state["at"], F.sequence(state["at"] + 1, last)).otherwise(F.array().cast("array<bigint>"))
        gain = F.aggregate(ranks, F.lit(0.0), lambda total, rank: total + discount(rank)) * _graded_gain(level["label"])
        return F.struct((state["at"] + level["n"]).alias("at"), (state["sum"] + gain).alias("sum"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0.0).alias("sum"))
    contexts = pooled.join(levels, keys).where(F.size("_levels") > 1).select(
        *keys, "_pool", "_levels", F.aggregate("_levels", start, placed, lambda s: s["sum"]).alias("_ideal")
    )
    met = work.join(contexts, keys).withColumn(
        "_below", F.aggregate(F.filter("_levels", lambda v: v["label"] < F.col("label")), F.lit(0).cast("bigint"), lambda n, v: n + v["n"])
    ).where(F.col("_below") > 0)
    drawn = F.slice(F.array_sort(F.transform(
        F.filter("_pool", lambda p: p["label"] < F.col("label")),
        lambda p: F.struct(uniform_hash(*key, F.col("item_id"), p["item_id"], "pair", seed).alias("u"), p["item_id"].alias("item_id"), p.alias("p")),
    )), 1, opponents)
    pairs = met.withColumn("_drawn", drawn).withColumn("_each", F.col("_below") / F.size("_drawn")).select(
        *keys, "item_id", "label", "_rank", "_x", "_w", "_ideal", "_each", F.explode("_drawn.p").alias("_o")
    )
    gap = F.abs(_bounded_discount(F.col("_rank"), depth) - _bounded_discount(F.col("_o._rank"), depth))
    delta = (_graded_gain(F.col("label")) - _graded_gain(F.col("_o.label"))) * gap / F.col("_ideal")
    return pairs.select(
        *keys, F.col("item_id").alias("winner_item"), F.col("_o.item_id").alias("loser_item"), F.col("label").alias("winner_label"),
        F.col("_o.label").alias("loser_label"), delta.alias("delta_ndcg"), (delta * F.col("_each") * F.col("_w")).alias("pair_weight"),
        *[(F.col("_x")[i] - F.col("_o._x")[i]).alias(f"d_{f}") for i, f in enumerate(features)],
    )


def fit_pairwise_ranker(
    rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, keys: Sequence[str] = ("context_id",), opponents: int = 16,
    pool: int = 64, depth: int = 200, seed: int = 42, sample_weight: str | None = None, max_iter: int = 100, reg_param: float = 1e-4,
) -> LinearRanker:
    """Logistic regression without intercept on feature differences, each pair weighted by what its swap would change.

    Half of the pairs, by a keyed hash, are turned round, so that both outcomes occur.
    """
    pairs = pairwise_rows(rows, features, keys, opponents, pool, depth, seed, sample_weight).where("pair_weight > 0")
    turned = uniform_hash(*[F.col(k) for k in keys], F.col("winner_item"), F.col("loser_item"), "side", seed) < 0.5
    sign = F.when(turned, -1.0).otherwise(1.0)
    training = _assembled(
        pairs.select(*[(sign * F.col(f"d_{f}")).alias(f) for f in features], (sign > 0).cast("double").alias("label"), "pair_weight"), features
    )
    estimator = LogisticRegression(
        featuresCol="_features", weightCol="pair_weight", maxIter=max_iter, regParam=reg_param, fitIntercept=False
    )
    return LinearRanker(estimator.fit(training.select("label", "_features", "pair_weight")), tuple(features))


def fit_linear_ranker(
    rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, sample_weight: str | None = None,
    max_iter: int = 100, reg_param: float = 1e-3,
) -> LinearRanker:
    """Weighted logistic regression of relevance, each row weighted by what swapping it would change."""
    weighted = swap_weights(rows, sample_weight).where("swap_weight > 0")
    training = _assembled(weighted, features).select(
        (F.col("label") > 0).cast("double").alias("label"), "_features", "swap_weight"
    )
    estimator = LogisticRegression(
        featuresCol="_features", weightCol="swap_weight", maxIter=max_iter, regParam=reg_param
    )
    return LinearRanker(estimator.fit(training), tuple(features))


@dataclass
class ProbabilityModel:
    classifier: GBTClassificationModel
    calibrator: IsotonicRegressionModel
    features: tuple[str, ...]

    def predict(self, rows: DataFrame, name: str = "probability") -> DataFrame:
        raw = _raw_probability(self.classifier, _assembled(rows, self.features))
        calibrated = self.calibrator.transform(raw)
        inside = F.greatest(F.least(F.col("_calibrated"), F.lit(1 - PROBABILITY_EDGE)), F.lit(PROBABILITY_EDGE))
        return calibrated.select(*rows.columns, inside.alias(name))


def _raw_probability(model: GBTClassificationModel, assembled: DataFrame) -> DataFrame:
    return model.transform(assembled).withColumn("_raw", F.get(vector_to_array("_probability"), F.lit(1)))


def fit_probability_model(
    train: DataFrame, validation: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, seed: int = 42,
    trees: int = 20, depth: int = 4,
) -> ProbabilityModel:
    """Boosted trees on the training rows, isotonic calibration on the validation rows only.

    Validation rows are scored once and counted per score, so what is sorted and pooled are scores, which the trees'
    leaves bound, not rows.
    """
    label = (F.col("label") > 0).cast("double")
    booster = GBTClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=trees, maxDepth=depth, stepSize=0.1,
        seed=seed,
    ).setProbabilityCol("_probability").setRawPredictionCol("_margin").fit(_assembled(train, features).withColumn("_label", label))
    held = materialize(_raw_probability(booster, _assembled(validation, features)).groupBy("_raw").agg(
        F.avg(label).alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight")
    ))
    isotonic = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_calibrated", weightCol="_weight").fit(held)
    return ProbabilityModel(booster, isotonic, tuple(features))
