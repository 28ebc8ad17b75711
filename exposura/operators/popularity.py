"""Popularity baseline, popularity prior and pair scoring with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposura.functions.checks import enforce, is_finite, standard_only
from exposura.functions.columns import dot, smoothed_rate


def popularity(train: DataFrame, alpha: float = 20.0) -> DataFrame:
    """``(item_id, exposures, positives, score)`` with rates pulled towards the global rate."""
    log = standard_only(train, "popularity")
    rate = train.agg(F.avg("long_view").alias("rate"))
    grouped = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("exposures"), F.sum("long_view").alias("positives"))
    return grouped.withColumn("score", smoothed_rate(F.col("positives"), F.col("exposures"), rate.scalar(), alpha))


def score_by_item(rows: DataFrame, scores: DataFrame, default: DataFrame, name: str = "score") -> DataFrame:
    """Item lookup; items without a score get the single value of ``default``."""
    table = scores.select("item_id", F.col("score").alias("_score"))
    return rows.join(table, "item_id", "left").select(
        *rows.columns, F.coalesce("_score", default.scalar()).alias(name)
    )


def popularity_score(rows: DataFrame, train: DataFrame, alpha: float = 20.0) -> DataFrame:
    return score_by_item(rows, popularity(train, alpha), train.agg(F.avg("long_view").alias("rate")))


def popularity_prior(train: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(item_id, prior)``: log1p of the positive count over its maximum, 0 without positives."""
    counts = train.where(F.col("long_view") == 1).groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    logged = F.log1p(F.coalesce(F.col("_n"), F.lit(0)).cast("double"))
    top = counts.agg(F.max(F.log1p(F.col("_n").cast("double"))).alias("top"))
    return catalog.select("item_id").distinct().join(counts, "item_id", "left").select(
        "item_id", F.coalesce(logged / top.scalar(), F.lit(0.0)).alias("prior")
    )


def popularity_weights(rows: DataFrame, offset: float = 1.0) -> DataFrame:
    """Add ``weight`` = 1/sqrt(prior exposure + offset), scaled to mean 1 over all rows."""
    raw = F.lit(1.0) / F.sqrt(F.coalesce(F.col("hist_item_exposure"), F.lit(0)).cast("double") + F.lit(float(offset)))
    mean = rows.agg(F.greatest(F.avg(raw), F.lit(1e-12)).alias("mean"))
    return rows.withColumn("weight", raw / mean.scalar())


def pair_score(
    rows: DataFrame, users: DataFrame, items: DataFrame, fallback: float = 0.0,
    prior: DataFrame | None = None, popularity_weight: float = 0.0, name: str = "score",
) -> DataFrame:
    """Inner product of the two embeddings of every row; ``fallback`` where either id is unknown.

    ``users`` is ``(user_id, embedding)``, ``items`` is ``(item_id, embedding)``. With a weight the
    item's popularity prior is added to known pairs.
    """
    left = users.select("user_id", F.col("embedding").alias("_u"))
    right = items.select("item_id", F.col("embedding").alias("_i"))
    score = dot(F.col("_u"), F.col("_i"))
    joined = rows.join(left, "user_id", "left").join(right, "item_id", "left")
    if popularity_weight:
        if prior is None:
            raise ValueError("popularity-weighted scoring needs the popularity prior")
        joined = joined.join(prior.select("item_id", F.col("prior").alias("_prior")), "item_id", "left")
        score = score + F.lit(float(popularity_weight)) * F.coalesce("_prior", F.lit(0.0))
    return joined.select(*rows.columns, F.coalesce(score, F.lit(float(fallback))).alias(name))


def standardize_features(table: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Z-scores with the population deviation; unusable values count as 0, a flat column divides by 1.

    Without any of the columns the result is one constant 0 feature.
    """
    present = [name for name in columns if name in table.columns]
    if not present:
        return table.select(key, F.lit(0.0).alias("constant"))
    numeric = table.select(key, *[F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)).alias(n) for n in present])
    stats = numeric.agg(
        F.struct(
            *[F.avg(n).alias(f"{n}_mean") for n in present], *[F.stddev_pop(n).alias(f"{n}_std") for n in present]
        ).alias("s")
    )
    moments = stats.scalar()
    return numeric.select(
        key,
        *[
            ((F.col(n) - moments[f"{n}_mean"])
             / F.when(moments[f"{n}_std"] > 1e-6, moments[f"{n}_std"]).otherwise(F.lit(1.0))).alias(n)
            for n in present
        ],
    )


def embedding_audit(table: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """One row: rows, distinct ids, duplicate ids, dimensions and non-finite vectors of an embedding table.

    Ids are grouped once (with map-side combine) so that duplicates and totals come out of the same
    shuffle.
    """
    bad = F.exists(F.col(vector), lambda x: ~F.coalesce(is_finite(x.cast("double")), F.lit(False)))
    per_id = table.groupBy(key).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min(F.size(vector)).alias("_min_dim"), F.max(F.size(vector)).alias("_max_dim"),
        F.count_if(bad).alias("_bad"),
    )
    return per_id.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_ids"),
        F.min("_min_dim").alias("min_dimension"),
        F.max("_max_dim").alias("max_dimension"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite_vectors"),
    ).withColumn(
        "valid",
        (F.col("rows") > 0) & (F.col("duplicate_ids") == 0) & (F.col("non_finite_vectors") == 0)
        & F.coalesce((F.col("min_dimension") == F.col("max_dimension")) & (F.col("min_dimension") > 0), F.lit(False)),
    )


def require_valid_embeddings(table: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    row = embedding_audit(table, key, vector).first()
    if not row["valid"]:
        raise ValueError(f"embedding table is unusable: {row.asDict()}")
    return table


def checked_weights(df: DataFrame, weight: str) -> DataFrame:
    column = F.col(weight)
    return enforce(df, is_finite(column) & (column >= 0), "a weight is negative or not a number")
