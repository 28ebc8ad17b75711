"""Cohort, concentration, diversity and calibration reports over scored impressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.columns import UNKNOWN, ratio
from exposura.functions.scale import ROWS_PER_TASK, ordered_position, running_totals
from exposura.operators.ranking_metrics import ranking_metrics, top_per_group
from exposura.session import materialize


def category_or_unknown(column: str = "category") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def gini(values: DataFrame, value: str, by: Sequence[str] = (), min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Gini coefficient of non-negative values per ``by`` group, 0 for empty or all-zero input.

    Sum of rank × value is taken over distinct values: ``c`` copies placed after ``b`` smaller values
    hold the ranks b+1 … b+c. No row is ranked one by one.
    """
    by = list(by)
    counts = values.select(*by, F.greatest(F.col(value), F.lit(0)).cast("double").alias("_x")).groupBy(*by, "_x").agg(
        F.count(F.lit(1)).alias("_c")
    )
    placed = running_totals(counts, F.col("_x"), {"_b": F.col("_c")}, by, min_rows=min_rows)
    c, b, x = F.col("_c").cast("double"), F.col("_b").cast("double"), F.col("_x")
    sums = placed.groupBy(*by).agg(
        F.sum(c).alias("_n"), F.sum(c * x).alias("_total"), F.sum(x * (c * b + c * (c + 1) / 2)).alias("_ranked")
    )
    index = 2 * F.col("_ranked") / (F.col("_n") * F.col("_total")) - (F.col("_n") + 1) / F.col("_n")
    return sums.select(*by, F.when(F.coalesce(F.abs("_total"), F.lit(0.0)) <= 1e-8, F.lit(0.0)).otherwise(index).alias("gini"))


def recommendation_behavior(
    predictions: DataFrame, catalog: DataFrame, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Catalog coverage, Gini over recommended items and their number, from the top ``k`` per context."""
    by = list(by)
    frequency = materialize(
        top_per_group(predictions, k, [*by, "context_id"]).groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("recommended"))
    )
    size = catalog.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    unique = frequency.groupBy(*by).agg(F.count(F.lit(1)).alias("unique_recommended_items"))
    concentration = gini(frequency, "recommended", by).withColumnRenamed("gini", "recommendation_gini")
    joined = unique.join(concentration, by) if by else unique.withColumn("recommendation_gini", concentration.scalar())
    return joined.withColumn(
        "catalog_coverage", ratio(F.col("unique_recommended_items"), F.greatest(size.scalar(), F.lit(1)))
    )


def user_cohorts(users: DataFrame, train: DataFrame, min_rows: int = ROWS_PER_TASK, by: Sequence[str] = ()) -> DataFrame:
    """History terciles of the given users, cut anew in each ``by`` group: low / medium / high by (history count, user id).

    The bin edges of an equal-count cut of ranks 1…n fall just below an integer where they would be
    one, hence the strict integer comparisons. A single user cannot be cut in three.
    """
    counts = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_count"))
    base = materialize(
        users.select(*by, "user_id").distinct().join(counts, "user_id", "left")
        .select(*by, "user_id", F.coalesce("history_count", F.lit(0)).alias("history_count"))
    )
    ranked = ordered_position(base, F.col("history_count"), "user_id", "_rank", by, min_rows)
    if by:
        ranked = ranked.join(base.groupBy(*by).agg(F.count(F.lit(1)).alias("_users")), list(by))
        n = F.col("_users")
    else:
        n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    steps = 3 * (F.col("_rank") - 1)
    cohort = (
        F.when(n < 2, F.raise_error(F.lit("terciles need at least two users")).cast("string"))
        .when(steps < n - 1, F.lit("low")).when(steps < 2 * (n - 1), F.lit("medium")).otherwise(F.lit("high"))
    )
    return ranked.select(*by, "user_id", "history_count", cohort.alias("cohort"))


def user_cohort_report(
    predictions: DataFrame, train: DataFrame, k_values: Sequence[int] = (5, 10, 20), by: Sequence[str] = (),
    min_users: int = 0,
) -> DataFrame:
    """Ranking metrics, users and rows per history tercile; ``small`` marks cohorts under ``min_users``.

    A cohort in which no list can be evaluated keeps its rows, with no metrics and no eligible groups.
    """
    by = list(by)
    cohorts = user_cohorts(predictions, train, by=by)
    work = predictions.join(cohorts.select(*by, "user_id", "cohort"), [*by, "user_id"])
    sizes = work.groupBy(*by, "cohort", "user_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by, "cohort").agg(
        F.count(F.lit(1)).alias("users"), F.sum("_n").alias("rows")
    )
    metrics = ranking_metrics(work, k_values, by=[*by, "cohort"])
    every = sizes.withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_values])))
    counted = {c: F.coalesce(c, F.lit(0)) for c in ("eligible_groups", "eligible_rows")}
    return every.join(metrics, [*by, "cohort", "k"], "left").withColumns(counted).withColumn("small", F.col("users") < min_users)


def item_cohorts(train: DataFrame, min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Items by training exposure: top 10 % head, next 40 % mid, rest tail."""
    exposure = materialize(train.groupBy("item_id").agg(F.count(F.lit(1)).alias("training_exposure")))
    n = exposure.agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_position(exposure, -F.col("training_exposure"), "item_id", "_rank", min_rows=min_rows)
    share = F.col("_rank") / n.scalar()
    cohort = F.when(share <= 0.10, "head").when(share <= 0.50, "mid").otherwise("tail")
    return ranked.select("item_id", "training_exposure", cohort.alias("item_cohort"))


def item_cohort_report(
    predictions: DataFrame, train: DataFrame, k_values: Sequence[int] = (5, 10, 20), by: Sequence[str] = (), min_items: int = 0
) -> DataFrame:
    """Traffic, recommendation share and recall per item popularity cohort, one row per cohort and k.

    ``small`` marks cohorts of fewer than ``min_items`` items.
    """
    by = list(by)
    top_k = max(k_values)
    work = predictions.join(item_cohorts(train), "item_id", "left").withColumns(
        {
            "training_exposure": F.coalesce("training_exposure", F.lit(0)),
            "item_cohort": F.coalesce("item_cohort", F.lit("zero_history")),
        }
    )
    group = [*by, "item_cohort"]
    per_item = work.groupBy(*group, "item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("long_view").alias("_p")
    )
    traffic = per_item.groupBy(*group).agg(
        F.count(F.lit(1)).alias("catalog_items"), F.sum("_n").alias("rows"),
        (F.sum("_p") / F.sum("_n")).alias("positive_rate"),
    )
    positives = (
        work.where(F.col("long_view") == 1).select(*group, "context_id", "item_id").distinct()
        .groupBy(*group).agg(F.count(F.lit(1)).alias("_positive_pairs"))
    )
    top = top_per_group(work, top_k, [*by, "context_id"])
    # a repeated (context, item) counts once as a hit, at its best rank
    pairs = top.groupBy(*group, "context_id", "item_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("training_exposure").alias("_exposure"),
        F.min(F.when(F.col("long_view") == 1, F.col("rank"))).alias("_hit_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"_at_{k}") for k in k_values],
    )
    shown = pairs.groupBy(*group).agg(
        F.sum("_rows").alias("_shown"), F.sum("_exposure").alias("_exposure"),
        *[F.sum(f"_at_{k}").alias(f"_at_{k}") for k in k_values],
        *[F.count_if(F.col("_hit_rank") <= k).alias(f"_hits_{k}") for k in k_values],
    )
    totals = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most four cohort rows each
    zero = F.lit(0)
    full = traffic.join(positives, group, "left").join(shown, group, "left").withColumns(
        {
            "interaction_share": F.col("rows") / F.sum("rows").over(totals),
            "recommended_share": ratio(F.coalesce("_shown", zero), F.greatest(F.sum("_shown").over(totals), F.lit(1))),
            "average_training_exposure": F.coalesce(ratio(F.col("_exposure"), F.col("_shown")), F.lit(0.0)),
            **{f"_all_{k}": F.sum(f"_at_{k}").over(totals) for k in k_values},
        }
    )
    at_k = [
        F.struct(
            F.lit(k).alias("k"),
            F.coalesce(ratio(F.col(f"_at_{k}"), F.col(f"_all_{k}")), F.lit(0.0)).alias("recommendation_share_at_k"),
            ratio(F.coalesce(f"_hits_{k}", zero), F.greatest(F.coalesce("_positive_pairs", zero), F.lit(1)))
            .alias("positive_recall_at_k"),
        )
        for k in k_values
    ]
    return full.select(
        *by, F.col("item_cohort").alias("cohort"), "catalog_items", (F.col("catalog_items") < min_items).alias("small"), "rows",
        "interaction_share", "positive_rate",
        "recommended_share", "average_training_exposure", F.explode(F.array(*at_k)).alias("_m"),
    ).select("*", "_m.*").drop("_m")


def diversity(predictions: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean category diversity, normalised entropy and unique categories of the top ``k`` lists.

    Entropy is divided by the log of the list size; lists of one item count 0.
    """
    by = list(by)
    context = [*by, "context_id"]
    counts = (
        top_per_group(predictions, k, context).withColumn("_category", category_or_unknown())
        .groupBy(*context, "_category").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    )
    # entropy of shares c/n written with sums: ln n - sum(c ln c)/n, so one aggregate per list is enough
    c = F.col("_c")
    lists = counts.groupBy(*context).agg(
        F.sum("_c").alias("_n"), F.sum(c * (c - 1) / 2).alias("_same"), F.sum(c * F.log(c)).alias("_clogc"),
        F.count(F.lit(1)).alias("_unique"),
    )
    n = F.col("_n")
    spread = F.when(n > 1, 1 - F.col("_same") / (n * (n - 1) / 2)).otherwise(F.lit(0.0))
    entropy = F.when(n > 1, (F.log(n) - F.col("_clogc") / n) / F.log(n)).otherwise(F.lit(0.0))
    return lists.groupBy(*by).agg(
        F.avg(spread).alias("intra_list_category_diversity"),
        F.avg(entropy).alias("normalized_category_entropy"),
        F.avg("_unique").alias("mean_unique_categories"),
        F.count(F.lit(1)).alias("contexts"),
    ).withColumn("k", F.lit(k))


def preference_profiles(train: DataFrame, categories: DataFrame) -> DataFrame:
    """``(user_id, category, preference)``: category shares of a user's positive events.

    Events are counted per (user, item) before categories are joined, so a hot user's rows collapse
    early; what remains per user is one row per category.
    """
    counted = train.where(F.col("long_view") == 1).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    mixed = (
        counted.join(categories.select("item_id", "category"), "item_id", "left")
        .groupBy("user_id", category_or_unknown().alias("category")).agg(F.sum("_n").alias("_n"))
    )
    totals = mixed.groupBy("user_id").agg(F.sum("_n").alias("_total"))
    return mixed.join(totals, "user_id").select(
        "user_id", "category", (F.col("_n") / F.col("_total")).alias("preference")
    )


def calibration_per_context(
    recommendations: DataFrame, profiles: DataFrame, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Jensen-Shannon divergence (natural log) between each list's category mix and its user's profile.

    Both sides are smoothed by 1e-12 over the union of their categories and renormalised. Contexts
    whose user has no profile are left out.
    """
    by, epsilon = list(by), F.lit(1e-12)
    context = [*by, "context_id", "user_id"]
    mix = (
        top_per_group(recommendations, k, [*by, "context_id"]).groupBy(*context, category_or_unknown().alias("category"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    lists = mix.groupBy(*context).agg(F.sum("_n").alias("_size"))
    known = lists.join(profiles, "user_id")
    eligible = lists.join(profiles.select("user_id").distinct(), "user_id", "left_semi")
    shares = mix.join(eligible, context).withColumn("_share", F.col("_n") / F.col("_size"))
    union = (
        known.select(*context, "category", "preference")
        .join(shares.select(*context, "category", "_share"), [*context, "category"], "full")
        .withColumns(
            {
                "_p": F.coalesce("preference", F.lit(0.0)) + epsilon,
                "_q": F.coalesce("_share", F.lit(0.0)) + epsilon,
            }
        )
    )
    totals = union.groupBy(*context).agg(F.sum("_p").alias("_ps"), F.sum("_q").alias("_qs"))
    p, q = F.col("_p") / F.col("_ps"), F.col("_q") / F.col("_qs")
    middle = (p + q) / 2
    term = (p * F.log(p / middle) + q * F.log(q / middle)) / 2
    return union.join(totals, context).groupBy(*context).agg(F.sum(term).alias("js_divergence"))


def js_calibration(recommendations: DataFrame, profiles: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    per_context = calibration_per_context(recommendations, profiles, k, by)
    return per_context.groupBy(*by).agg(
        F.avg("js_divergence").alias("js_divergence_mean"), F.count(F.lit(1)).alias("contexts")
    ).withColumn("k", F.lit(k))


def item_age_report(rows: DataFrame, train: DataFrame, edges_days: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Items, rows and positive rate by the age of the row's item: days since its first training row, ``unseen`` without one.

    Ages fall into ``<a``, ``<b``, … of the ascending edges, and ``older``. Rows from before an item's first training row count
    as its youngest.
    """
    first = train.groupBy("item_id").agg(F.min("timestamp_ms").alias("_first"))
    days = F.floor((F.col("timestamp_ms") - F.col("_first")) / 86_400_000)
    name = F.lit("older")
    for edge in sorted(edges_days, reverse=True):
        name = F.when(days < edge, f"<{edge}").otherwise(name)
    aged = rows.join(first, "item_id", "left").withColumn("age", F.when(F.col("_first").isNull(), "unseen").otherwise(name))
    return aged.groupBy("age", "item_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("long_view").alias("_p")).groupBy("age").agg(
        F.count(F.lit(1)).alias("items"), F.sum("_n").alias("rows"), (F.sum("_p") / F.sum("_n")).alias("positive_rate")
    )


def history_depth_report(rows: DataFrame, train: DataFrame, low_below: int = 20) -> DataFrame:
    """Users, rows and positive rate by training-history depth: zero, low, mature."""
    depth = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("_history"))
    per_user = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("long_view").alias("_p"))
    n = F.coalesce(F.col("_history"), F.lit(0))
    name = F.when(n == 0, "zero").when(n < low_below, "low").otherwise("mature")
    return per_user.join(depth, "user_id", "left").groupBy(name.alias("depth")).agg(
        F.count(F.lit(1)).alias("users"), F.sum("_n").alias("rows"), (F.sum("_p") / F.sum("_n")).alias("positive_rate")
    )
