"""Off-policy evaluation of a bandit log: direct method, IPS, SNIPS and doubly robust.

A log row is ``(round_id, context, action, reward, pscore)`` with ``target`` and ``prediction``, arrays
over the actions, where needed. Everything is row arithmetic followed by one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from exposura.functions.checks import enforce, is_finite, require_columns
from exposura.functions.columns import bind, uniform_hash
from exposura.functions.scale import ROWS_PER_TASK, exact_percentiles, running_totals, values_at
from exposura.operators.bootstrap import poisson_replicates
from exposura.session import materialize

ESTIMATORS = ("dm", "ips", "snips", "dr")


def uniform_policy(rows: DataFrame, n_actions: int, name: str = "target") -> DataFrame:
    if n_actions < 1:
        raise ValueError("a policy needs at least one action")
    return rows.withColumn(name, F.array_repeat(F.lit(1.0 / n_actions), n_actions))


def check_target(rows: DataFrame, target: str = "target") -> DataFrame:
    """Target rows must be finite, non-negative and sum to 1."""
    ok = F.forall(target, lambda p: F.coalesce(is_finite(p) & (p >= 0), F.lit(False)))
    total = F.aggregate(target, F.lit(0.0), lambda s, p: s + p)
    return enforce(
        rows, ok & (F.size(target) > 0) & (F.abs(total - 1.0) <= 2e-5), "target policy rows must be probabilities summing to one"
    )


def importance_weights(rows: DataFrame, clip: float | None = None, name: str = "weight") -> DataFrame:
    """Add target(action)/pscore, at most ``clip``; invalid actions, propensities and targets raise."""
    if clip is not None and not 0 < clip < float("inf"):
        raise ValueError(f"importance weights can only be clipped at a finite number above zero, not {clip}")
    pscore, action = F.col("pscore"), F.col("action")
    checked = enforce(
        enforce(check_target(rows), is_finite(pscore) & (pscore > 0) & (pscore <= 1), "propensities must lie in (0, 1]"),
        (action >= 0) & (action < F.size("target")), "observed action falls outside the target policy",
    )
    weight = F.get("target", action.cast("int")) / pscore
    return checked.withColumn(name, weight if clip is None else F.least(weight, F.lit(float(clip))))


def weight_report(rows: DataFrame, raw: str = "raw_weight", used: str = "weight", min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """One row: minimum, mean, deviation, p95, p99, maximum, effective size and the clipped share."""
    w, r = F.col(used), F.col(raw)
    valid = is_finite(w) & is_finite(r) & (w >= 0) & (r >= 0)
    checked = enforce(rows, valid, "an importance weight is negative or not a number")
    points = exact_percentiles(checked, used, {"p95": 95, "p99": 99}, min_rows=min_rows)
    packed = points.agg(F.first(F.struct("p95", "p99")).alias("p")).scalar()
    return checked.agg(
        F.min(w).alias("minimum"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("standard_deviation"),
        F.max(w).alias("maximum"),
        (F.sum(w) * F.sum(w) / F.greatest(F.sum(w * w), F.lit(1e-12))).alias("effective_sample_size"),
        F.avg((w < r).cast("double")).alias("clipped_fraction"),
    ).withColumns({"p95": packed["p95"], "p99": packed["p99"]})


def _dm(rows: DataFrame) -> Column:
    return F.aggregate(
        F.zip_with("target", "prediction", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(float("nan")))
    )


def _round_terms(rows: DataFrame, clips: Sequence[float | None]) -> DataFrame:
    """``rows`` with what a round adds to the estimates: ``_dm``, and ``_w{i}``, ``_wr{i}``, ``_dr{i}`` for each clip."""
    reward = F.col("reward").cast("double")
    residual = reward - F.get("prediction", F.col("action").cast("int"))
    terms = rows.withColumn("_dm", _dm(rows))
    for i, clip in enumerate(clips):
        w = F.col("weight") if clip is None else F.least("weight", F.lit(float(clip)))
        terms = terms.withColumns({f"_w{i}": w, f"_wr{i}": w * reward, f"_dr{i}": F.col("_dm") + w * residual})
    return terms


def _sum_names(clips: Sequence[float | None]) -> list[str]:
    return ["_dm", *[f"_{kind}{i}" for i in range(len(clips)) for kind in ("w", "wr", "dr")]]


def _estimates(n: Column, i: int) -> dict[str, Column]:
    """The four estimators of clip ``i`` from sums over ``n`` rounds."""
    return {
        "dm": F.col("_dm") / n,
        "ips": F.col(f"_wr{i}") / n,
        "snips": F.col(f"_wr{i}") / F.greatest(F.col(f"_w{i}"), F.lit(1e-12)),
        "dr": F.col(f"_dr{i}") / n,
    }


def _checked_clips(clips: Sequence[float | None]) -> list[float | None]:
    for clip in clips:
        if clip is not None and not 0 < clip < float("inf"):
            raise ValueError(f"importance weights can only be clipped at a finite number above zero, not {clip}")
    return list(clips)


def _weighted_rounds(rows: DataFrame, clip: float | None) -> DataFrame:
    require_columns(rows, ["reward", "action", "pscore", "target", "prediction"], "bandit log")
    checked = enforce(
        rows,
        is_finite(F.col("reward").cast("double")) & (F.size("prediction") == F.size("target"))
        & F.forall("prediction", lambda q: F.coalesce(is_finite(q), F.lit(False))),
        "rewards and reward predictions must be finite and match the target policy",
    )
    return importance_weights(checked, clip)


def policy_values(rows: DataFrame, clips: Sequence[float | None], by: Sequence[str] = ()) -> DataFrame:
    """The four estimates, effective sample size, mean and max weight, rounds; a row per ``by`` group and clip, in one pass."""
    clips = _checked_clips(clips)
    terms = _round_terms(_weighted_rounds(rows, None), clips)
    sums = terms.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in _sum_names(clips)],
        *[F.sum(F.col(f"_w{i}") * F.col(f"_w{i}")).alias(f"_ww{i}") for i in range(len(clips))],
        *[F.max(f"_w{i}").alias(f"_max{i}") for i in range(len(clips))], F.count(F.lit(1)).alias("n_rounds"),
    )
    nonempty = enforce(sums, F.col("n_rounds") > 0, "cannot estimate a policy value from zero rounds")
    n = F.col("n_rounds")
    each = F.array(*[
        F.struct(
            *[value.alias(name) for name, value in _estimates(n, i).items()],
            (F.col(f"_w{i}") * F.col(f"_w{i}") / F.greatest(F.col(f"_ww{i}"), F.lit(1e-12))).alias("effective_sample_size"),
            (F.col(f"_w{i}") / n).alias("weight_mean"), F.col(f"_max{i}").alias("weight_max"), F.lit(clip).cast("double").alias("clip"),
        ) for i, clip in enumerate(clips)
    ])
    return nonempty.select(*by, "n_rounds", F.explode(each).alias("_e")).select(*by, "_e.*", "n_rounds")


def policy_value(rows: DataFrame, clip: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``policy_values`` of one clip."""
    return policy_values(rows, [clip], by)


def _spread(replicates: DataFrame, clips: Sequence[float | None], by: Sequence[str]) -> DataFrame:
    """``(*by, clip, estimator, lower_95, upper_95, bootstrap_standard_error)`` from sums per replicate."""
    each = F.array(*[
        F.struct(F.lit(i).alias("clip"), F.lit(name).alias("estimator"), value.alias("value"))
        for i in range(len(clips)) for name, value in _estimates(F.col("_n"), i).items()
    ])
    long = replicates.where(F.col("_n") > 0).select(*by, F.explode(each).alias("_e")).select(*by, "_e.*")
    return long.groupBy(*by, "clip", "estimator").agg(
        F.percentile("value", F.lit(0.025)).alias("lower_95"), F.percentile("value", F.lit(0.975)).alias("upper_95"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("bootstrap_standard_error"),
    )


def bootstrap_policy_value(
    rows: DataFrame, clip: float | None = None, samples: int = 200, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Percentile interval and standard error per estimator from Poisson(1) replicates of the rounds."""
    by, clips = list(by), _checked_clips([clip])
    terms = _round_terms(_weighted_rounds(rows, None), clips)
    replicates = poisson_replicates(terms, "round_id", {name: F.col(name) for name in _sum_names(clips)}, by, samples, seed)
    return _spread(replicates, clips, by).drop("clip")


def mean_reward_by_action(fit_rows: DataFrame, n_actions: int, by: Sequence[str] = ()) -> DataFrame:
    """Reward model without features: mean reward per action; actions never tried get the overall mean.

    One row per ``by`` group with ``prediction`` over all actions: the sums of each action are rows, not columns, and
    meet in one array of ``n_actions`` entries at the end.
    """
    sums = fit_rows.groupBy(*by, "action").agg(F.sum("reward").alias("_r"), F.count("reward").alias("_n")).groupBy(*by).agg(
        F.collect_list(F.struct(F.col("action").cast("int").alias("action"), (F.try_divide("_r", "_n")).alias("mean"))).alias("_tried"),
        F.try_divide(F.sum("_r"), F.sum("_n")).alias("_overall"),
    )
    tried = F.map_from_entries(F.filter("_tried", lambda t: t["action"].isNotNull()))
    actions = F.sequence(F.lit(0), F.lit(n_actions - 1))
    return sums.withColumn("_tried", tried).select(
        *by, F.transform(actions, lambda a: F.coalesce(F.try_element_at("_tried", a), F.col("_overall"))).alias("prediction")
    )


def logistic_reward_model(fit_rows: DataFrame, rows: DataFrame, n_actions: int, max_iter: int = 100) -> DataFrame:
    """Add ``prediction`` from a logistic model on context and one-hot action, fitted on ``fit_rows``.

    With one reward class the model is that class's constant probability. The linear score of every
    action is the context score plus the action's own coefficient, so no row is repeated per action.
    """
    def features(action: Column) -> Column:
        one_hot = F.transform(
            F.sequence(F.lit(0), F.lit(n_actions - 1)), lambda a: (a == action).cast("double")
        )
        return F.concat(F.transform("context", lambda x: x.cast("double")), one_hot)

    binary = F.coalesce(F.col("reward").isin(0, 1), F.lit(False))
    bounds = fit_rows.agg(
        F.min("reward").alias("lo"), F.max("reward").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(~binary).alias("other")
    ).first()
    if not bounds["n"]:
        raise ValueError("a reward model cannot be fitted on no rounds")
    if bounds["other"]:
        raise ValueError(f"a logistic reward model takes rewards of 0 and 1 only; {bounds['other']} rounds have others")
    if bounds["lo"] == bounds["hi"]:
        constant = 1.0 if bounds["hi"] == 1 else 0.0
        return rows.withColumn("prediction", F.array_repeat(F.lit(constant), n_actions))
    training = fit_rows.select(
        F.col("reward").cast("double").alias("label"), array_to_vector(features(F.col("action"))).alias("features")
    )
    model = LogisticRegression(maxIter=max_iter, regParam=1.0 / bounds["n"], standardization=False).fit(training)
    weights = [float(c) for c in model.coefficients]
    split = len(weights) - n_actions
    base = F.aggregate(
        F.zip_with("context", F.lit(weights[:split]), lambda x, c: x.cast("double") * c), F.lit(float(model.intercept)),
        lambda s, x: s + x,
    )
    by_action = F.lit(weights[split:])
    return rows.withColumn(
        "prediction", bind(base, lambda b: F.transform(by_action, lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(b + c)))))
    )


def shuffled_halves(rounds: DataFrame, seeds: Sequence[int], min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Every round once per seed with ``half`` (fit / evaluate) and its place in the evaluation half.

    The order of a seed is a hash of (round, seed); positions come from sliced counts per seed.
    """
    many = rounds.select("*", F.explode(F.lit(list(seeds))).alias("seed")).withColumn(
        "_u", uniform_hash(F.col("round_id"), F.col("seed"))
    )
    placed = running_totals(many, F.col("_u"), {"_place": F.lit(1)}, ["seed"], min_rows=min_rows, ties=["round_id"])
    sizes = rounds.agg(F.count(F.lit(1)).alias("n")).scalar()
    midpoint = F.floor(sizes / 2)
    return placed.withColumns(
        {
            "half": F.when(F.col("_place") < midpoint, "fit").otherwise("evaluate"),
            "pool_position": F.when(F.col("_place") >= midpoint, F.col("_place") - midpoint),
            "pool_size": sizes - midpoint,
        }
    ).drop("_u", "_place")


REWARD_MODELS = ("mean", "logistic")


def _modelled(halves: DataFrame, n_actions: int, seeds: Sequence[int], reward_model: str) -> DataFrame:
    """The evaluate halves with the prediction of a reward model that saw the same seed's fit half only."""
    evaluate = halves.where("half = 'evaluate'")
    if reward_model == "mean":
        model = mean_reward_by_action(halves.where("half = 'fit'"), n_actions, ["seed"])
        return evaluate.join(F.broadcast(model), "seed")  # one row per seed
    if reward_model != "logistic":
        raise ValueError(f"reward models are {REWARD_MODELS}, not {reward_model!r}")
    halves = materialize(halves)
    parts = [
        logistic_reward_model(halves.where((F.col("seed") == s) & (F.col("half") == "fit")), halves.where((F.col("seed") == s) & (F.col("half") == "evaluate")), n_actions)
        for s in seeds
    ]
    return reduce(DataFrame.unionByName, parts)


def ope_study(
    behavior: DataFrame, truth: DataFrame, n_actions: int, seeds: Sequence[int] = (42, 43, 44),
    fractions: Sequence[float] = (0.1, 0.25, 0.5, 1.0), clips: Sequence[float | None] = (None, 10.0, 50.0),
    min_rows: int = ROWS_PER_TASK, reward_model: str = "mean", samples: int = 200, bootstrap_seed: int = 42,
) -> DataFrame:
    """Estimates for every seed, sample fraction and clip: errors against the on-policy mean, intervals, weight report.

    The reward model of a seed sees only that seed's fit half. Fractions are nested, so a round belongs to the smallest one
    that holds it and sums of the larger ones add up afterwards; clips are columns of the same sums. No round is repeated
    for a setting, in the estimates or in the replicates, whose draws all settings share.
    """
    clips, fractions = _checked_clips(clips), sorted(set(fractions))
    pool = uniform_policy(_modelled(shuffled_halves(behavior, seeds, min_rows), n_actions, seeds, reward_model), n_actions)
    sizes = [F.greatest(F.lit(1), F.rint(F.col("pool_size") * F.lit(float(f))).cast("long")) for f in fractions]
    bucket = F.coalesce(*[F.when(F.col("pool_position") < size, F.lit(i)) for i, size in enumerate(sizes)])
    inside = _weighted_rounds(pool.withColumn("_bucket", bucket).where("_bucket is not null"), None)
    names = _sum_names(clips)
    terms = materialize(_round_terms(inside, clips).select("seed", "_bucket", "round_id", "weight", *names))

    def nested(sums: DataFrame, *keys: str) -> DataFrame:
        """Sums of buckets as sums of the fractions that hold them."""
        added = [c for c in sums.columns if c not in ("seed", "_bucket", *keys)]
        fold = {"_lo": F.min, "_hi": F.max}
        held = sums.withColumn("_f", F.explode(F.sequence(F.col("_bucket"), F.lit(len(fractions) - 1))))
        return held.groupBy("seed", "_f", *keys).agg(*[fold.get(c[:3], F.sum)(c).alias(c) for c in added])

    squares = [F.sum(F.col(f"_w{i}") * F.col(f"_w{i}")).alias(f"_ww{i}") for i in range(len(clips))]
    clipped = [F.count_if(F.col(f"_w{i}") < F.col("weight")).alias(f"_cut{i}") for i in range(len(clips))]
    sums = nested(terms.groupBy("seed", "_bucket").agg(
        *[F.sum(n).alias(n) for n in names], *squares, *clipped, F.min("weight").alias("_lo"), F.max("weight").alias("_hi"),
        F.count(F.lit(1)).alias("n_rounds"),
    ))
    # order statistics of the raw weights; clipping keeps their order
    places = {f"_p{p}": F.lit(p / 100) * (F.col("_n") - 1) for p in (95, 99)}
    indices = {}
    for name, at in places.items():
        indices[f"{name}_a"], indices[f"{name}_b"] = F.floor(at), F.least(F.floor(at) + 1, F.col("_n") - 1)
    raw = terms.select("seed", F.explode(F.sequence(F.col("_bucket"), F.lit(len(fractions) - 1))).alias("_f"), "weight")
    points = values_at(raw, "weight", indices, ["seed", "_f"], min_rows)
    replicates = poisson_replicates(terms, "round_id", {n: F.col(n) for n in names}, ["seed", "_bucket"], samples, bootstrap_seed)
    spread = _spread(nested(replicates, "replicate"), clips, ["seed", "_f"])
    intervals = spread.groupBy("seed", "_f", "clip").agg(*[
        F.max(F.when(F.col("estimator") == e, F.col(c))).alias(f"{e}_{c}")
        for e in ESTIMATORS for c in ("lower_95", "upper_95", "bootstrap_standard_error")
    ])
    on_policy = truth.agg(F.avg(F.col("reward").cast("double")).alias("v")).scalar()
    n = F.col("n_rounds")

    def setting(i: int, clip: float | None) -> Column:
        def cut(value: Column) -> Column:
            return value if clip is None else F.least(value, F.lit(float(clip)))

        def percentile(name: str) -> Column:
            low, high = cut(F.col(f"{name}_a")), cut(F.col(f"{name}_b"))
            return low + (high - low) * (places[name] - F.floor(places[name]))

        mean = F.col(f"_w{i}") / n
        return F.struct(
            F.lit(i).alias("clip"), F.lit(clip).cast("double").alias("clip_value"),
            *[value.alias(name) for name, value in _estimates(n, i).items()],
            cut(F.col("_lo")).alias("weight_minimum"), mean.alias("weight_mean"),
            F.sqrt(F.greatest(F.col(f"_ww{i}") / n - mean * mean, F.lit(0.0))).alias("weight_standard_deviation"),
            percentile("_p95").alias("weight_p95"), percentile("_p99").alias("weight_p99"), cut(F.col("_hi")).alias("weight_maximum"),
            (F.col(f"_w{i}") * F.col(f"_w{i}") / F.greatest(F.col(f"_ww{i}"), F.lit(1e-12))).alias("effective_sample_size"),
            (F.col(f"_cut{i}") / n).alias("clipped_fraction"),
        )

    each = sums.join(points, ["seed", "_f"]).withColumn("_s", F.explode(F.array(*[setting(i, c) for i, c in enumerate(clips)])))
    fraction = F.element_at(F.lit([float(f) for f in fractions]), F.col("_f") + 1)
    estimates = each.select("seed", "_f", fraction.alias("fraction"), "n_rounds", "_s.*").join(intervals, ["seed", "_f", "clip"]).drop("_f", "clip")
    errors = {}
    for name in ESTIMATORS:
        errors[f"{name}_absolute_error"] = F.abs(F.col(name) - on_policy)
        errors[f"{name}_relative_error"] = F.abs(F.col(name) - on_policy) / F.greatest(F.abs(on_policy), F.lit(1e-12))
    return estimates.withColumns(errors)
