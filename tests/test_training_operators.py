"""Weights, off-policy estimates, negatives, fits and streams."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from exposura.operators import bootstrap, contexts, density, negatives, ope, ranker, weights as wt
from exposura.sources import bandit as source, embeddings
from exposura.streaming import log_stream
from tests.conftest import rows

BANDIT = "round_id long, context array<double>, action int, reward double, pscore double"


@pytest.fixture(scope="module")
def bandit(spark):
    """A log whose value under the uniform policy is known: reward probability depends on the action only."""
    rng = random.Random(1)
    behavior, reward = [0.5, 0.3, 0.2], [0.2, 0.5, 0.8]
    data = []
    for i in range(6000):
        a = rng.choices(range(3), behavior)[0]
        data.append((i, [rng.random()], a, float(rng.random() < reward[a]), behavior[a]))
    df = spark.createDataFrame(data, BANDIT).withColumn("prediction", F.lit([0.2, 0.5, 0.8]))
    return ope.uniform_policy(df, 3).persist()


def test_estimators_find_the_known_value(bandit):
    row = ope.policy_value(bandit).first()
    for name in ope.ESTIMATORS:
        assert row[name] == pytest.approx(0.5, abs=0.03)
    assert row["dm"] == pytest.approx(0.5) and row["n_rounds"] == 6000
    spread = {r["estimator"]: r for r in ope.bootstrap_policy_value(bandit, samples=100).collect()}
    assert spread["ips"]["lower_95"] < row["ips"] < spread["ips"]["upper_95"]
    assert spread["dm"]["bootstrap_standard_error"] == pytest.approx(0, abs=1e-9)


def test_target_equal_to_behavior_and_perfect_prediction(spark):
    df = spark.createDataFrame([(0, [0.0], 0, 1.0, 0.5), (1, [0.0], 1, 0.0, 0.5)], BANDIT).withColumn("target", F.lit([0.5, 0.5]))
    row = ope.policy_value(df.withColumn("prediction", F.lit([1.0, 0.0]))).first()
    assert (row["ips"], row["snips"], row["dr"], row["dm"], row["effective_sample_size"]) == (0.5, 0.5, 0.5, 0.5, 2.0)


@pytest.mark.parametrize(
    "change", [("pscore", 0.0), ("pscore", 1.5), ("action", 3), ("target", [0.5, 0.4, 0.0]), ("reward", float("nan"))]
)
def test_bad_rounds_raise(bandit, change):
    with pytest.raises(Exception):
        ope.policy_value(bandit.limit(5).withColumn(change[0], F.lit(change[1]))).collect()


def test_bandit_audit_counts_each_rule(spark):
    df = spark.createDataFrame([(0, [0.0], 0, 1.0, 0.5), (1, [0.0, 1.0], 5, float("inf"), 0.0), (2, [float("nan")], 1, 0.0, 1.0)], BANDIT)
    row = source.bandit_audit(df, 3).first()
    assert (row["action_out_of_range"], row["context_not_finite"], row["reward_not_finite"], row["pscore_invalid"], row["valid"]) == (1, 1, 1, 1, False)
    with pytest.raises(Exception, match="bandit feedback"):
        source.checked_bandit(df, 3).collect()


def test_reward_models(bandit):
    row = ope.mean_reward_by_action(bandit.where("action < 2"), 3).first()["prediction"]
    assert row[0] == pytest.approx(0.2, abs=0.05) and row[1] == pytest.approx(0.5, abs=0.05) and row[0] < row[2] < row[1]
    found = ope.logistic_reward_model(bandit.drop("prediction"), bandit.drop("prediction"), 3).first()["prediction"]
    assert found == pytest.approx([0.2, 0.5, 0.8], abs=0.06)
    flat = ope.logistic_reward_model(bandit.withColumn("reward", F.lit(1.0)), bandit, 3).first()["prediction"]
    assert flat == [1.0, 1.0, 1.0]


def test_shuffled_halves_are_disjoint_and_complete(bandit):
    halves = ope.shuffled_halves(bandit.limit(101), [1, 2])
    counts = rows(halves.groupBy("seed", "half").count())
    assert counts == [(1, "evaluate", 51), (1, "fit", 50), (2, "evaluate", 51), (2, "fit", 50)]
    assert halves.where("half = 'evaluate'").select("seed", "pool_position").distinct().count() == 102


def test_weight_rules(spark):
    ones = spark.createDataFrame([(1.0,)] * 4, "weight double")
    assert wt.weight_diagnostics(ones).first()["effective_sample_size"] == 4.0
    assert wt.weight_diagnostics(ones.withColumn("weight", F.lit(0.0))).first()["effective_sample_size"] == 0.0
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="negative or not a number"):
            wt.weight_diagnostics(ones.withColumn("weight", F.lit(bad))).collect()
    with pytest.raises(Exception, match="at least one row"):
        wt.weight_diagnostics(ones.limit(0)).collect()
    q = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "domain_probability double")
    found = [r["weight"] for r in wt.density_weights(q, 0.5, 10.0).orderBy("domain_probability").collect()]
    assert found == pytest.approx([1e-5 / (1 - 1e-5), 1.0, 10.0])
    assert wt.density_weights(q, 0.3, 10.0, True).agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        wt.density_weights(q, 0.3, 0.0)


def test_bootstrap_covers_the_mean_and_repeats(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v"))
    first, second = (bootstrap.bootstrap_mean(df, "id", "v", 200).first() for _ in range(2))
    assert first == second and first["lower_95"] < 4.5 < first["upper_95"]
    assert first["bootstrap_standard_error"] == pytest.approx(2.87 / 200 ** 0.5, rel=0.2)
    large = bootstrap.bootstrap_means(df, "id", "v", 20, min_rows=10)
    assert rows(large) == rows(bootstrap.bootstrap_means(df, "id", "v", 20))


def test_draws_are_dealt_over_slices_without_losing_any():
    for units, size in ((1, 10), (95, 10), (1000, 7), (40, 40)):
        slices = range(-(-units // size))
        dealt = np.array([bootstrap.draws_of_slice(200, units, size, part, 5) for part in slices])
        assert (dealt >= 0).all() and (dealt.sum(axis=0) == units).all()
        widths = np.array([min((part + 1) * size, units) - part * size for part in slices])
        assert np.abs(dealt.mean(axis=1) - widths).max() < 6 * (widths.max() / 200) ** 0.5
    places = bootstrap.draw_places(42, 3, 0, 20_000, 10)
    assert places.min() == 0 and places.max() == 9 and np.abs(np.bincount(places) / 2000 - 1).max() < 0.1


def test_bootstrap_of_groups_is_that_of_each_group_whatever_the_slices(spark):
    data = [(g, i, float((i * 7 + len(g)) % 11) if i % 9 else None) for g in ("a", "bb", "ccc") for i in range(90 if g == "a" else 300)]
    df = spark.createDataFrame(data, "g string, id long, v double").repartition(5)
    whole = rows(bootstrap.bootstrap_means(df, "id", "v", 40, by=["g"]))
    for g in ("a", "bb", "ccc"):
        alone = rows(bootstrap.bootstrap_means(df.where(F.col("g") == g), "id", "v", 40))
        assert alone == [r[1:] for r in whole if r[0] == g]
    cut = bootstrap.bootstrap_means(df, "id", "v", 400, by=["g"], slice_units=16).groupBy("g").agg(
        F.avg("replicate_mean"), F.stddev("replicate_mean"), F.count("*")).collect()
    plain = {r["g"]: r for r in df.groupBy("g").agg(F.avg("v"), F.stddev("v"), F.count("v")).collect()}
    for g, mean, spread, n in cut:
        _, truth, deviation, count = plain[g]
        assert n == 400 and abs(mean - truth) < 4 * deviation / count ** 0.5 / 20 + 0.05
        assert spread == pytest.approx(deviation / count ** 0.5, rel=0.2)


def test_paired_bootstrap_of_all_pairs(spark):
    per_group = spark.createDataFrame(
        [(m, d, u, 10, u * w) for m, w in (("x", 1.0), ("y", 2.0), ("z", 4.0)) for d in ("s", "r") for u in range(1, 40) if (m, u) != ("z", 7)],
        "model string, domain string, user_id long, k int, ndcg double",
    )
    out = {(r.domain, r.left_model, r.right_model): r for r in bootstrap.paired_bootstrap_of_all(per_group, by=["domain"], samples=100).collect()}
    assert sorted(out) == [(d, a, b) for d in ("r", "s") for a, b in (("x", "y"), ("x", "z"), ("y", "z"))]
    assert out["s", "x", "y"].n_users == 39 and out["s", "x", "z"].n_users == 38
    for (d, a, b), r in out.items():
        one = bootstrap.paired_user_bootstrap(per_group.where(f"model = '{a}' and domain = '{d}'"), per_group.where(f"model = '{b}' and domain = '{d}'"), samples=100).first()
        assert (r.mean_difference, r.ci_low, r.ci_high) == pytest.approx((one.mean_difference, one.ci_low, one.ci_high))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    data = [(rng.randint(1, 5), rng.randint(1, 12), t // 3, int(rng.random() < 0.4), 0) for t in range(400)]
    return spark.createDataFrame(data, "user_id long, item_id long, timestamp_ms long, long_view int, is_random int").persist()


@pytest.fixture
def sparse_log(spark):
    """Every user has an item left that they do not know, at any time; some know all but one."""
    rng = random.Random(21)
    data = [(rng.randint(1, 5), rng.randint(1, 12), t // 3, int(rng.random() < 0.4), 0) for t in range(300)]
    data = [r for r in data if r[1] != 2 * r[0]]
    data += [(6, i, 200 + i, 1, 0) for i in range(1, 12)]
    return spark.createDataFrame(data, "user_id long, item_id long, timestamp_ms long, long_view int, is_random int").persist()


@pytest.mark.parametrize("strategy", negatives.STRATEGIES)
@pytest.mark.parametrize("attempts", [1, 32])
def test_negatives_are_never_known_positives(sparse_log, strategy, attempts):
    data = sparse_log.collect()
    first, shown = {}, {}
    for r in data:
        key = (r.user_id, r.item_id)
        table = first if r.long_view else shown
        table[key] = min(table.get(key, 10**9), r.timestamp_ms)
    found = negatives.sample_negatives(sparse_log, strategy, attempts=attempts).collect()
    assert len(found) == len(first)
    for r in found:
        assert r.negative_item != r.item_id
        assert first.get((r.user_id, r.negative_item), 10**9) >= r.timestamp_ms
        pool = [i for (u, i), t in shown.items() if u == r.user_id and t < r.timestamp_ms and i != r.item_id and first.get((u, i), 10**9) >= r.timestamp_ms]
        if strategy.startswith("exposed"):
            assert (r.source == "exposed") == bool(pool) and (not pool or r.negative_item in pool)
        else:
            assert r.source == strategy


@pytest.mark.parametrize("strategy", negatives.STRATEGIES)
def test_a_target_without_any_negative_is_an_error(spark, strategy):
    data = [(1, i, i, 1, 0) for i in range(1, 5)] + [(2, 1, 1, 1, 0)]
    everything = spark.createDataFrame(data, "user_id long, item_id long, timestamp_ms long, long_view int, is_random int")
    with pytest.raises(Exception, match="no valid negative"):
        negatives.sample_negatives(everything, strategy).collect()


def test_triples_never_use_an_item_the_user_ever_liked(log):
    distinct = log.dropDuplicates(["user_id", "timestamp_ms", "item_id"]).persist()
    data = distinct.collect()
    liked = {(r.user_id, r.item_id) for r in data if r.long_view}
    for r in negatives.ranking_triples(distinct).collect():
        assert (r.user_id, r.negative_item) not in liked
        before = [x.item_id for x in data if x.user_id == r.user_id and not x.long_view and (x.timestamp_ms, x.item_id) < (r.timestamp_ms, r.item_id) and (x.user_id, x.item_id) not in liked]
        assert r.source == ("exposed" if before else "catalog") and (not before or r.negative_item in before)


def test_domain_classifier_separates_and_weights(spark):
    rng = random.Random(4)
    schema = "user_id long, item_id long, timestamp_ms long, tab int, hour double"
    standard = spark.createDataFrame([(i, i, i, rng.choice([0, 0, 1]), rng.gauss(0, 1)) for i in range(600)], schema)
    randomized = spark.createDataFrame([(i, i, i, rng.choice([0, 1, 1, 2]), rng.gauss(1, 1)) for i in range(600)], schema)
    model = density.fit_domain_classifier(standard, randomized)
    assert 0.7 < model.validation_auc < 0.95 and model.random_prior == pytest.approx(0.5, abs=0.01)
    unseen = standard.withColumn("tab", F.lit(99))
    weighted = wt.density_weights(model.probabilities(unseen), model.random_prior)
    assert weighted.where("weight > 0").count() == 600
    with pytest.raises(ValueError, match="fitted on columns"):
        model.probabilities(standard.drop("hour"))


def test_ranker_learns_an_easy_order(spark):
    rng = random.Random(6)
    data = []
    for c in range(60):
        for i in range(8):
            x = rng.random()
            data.append((f"c{c}", i, i + 1, x, rng.random(), int(x > 0.7)))
    df = spark.createDataFrame(data, "context_id string, item_id long, retrieval_rank int, a double, b double, label int")
    model = ranker.fit_linear_ranker(df, ("a", "b"))
    assert model.model.coefficients[0] > 5 * abs(model.model.coefficients[1])
    assert [r["feature"] for r in model.feature_importance(df).collect()] == ["a", "b"]
    sizes = ranker.group_sizes(df)
    assert sizes.agg(F.sum("rows")).first()[0] == df.count()
    probability = ranker.fit_probability_model(df, df, ("a", "b"), trees=3, depth=2).predict(df)
    low, high = probability.agg(F.min("probability"), F.max("probability")).first()
    assert 1e-6 <= low < 0.2 and 0.8 < high <= 1 - 1e-6


def test_embedding_tables(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, embedding array<double>")
    embeddings.write_embeddings(good, f"{tmp_path}/e", "item_id")
    assert embeddings.read_embeddings(spark, f"{tmp_path}/e", "item_id").first()["embedding"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        embeddings.write_embeddings(good.unionByName(good), f"{tmp_path}/f", "item_id")


def test_stream_quarantine_and_sessions(spark, tmp_path):
    data = [(1, 0, 0, 1, 0), (1, 1, 0, 1, 60_000), (2, 7, 1, 0, 0), (2, 1, 1, 0, 7_200_000)]
    df = spark.createDataFrame(data, "user_id long, is_random int, expected_random int, long_view int, timestamp_ms long")
    df.write.parquet(f"{tmp_path}/in")
    stream = log_stream.read_log_stream(spark, f"{tmp_path}/in", df.schema, files_per_batch=1)
    log_stream.start_quarantine(stream, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 2
    whole = log_stream.read_log_stream(spark, f"{tmp_path}/in", df.schema)  # one batch: nothing is late
    query = (
        log_stream.streaming_sessions(whole).writeStream.format("memory").queryName("sessions").outputMode("complete")
        .option("checkpointLocation", f"{tmp_path}/sessions").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("sessions"), "user_id", "rows") == [(1, 2), (2, 1), (2, 1)]


def test_stream_sessions_are_the_batch_sessions(spark, tmp_path):
    limit, rng = 30 * 60_000, random.Random(4)
    data, at = [], 0
    for i in range(120):
        at += rng.choice((limit, limit + 1, limit - 1, 5, 0))  # a gap of exactly the limit does not end a session
        data.append((i % 3 and 1, i, at, i % 2))
    frame = spark.createDataFrame(data, "user_id long, item_id long, timestamp_ms long, long_view int")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = log_stream.read_log_stream(spark, f"{tmp_path}/in", frame.schema)
    found = log_stream.run_to_table(log_stream.streaming_sessions(stream, 30), "complete")
    batch = contexts.ranking_contexts(frame, 30, 10_000).groupBy("user_id", "context_id").agg(
        F.min("timestamp_ms").alias("started_ms"), F.max("timestamp_ms").alias("ended_ms"), F.count("*").alias("rows"), F.sum("long_view").alias("positives")
    ).drop("context_id")
    assert rows(found, *batch.columns) == rows(batch) and found.count() > 10
    daily = log_stream.run_to_table(log_stream.streaming_sketches(stream, ["long_view"]), "complete")
    total = log_stream.merged_counts(daily).first()
    assert total.rows == 120 and total.users == 2 and abs(total["items"] - 120) <= 6


def test_every_category_level_keeps_its_own_weight(spark):
    """More levels than any fixed list would hold; nulls count as the most frequent level, unseen levels have no effect."""
    schema = "user_id long, item_id long, timestamp_ms long, tab int"
    standard = spark.createDataFrame([(i, i, i, i % 1200) for i in range(12_000)], schema)
    randomized = spark.createDataFrame([(i, i, i, (i % 600) * 2 if i % 3 else 7) for i in range(12_000)], schema)
    model = density.fit_domain_classifier(standard, randomized, max_iter=20)
    assert model.levels["tab"].where("shown = level").count() > 1100  # a few have under five rows left in training
    probe = spark.createDataFrame([(0, 0, 0, 1100), (1, 0, 0, 1101), (2, 0, 0, None), (3, 0, 0, 7), (4, 0, 0, 999_999), (5, 0, 0, 888_888)], schema)
    p = {r.user_id: r.domain_probability for r in model.probabilities(probe).collect()}
    assert p[0] > p[1] + 0.1 and abs(p[2] - p[3]) < 1e-12 and p[4] == p[5]


def test_a_reward_model_needs_rounds_with_binary_rewards(spark):
    schema = "round_id long, action int, reward double, context array<double>"
    rounds = spark.createDataFrame([(0, 0, 0.5, [1.0]), (1, 1, 1.0, [0.0])], schema)
    with pytest.raises(ValueError, match="0 and 1 only"):
        ope.logistic_reward_model(rounds, rounds, 2)
    with pytest.raises(ValueError, match="no rounds"):
        ope.logistic_reward_model(rounds.limit(0), rounds, 2)


def _graded_contexts(spark, contexts=60, size=14):
    """Labels go by x within a context; contexts with a high level of x have fewer positives, which misleads row by row."""
    rng, data = random.Random(31), []
    for c in range(contexts):
        level = rng.uniform(-40, 40)
        own = sorted(rng.gauss(0, 1) for _ in range(size))
        top = 2 if level > 0 else 9
        for i, x in enumerate(own):
            label = 0 if i < size - top else 1 if i < size - 1 else 2
            data.append((f"c{c}", c * 100 + i, label, rng.random(), level + x, rng.gauss(0, 1)))
    frame = spark.createDataFrame(data, "context_id string, item_id long, label int, u double, x double, noise double")
    order = Window.partitionBy("context_id").orderBy("u")
    return frame.withColumn("retrieval_rank", F.row_number().over(order)).drop("u").repartition(6).persist()


def test_pairwise_ranker_learns_an_order_that_holds_within_contexts_only(spark):
    rows_ = _graded_contexts(spark)

    def right(model):
        scored = model.predict(rows_)
        pairs = scored.alias("a").join(scored.alias("b"), (F.col("a.context_id") == F.col("b.context_id")) & (F.col("a.label") > F.col("b.label")))
        return pairs.agg(F.avg((F.col("a.score") > F.col("b.score")).cast("double"))).first()[0]

    assert right(ranker.fit_pairwise_ranker(rows_, ["x", "noise"])) > 0.95
    assert right(ranker.fit_linear_ranker(rows_, ["x", "noise"])) < 0.6


@pytest.mark.parametrize("opponents,pool", [(3, 4), (100, 100)])
def test_pairwise_rows_are_bounded_and_stand_for_all_pairs(spark, opponents, pool):
    frame = _graded_contexts(spark, 12)
    pairs = ranker.pairwise_rows(frame, ["x"], opponents=opponents, pool=pool, depth=6).collect()
    data = {}
    for r in frame.collect():
        data.setdefault(r.context_id, []).append(r)
    met, total = {}, 0.0
    for p in pairs:
        met.setdefault((p.context_id, p.winner_item), []).append(p)
    for context, own in data.items():
        ideal = sum((2 ** y - 1) / math.log2(i + 2) for i, y in enumerate(sorted((r.label for r in own), reverse=True)[:6]))
        at = {r.item_id: (r.label, 1 / math.log2(r.retrieval_rank + 1) if r.retrieval_rank <= 6 else 0.0, r.x) for r in own}
        for w in own:
            below = [r for r in own if r.label < w.label]
            drawn = met.get((context, w.item_id), [])
            assert len(drawn) == len({p.loser_item for p in drawn}) == min(opponents, len(below), sum(min(pool, n) for n in Counter(r.label for r in below).values()))
            for p in drawn:
                low = at[p.loser_item]
                delta = (2 ** w.label - 2 ** low[0]) * abs(at[w.item_id][1] - low[1]) / ideal
                assert (p.winner_label, p.loser_label) == (w.label, low[0]) and p.d_x == pytest.approx(w.x - low[2])
                assert p.delta_ndcg == pytest.approx(delta) and p.pair_weight == pytest.approx(delta * len(below) / len(drawn))
    flat = frame.withColumn("label", F.lit(1))
    assert ranker.pairwise_rows(flat, ["x"]).collect() == [] and ranker.pairwise_rows(frame.limit(0), ["x"]).collect() == []


def test_poisson_replicates_do_not_hang_on_partitions_or_groups(spark):
    frame = spark.range(3000).select("id", (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1).alias("y"))
    sums = {"sx": F.col("x"), "sy": F.col("y")}
    whole = {r.replicate: r for r in bootstrap.poisson_replicates(frame.repartition(3), "id", sums, samples=60).collect()}
    parts = bootstrap.poisson_replicates(frame.repartition(11), "id", sums, ["g"], 60).groupBy("replicate").agg(
        F.sum("_n").alias("_n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).collect()
    assert len(whole) == len(parts) == 60 and all((whole[r.replicate]._n, whole[r.replicate].sx, whole[r.replicate].sy) == (r._n, r.sx, r.sy) for r in parts)
    sizes = np.array([r._n for r in whole.values()])
    assert abs(sizes.mean() - 3000) < 30 and 30 < sizes.std() < 85  # about the square root of 3000
    by_text = bootstrap.poisson_replicates(frame.withColumn("id", F.concat(F.lit("r"), "id")), "id", sums, samples=5).collect()
    assert all(abs(r._n - 3000) < 300 for r in by_text)


@pytest.mark.parametrize("model", ope.REWARD_MODELS)
def test_study_of_one_setting_is_the_plain_estimate(spark, bandit, model):
    behavior, truth = bandit.drop("target", "prediction").where("round_id < 2000"), bandit.where("round_id >= 2000")
    study = ope.ope_study(behavior, truth, 3, seeds=(5, 6), fractions=(0.3, 1.0), clips=(None, 1.0), reward_model=model, samples=50)
    found = {(r.seed, r.fraction, r.clip_value): r for r in study.collect()}
    assert len(found) == 8
    for (seed, fraction, clip), r in found.items():
        halves = ope.shuffled_halves(behavior, [seed])
        rounds = ope._modelled(halves, 3, [seed], model).where(F.col("pool_position") < round(1000 * fraction))
        plain = ope.policy_value(ope.uniform_policy(rounds, 3), clip).first()
        assert r.n_rounds == plain.n_rounds == round(1000 * fraction)
        assert [r[e] for e in ope.ESTIMATORS] == pytest.approx([plain[e] for e in ope.ESTIMATORS])
        assert (r.effective_sample_size, r.weight_mean, r.weight_maximum) == pytest.approx((plain.effective_sample_size, plain.weight_mean, plain.weight_max))
        assert all(r[f"{e}_lower_95"] <= r[e] <= r[f"{e}_upper_95"] or abs(r[e] - r[f"{e}_lower_95"]) < 1e-9 for e in ope.ESTIMATORS)
    with pytest.raises(ValueError, match="reward models"):
        ope.ope_study(behavior, truth, 3, reward_model="forest")


@pytest.mark.parametrize("depth", [1, 3, 100])
def test_hard_negatives_serve_every_target_that_any_item_is_left_for(spark, depth):
    rng = random.Random(12)
    vectors = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(1, 13)}
    users = {u: [rng.gauss(0, 1) for _ in range(3)] for u in range(1, 7)}
    log = [(u, i, rng.randint(1, 60), int(rng.random() < 0.6), 0) for u in (1, 2, 3, 9) for i in range(1, 13)]
    log += [(4, i, i, 1, 0) for i in range(1, 13)] + [(5, i, 7, 1, 0) for i in range(1, 12)]  # all of the catalog, all but one
    train = spark.createDataFrame(log, "user_id long, item_id long, timestamp_ms long, long_view int, is_random int")
    out = negatives.hard_negatives(
        train, spark.createDataFrame(list(users.items()), "user_id long, embedding array<double>"),
        spark.createDataFrame(list(vectors.items()), "item_id long, embedding array<double>"), depth,
    ).collect()
    first = {}
    for u, i, t, y, _ in log:
        if y and u in users:
            first[u, i] = min(t, first.get((u, i), t))
    expected = []
    for (u, i), t in first.items():
        order = sorted(vectors, key=lambda x: (-sum(a * b for a, b in zip(users[u], vectors[x])), x))
        left = [(r, x) for r, x in enumerate(order, 1) if x != i and first.get((u, x), t) >= t]
        expected += [(u, i, t, left[0][1], left[0][0])] if left else []
    assert sorted(map(tuple, out)) == sorted(expected)
    assert sum(r.user_id == 4 for r in out) == 11 and sum(r.user_id == 5 for r in out) == 11


def test_contexts_of_two_widths_are_refused(spark):
    rounds = spark.createDataFrame([(0, [0.0], 0, 1.0, 0.5), (1, [0.0, 1.0], 1, 1.0, 0.5)], BANDIT)
    with pytest.raises(Exception, match="more than one width"):
        source.checked_bandit(rounds, 3).collect()
    assert source.checked_bandit(rounds.limit(1), 3).count() == 1


def test_calibration_is_fitted_on_counted_scores(spark, monkeypatch):
    """equal scores of the validation rows are one weighted row, and the fit is that of all rows."""
    df = spark.range(600).selectExpr("cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "cast(id % 7 < id % 5 as int) as label")
    seen, fit = [], ranker.IsotonicRegression.fit
    monkeypatch.setattr(ranker.IsotonicRegression, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    model = ranker.fit_probability_model(df, df, ("a", "b"), trees=3, depth=2)
    assert seen[0] <= 15
    raw = ranker._raw_probability(model.classifier, ranker._assembled(df, ("a", "b"))).selectExpr("cast(label as double) as y", "_raw")
    rows = fit(ranker.IsotonicRegression(featuresCol="_raw", labelCol="y"), raw)
    assert np.allclose(model.calibrator.boundaries.toArray(), rows.boundaries.toArray())
    assert np.allclose(model.calibrator.predictions.toArray(), rows.predictions.toArray())
