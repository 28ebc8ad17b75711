"""The sliced paths must equal the plain ones; here every table counts as large and every key as hot."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposura import session
from exposura.functions import scale
from exposura.functions.columns import bind, l2_normalize, uniform_hash
from exposura.operators import contexts, history, negatives, reports
from exposura.operators.probability import ranking_areas
from tests.conftest import rows

HOT = {"min_rows": 5, "share": 0.0, "slice_width": 1000}


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    data = [
        # user 1 holds a third of all rows; timestamps collide often
        (i, 1 if i % 3 == 0 else rng.randint(2, 9), rng.randint(0, 6), rng.randint(0, 60) * 200, rng.randint(0, 1), 0)
        for i in range(240)
    ]
    return spark.createDataFrame(data, "event_id long, user_id long, item_id long, timestamp_ms long, long_view int, is_random int").persist()


def test_hot_keys_are_bounded_by_share(spark, log):
    assert rows(scale.hot_keys(log, ["user_id"], 5, 0.3)) == [(1,)]
    assert scale.find_hot_keys(log, ["user_id"], 5, 0.9) is None


def test_earlier_totals_sliced_equals_plain(log):
    def run(**more):
        return rows(scale.earlier_totals(log, ["user_id"], "timestamp_ms", {"n": F.lit(1), "p": F.col("long_view")}, **more), "event_id", "n", "p")

    plain = run()
    assert run(**HOT) == plain
    brute = []
    data = log.collect()
    for r in data:
        earlier = [x for x in data if x.user_id == r.user_id and x.timestamp_ms < r.timestamp_ms]
        brute.append((r.event_id, len(earlier), sum(x.long_view for x in earlier)))
    assert plain == sorted(brute, key=repr)


def test_earlier_totals_inclusive(log):
    plain = rows(scale.earlier_totals(log, ["user_id"], "timestamp_ms", {"n": F.lit(1)}, inclusive=True), "event_id", "n")
    assert rows(scale.earlier_totals(log, ["user_id"], "timestamp_ms", {"n": F.lit(1)}, inclusive=True, **HOT), "event_id", "n") == plain


def test_recent_activity_sliced_equals_plain(log):
    tagged = log.withColumn("category", (F.col("item_id") % 2).cast("string"))
    columns = ("event_id", "recent_events", "recent_positives", "is_novel", "ms_since_category")
    plain = rows(history.recent_activity(tagged, 3000), *columns)
    assert rows(history.recent_activity(tagged, 3000, **HOT), *columns) == plain
    data = tagged.collect()
    for event, events, positives, novel, since in plain:
        r = next(x for x in data if x.event_id == event)
        past = [x for x in data if x.user_id == r.user_id and r.timestamp_ms - 3000 <= x.timestamp_ms < r.timestamp_ms]
        same = [x.timestamp_ms for x in data if x.user_id == r.user_id and x.category == r.category and x.timestamp_ms < r.timestamp_ms]
        assert (events, positives) == (len(past), sum(x.long_view for x in past))
        assert since == (r.timestamp_ms - max(same) if same else None)


def test_contexts_sliced_equals_plain(log):
    distinct = log.dropDuplicates(["user_id", "timestamp_ms", "item_id"])
    columns = ("event_id", "session_position", "context_id")
    distinct = distinct.persist()
    for gap in (1, 30):
        plain = rows(contexts.ranking_contexts(distinct.withColumn("timestamp_ms", F.col("timestamp_ms") * 100), gap, 5), *columns)
        sliced = contexts.ranking_contexts(
            distinct.withColumn("timestamp_ms", F.col("timestamp_ms") * 100), gap, 5, min_rows=5, share=0.0, slice_width=50_000
        )
        assert rows(sliced, *columns) == plain


def test_history_sliced_equals_plain(log):
    columns = ("event_id", "hist_item_exposure", "hist_user_exposure", "hist_item_reward_rate", "hist_user_long_view_rate")
    assert rows(history.historical_features(log, 2.0, **HOT), *columns) == rows(history.historical_features(log, 2.0), *columns)
    pit = rows(history.point_in_time_aggregates(log, log, 2.0), *columns)
    assert rows(history.point_in_time_aggregates(log, log, 2.0, **HOT), *columns) == pit
    assert pit == rows(history.historical_features(log, 2.0), *columns)  # a log as its own history


def test_user_history_sliced_equals_plain(log):
    for length in (1, 3, 10):
        plain = rows(negatives.user_history(log, length))
        assert rows(negatives.user_history(log, length, slice_width=1000, min_rows=5, share=0.0)) == plain


def test_negative_rules_sliced_equal_plain(log):
    assert rows(negatives.negative_pools(log, **HOT)) == rows(negatives.negative_pools(log))
    distinct = log.dropDuplicates(["user_id", "timestamp_ms", "item_id"]).persist()
    assert rows(negatives.ranking_triples(distinct, **HOT)) == rows(negatives.ranking_triples(distinct))


def test_running_totals_and_positions_sliced(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([1, 1, 1, 2, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, v long")
    expected = sorted(data, key=lambda r: (-r[1], r[0]))
    want = sorted(((i, v, place + 1) for place, (i, v) in enumerate(expected)), key=repr)
    for limit in (10, 10_000):
        got = rows(scale.ordered_position(df, -F.col("v"), "id", min_rows=limit), "id", "v", "position")
        assert got == want
    sums = {r["id"]: r["before"] for r in scale.running_totals(df, F.col("id"), {"before": F.col("v")}, min_rows=10).collect()}
    total = 0
    for i, v in data:
        assert sums[i] == total
        total += v


@pytest.mark.parametrize("limit", [3, 10_000])
def test_percentiles_equal_numpy(spark, limit):
    values = [0.5, 1.5, 1.5, 2.0, 8.0, 13.0, 13.0, 40.0, 41.0]
    df = spark.createDataFrame([(x,) for x in values], "w double")
    row = scale.exact_percentiles(df, "w", {"a": 0, "b": 1, "c": 50, "d": 95, "e": 100}, min_rows=limit).first()
    assert list(row) == pytest.approx([np.percentile(values, p) for p in (0, 1, 50, 95, 100)])


def test_gini_areas_and_cohorts_sliced_equal_plain(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([1, 1, 2, 7]), rng.random(), rng.randint(0, 1)) for i in range(120)]
    df = spark.createDataFrame(data, "item_id long, c long, probability double, label int")
    for small, large in (
        (reports.gini(df, "c").first()[0], reports.gini(df, "c", min_rows=1).first()[0]),
        (ranking_areas(df).first()[0], ranking_areas(df, min_rows=5).first()[0]),
        (ranking_areas(df).first()[1], ranking_areas(df, min_rows=5).first()[1]),
    ):
        assert small == pytest.approx(large)
    train = df.select("item_id", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("x"))
    assert rows(reports.item_cohorts(train)) == rows(reports.item_cohorts(train, min_rows=5))


def test_uniform_hash_is_stable_and_spread(spark):
    values = [r[0] for r in spark.range(2000).select(uniform_hash(F.col("id"), "x", 1)).collect()]
    assert values == [r[0] for r in spark.range(2000).repartition(7).orderBy("id").select(uniform_hash(F.col("id"), "x", 1)).collect()]
    assert 0 <= min(values) and max(values) < 1 and abs(np.mean(values) - 0.5) < 0.03


def test_bind_and_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert spark.range(1).select(bind(F.lit(2), lambda x: x * x)).first()[0] == 4


def test_tied_rows_of_a_hot_key_are_one_moment(spark):
    data = [(1, 5, i % 3) for i in range(60)] + [(1, 6, 1)] * 10 + [(2, t, 1) for t in range(8)]
    frame = spark.createDataFrame(data, "user_id long, timestamp_ms long, v long")
    measures = {"seen": F.lit(1), "total": F.col("v")}
    for inclusive in (False, True):
        plain = rows(scale.earlier_totals(frame, ["user_id"], "timestamp_ms", measures, inclusive))
        assert rows(scale.earlier_totals(frame, ["user_id"], "timestamp_ms", measures, inclusive, slice_width=2, min_rows=5)) == plain


def test_more_slices_than_any_fixed_number(spark):
    frame = spark.range(1200).select((F.col("id") * 7 % 1200).alias("x"), F.lit(2).alias("v"))
    got = scale.running_totals(frame, F.col("x"), {"below": F.col("v")}, min_rows=3)
    assert got.where("below != 2 * x").count() == 0 and got.count() == 1200
    points = scale.exact_percentiles(frame, "x", {"p50": 50, "p99": 99}, min_rows=3).first()
    assert (points.p50, round(points.p99, 6)) == (599.5, 1187.01)


def test_stored_intermediates_can_be_released(spark):
    import os

    session.release_stored(spark)
    kept = session.materialize(spark.range(5))
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and kept.count() == 5
    assert session.release_stored(spark) == 1 and not os.path.exists(folder)


def test_a_stored_table_leaves_no_shuffle_files_and_can_be_discarded(spark):
    """shuffle files stayed until the driver collected garbage, and stored tables to the end of the query."""
    import os

    def shuffles():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString("\n").count("shuffle_")

    before, setting = shuffles(), spark.conf.get(session._SHUFFLE_CLEANUP)
    kept, gone = (session.materialize(spark.range(1000).repartition(3, "id")) for _ in range(2))
    for _ in range(50):  # they are removed in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(session._SHUFFLE_CLEANUP) == setting
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    session.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 1000


def test_history_is_not_shuffled_to_a_small_prior(spark):
    data = [(i, i % 11, i % 7, (i % 5) * 1000, i % 2) for i in range(400)]  # many rows at few moments
    log = session.materialize(spark.createDataFrame(data, "event_id long, user_id long, item_id long, timestamp_ms long, long_view int"))
    features = history.historical_features(log)
    assert features.count() == 400
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(timestamp_ms" not in plan and "BroadcastHashJoin [timestamp_ms" in plan
