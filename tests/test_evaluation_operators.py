"""Metrics, reports, reranking, retrieval and candidates on hand-made rows and against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exposura import session
from exposura.operators import candidates as cand, inverted_lists, popularity as pop, probability as prob, ranking_metrics as rm, reports, rerank, retrieval
from exposura.plans import workflows
from tests.conftest import rows

PRED = "context_id string, user_id long, item_id long, date int, long_view int, score double"


def test_user_date_groups_and_eligibility(spark):
    df = spark.createDataFrame([(1, 1, 20220422, 1, 0.9), (1, 2, 20220422, 0, 0.8), (2, 3, 20220422, 0, 0.7)], "user_id long, item_id long, date int, long_view int, score double")
    row = rm.ranking_metrics(df, (1,)).first()
    assert (row["ndcg"], row["recall"], row["mrr"], row["eligible_groups"], row["eligible_rows"]) == (1.0, 1.0, 1.0, 1, 2)


def test_ties_go_to_the_smaller_item_and_positives_beyond_k(spark):
    df = spark.createDataFrame([("c", 1, i, 1, 1, 0.5) for i in (3, 1, 2)] + [("c", 1, 9, 1, 0, 0.5), ("d", 1, 1, 1, 0, 1.0), ("d", 1, 2, 1, 0, 1.0)], PRED)
    row = rm.ranking_metrics(df, (2,)).first()
    assert (row["ndcg"], row["recall"], row["eligible_groups"]) == (1.0, pytest.approx(2 / 3), 1)
    late = spark.createDataFrame([("c", 1, 1, 1, 0, 0.9), ("c", 1, 2, 1, 0, 0.8), ("c", 1, 3, 1, 1, 0.7)], PRED)
    by_k = {r["k"]: (r["ndcg"], r["mrr"]) for r in rm.ranking_metrics(late, (2, 3)).collect()}
    assert by_k[2] == (0.0, 0.0) and by_k[3] == (pytest.approx(0.5), pytest.approx(1 / 3))


@pytest.mark.parametrize("n, sizes", [(2, (1, 0, 1)), (3, (1, 1, 1)), (4, (1, 1, 2)), (5, (2, 1, 2)), (7, (2, 2, 3))])
def test_terciles(spark, n, sizes):
    users = spark.createDataFrame([(i,) for i in range(n)], "user_id long")
    train = spark.createDataFrame([(i, 0) for i in range(n) for _ in range(i)], "user_id long, x int")
    counts = {r["cohort"]: r["count"] for r in reports.user_cohorts(users, train).groupBy("cohort").count().collect()}
    assert tuple(counts.get(c, 0) for c in ("low", "medium", "high")) == sizes


def test_one_user_has_no_terciles(spark):
    with pytest.raises(Exception, match="two users"):
        reports.user_cohorts(spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(1,)], "user_id long")).collect()


def test_item_report_knows_items_without_history(spark):
    train = spark.createDataFrame([(1,), (1,), (2,)], "item_id long")
    df = spark.createDataFrame([("c", 1, 1, 1, 1, 0.9), ("c", 1, 7, 1, 1, 0.8), ("c", 1, 2, 1, 0, 0.1)], PRED)
    report = {r["cohort"]: r for r in reports.item_cohort_report(df, train, (1, 3)).where("k = 1").collect()}
    assert report["zero_history"]["positive_recall_at_k"] == 0.0 and report["zero_history"]["average_training_exposure"] == 0.0
    assert report["mid"]["recommendation_share_at_k"] == 1.0 and report["mid"]["interaction_share"] == pytest.approx(1 / 3)


def test_single_item_list_has_no_diversity(spark):
    df = spark.createDataFrame([("c", 1, 1, 1, 1, 0.9)], PRED).withColumn("category", F.lit(None).cast("string"))
    row = reports.diversity(df).first()
    assert (row["intra_list_category_diversity"], row["normalized_category_entropy"], row["mean_unique_categories"]) == (0.0, 0.0, 1.0)


def test_js_skips_users_without_profile_and_is_zero_for_equal_mixes(spark):
    df = spark.createDataFrame([("c", 1, 1, 1, 1, 0.9), ("c", 1, 2, 1, 1, 0.8), ("d", 2, 1, 1, 1, 0.9)], PRED).withColumn(
        "category", F.when(F.col("item_id") == 1, "a").otherwise("b")
    )
    profiles = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "user_id long, category string, preference double")
    row = reports.js_calibration(df, profiles).first()
    assert row["contexts"] == 1 and abs(row["js_divergence_mean"]) < 1e-12
    far = reports.js_calibration(df, profiles.where("category = 'a'").withColumn("category", F.lit("z"))).first()
    assert far["js_divergence_mean"] == pytest.approx(math.log(2), abs=1e-6)


def test_probability_edges_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.3), (1, 0.6), (1, 0.7), (0, 1.0)], "label int, probability double")
    bins = {r["bin"]: r["count"] for r in prob.reliability(df).collect()}
    edges = np.linspace(0, 1, 11)[1:-1]
    expected = {}
    for p in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0):
        b = int(np.digitize(p, [i / 10 for i in range(1, 10)]))
        expected[b] = expected.get(b, 0) + 1
    assert bins == expected and len(edges) == 9
    one = prob.ranking_areas(df.where("label = 1")).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None


def greedy(scores, items, categories, preference, weight, k):
    """Straight statement of the rule, for comparison."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], items[i]))
    universe = sorted(set(categories) | set(preference))
    pref = {c: preference.get(c, 0.0) for c in universe}
    total = sum(pref.values())
    pref = {c: (v / total if total else 1 / len(universe)) for c, v in pref.items()}
    low, high = min(min(scores), 0), max(max(scores), 0)
    picked, counts = [], dict.fromkeys(universe, 0)
    for step in range(min(k, len(order))):
        best = None
        for i in order:
            if i in picked:
                continue
            mix = {c: (counts[c] + (c == categories[i])) / (step + 1) for c in universe}
            cost = sum(abs(mix[c] - pref[c]) for c in universe) / 2
            value = round(weight * (scores[i] - low) / max(high - low, 1e-12) - (1 - weight) * cost, 9)
            if best is None or value > best[0]:
                best = (value, i)
        picked.append(best[1])
        counts[categories[best[1]]] += 1
    return [items[i] for i in picked + [i for i in order if i not in picked]]


def test_rerank_equals_the_rule(spark):
    rng = random.Random(11)
    data, profile_rows, expected = [], [], {}
    for user in range(6):
        preference = {c: rng.random() for c in "abx"} if user % 3 else {}
        total = sum(preference.values()) or 1
        preference = {c: v / total for c, v in preference.items()}
        profile_rows += [(user, c, v) for c, v in preference.items()]
        n = rng.choice([1, 4, 15])
        scores = [round(rng.uniform(0.2 if user == 1 else -1, 1), 2) for _ in range(n)]
        categories = [rng.choice("abcd") for _ in range(n)]
        data += [(f"c{user}", user, i, s, c) for i, (s, c) in enumerate(zip(scores, categories))]
        for weight in (1.0, 0.75, 0.5, 0.0):
            expected[(f"c{user}", weight)] = greedy(scores, list(range(n)), categories, preference, weight, 5)
    df = spark.createDataFrame(data, "context_id string, user_id long, item_id long, score double, category string")
    profiles = spark.createDataFrame(profile_rows, "user_id long, category string, preference double")
    found = {}
    for r in rerank.rerank_frontier(df, profiles, (1.0, 0.75, 0.5, 0.0), 5).orderBy("rerank_position").collect():
        found.setdefault((r["context_id"], r["relevance_weight"]), []).append(r["item_id"])
    assert found == expected


def test_exact_topk_in_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    users, items = rng.integers(-2, 3, (23, 4)).astype(float), rng.integers(-2, 3, (57, 4)).astype(float)  # many ties
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, embedding array<double>")
    c = spark.createDataFrame([(100 - i, v.tolist()) for i, v in enumerate(items)], "item_id long, embedding array<double>")
    expected = sorted(
        (u, i, s, r + 1) for u in range(23)
        for r, (s, i) in enumerate(sorted(((float(users[u] @ items[j]), 100 - j) for j in range(57)), key=lambda t: (-t[0], t[1]))[:10])
    )
    for block in (10, 262_144):
        assert rows(retrieval.exact_topk(q, c, 10, max_block_rows=block)) == sorted(expected, key=repr)
    assert retrieval.exact_topk(q, c, 500).count() == 23 * 57
    with pytest.raises(ValueError):
        retrieval.exact_topk(q, c, 0)


def test_user_lists_give_the_metrics_of_their_contexts(spark):
    rng = random.Random(5)
    shown = spark.createDataFrame(
        [(f"{u}:{c}", u, rng.randint(0, 9), rng.randint(0, 1), c) for u in range(6) for c in range(3) for _ in range(4)],
        "context_id string, user_id long, item_id long, long_view int, timestamp_ms long",
    )
    lists = spark.createDataFrame(  # user 5 has no list, user 4 a short one under one weight only
        [(w, u, i, r + 1) for w in (0.0, 0.5) for u in range(5) if u < 4 or w
         for r, i in enumerate(rng.sample(range(10), 2 if u == 4 else 6))],
        "popularity_weight double, user_id long, item_id long, retrieval_rank int",
    )
    contexts = shown.select("context_id", "user_id").distinct().join(lists, "user_id")
    for by in ([], ["popularity_weight"]):
        wanted, got = lists.where("popularity_weight = 0.5") if not by else lists, contexts.where("popularity_weight = 0.5") if not by else contexts
        expected = cand.retrieval_metrics(got, shown, (1, 3, 6), by)
        found = cand.user_list_metrics(wanted, shown, (1, 3, 6), by).select(*expected.columns)
        order = [*by, "k"]
        for a, b in zip(expected.orderBy(*order).collect(), found.orderBy(*order).collect(), strict=True):
            assert a.asDict() == pytest.approx(b.asDict())


def test_hybrid_sweep_stores_lists_of_users_not_of_contexts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(workflows, "materialize", lambda df: stored.append(df.count()) or df)
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, embedding array<float>")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.8, 0.0])], "item_id long, embedding array<float>")
    prior = spark.createDataFrame([(10, 0.0), (11, 1.0)], "item_id long, prior double")
    contexts = spark.createDataFrame([(f"1:{c}", 1, c, 10, 1) for c in range(9)], "context_id string, user_id long, timestamp_ms long, item_id long, long_view int")
    sweep = workflows.hybrid_sweep(contexts, users, items, prior, (0.0, 0.5), 2, (1, 2))
    assert rows(sweep, "popularity_weight", "k", "evaluated_contexts", "recall") == [(0.0, 1, 9, 1.0), (0.0, 2, 9, 1.0), (0.5, 1, 9, 0.0), (0.5, 2, 9, 1.0)]
    assert stored == [2 * 2]


def test_top_lists_are_bounded_while_items_stream(spark):
    rng = np.random.default_rng(3)
    asked, vectors = rng.normal(size=(6, 3)), rng.integers(-2, 3, (900, 3)).astype(float)
    vectors *= (1 + np.arange(900) // 30)[:, None]  # later items beat all earlier ones
    vectors[5] = np.nan
    top, most = retrieval._TopLists(asked, 4), 0
    for start in range(0, 900, 30):
        top.add(vectors[start:start + 30], np.arange(start, start + 30))
        most = max(most, top.count)
    assert most <= 6 * 4 * 2
    row, item, score, rank = top.cut()
    for q in range(6):
        scores = np.where(np.isnan(vectors[:, 0]), -np.inf, np.nan_to_num(asked[q] @ vectors.T))
        best = sorted(range(900), key=lambda i: (-scores[i], i))[:4]
        assert item[row == q].tolist() == best and rank[row == q].tolist() == [1, 2, 3, 4] and np.allclose(score[row == q], scores[best])
    q = spark.createDataFrame([(1, [1.0])], "user_id long, embedding array<double>")
    assert "CoGroup" not in retrieval.exact_topk(q, q.withColumnRenamed("user_id", "item_id"), 1)._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="differ in length"):
        retrieval.exact_topk(q, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "item_id long, embedding array<double>"), 1).collect()


def test_profile_vectors_do_not_broadcast_computed_vectors(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("item_id"), (F.col("id") % 7).cast("string").alias("kind")).write.parquet(str(tmp_path / "items"))
    items = retrieval.hash_vectors(spark.read.parquet(str(tmp_path / "items")), "item_id", ["kind"], 8)
    liked = spark.createDataFrame([(1, 3), (1, 3), (1, 4), (2, 10)], "user_id long, item_id long")
    profiles = retrieval.profile_vectors(liked, items, dimension=8)
    assert "BroadcastExchange" not in profiles._jdf.queryExecution().executedPlan().toString()
    vectors = {r.item_id: np.array(r.embedding) for r in items.collect()}
    found = {r.user_id: (r.positives, np.array(r.embedding)) for r in profiles.collect()}
    mean = 2 * vectors[3] + vectors[4]
    assert found[1][0] == 3 and np.allclose(found[1][1], mean / np.linalg.norm(mean))
    assert found[2][0] == 1 and np.allclose(found[2][1], vectors[10])


def test_popularity_weight_flips_the_top_item(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, embedding array<float>")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.8, 0.0])], "item_id long, embedding array<float>")
    prior = spark.createDataFrame([(10, 0.0), (11, 1.0)], "item_id long, prior double")
    contexts = spark.createDataFrame([("1:0:0", 1, 100, 10), ("1:0:0", 1, 90, 11), ("7:0:0", 7, 90, 11)], "context_id string, user_id long, timestamp_ms long, item_id long")
    for weight, first in ((0.0, 10), (0.5, 11)):
        found = retrieval.retrieve_candidates(contexts, users, items, 2, weight, prior)
        assert rows(found.where("retrieval_rank = 1"), "context_id", "timestamp_ms", "item_id") == [("1:0:0", 90, first)]
    pairs = spark.createDataFrame([(1, 10), (1, 11), (1, 99), (9, 10)], "user_id long, item_id long")
    scores = {(r[0], r[1]): r[2] for r in pop.pair_score(pairs, users, items, 0.0, prior, 0.5).collect()}
    assert scores[(1, 11)] > scores[(1, 10)] and scores[(1, 99)] == scores[(9, 10)] == 0.0


def test_forced_positives(spark):
    found = spark.createDataFrame([("a", 1, 5, 10, 0.9, 1), ("a", 1, 5, 11, 0.4, 2)], "context_id string, user_id long, timestamp_ms long, item_id long, retrieval_score double, retrieval_rank int")
    shown = spark.createDataFrame(
        [("a", 1, 5, 10, 1, 0), ("a", 1, 6, 20, 1, 1), ("a", 1, 7, 21, 1, 0), ("b", 2, 5, 30, 1, 0), ("b", 2, 6, 31, 0, 1)],
        "context_id string, user_id long, timestamp_ms long, item_id long, long_view int, is_like int",
    )
    labelled = cand.attach_labels(found, shown, "graded")
    forced = rows(labelled.where("forced_positive = 1"), "context_id", "item_id", "timestamp_ms", "retrieval_rank", "label")
    assert forced == [("a", 20, 5, 3, 2), ("a", 21, 5, 3, 1), ("b", 30, 5, 1, 1)]
    assert {r[0] for r in labelled.where("forced_positive = 1").select("retrieval_score").collect()} == {0.4 - 1e-6}
    assert rows(labelled.where("forced_positive = 0"), "item_id", "label") == [(10, 1), (11, 0)]
    report = cand.candidate_diagnostics(labelled).first()
    assert (report["candidate_rows"], report["forced_positive_rows"], report["forced_positive_context_rate"]) == (5, 3, 1.0)
    with pytest.raises(ValueError):
        cand.attach_labels(found, shown, "other")


def test_embedding_audit_finds_defects(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [1.0])], "id long, embedding array<double>")
    row = pop.embedding_audit(bad, "id").first()
    assert (row["duplicate_ids"], row["non_finite_vectors"], row["min_dimension"], row["max_dimension"], row["valid"]) == (1, 1, 1, 2, False)
    assert not pop.embedding_audit(bad.limit(0), "id").first()["valid"]


def test_select_variant_treats_nan_as_lowest(spark):
    df = spark.createDataFrame([("a", float("nan"), 1.0), ("b", 0.5, 1.0), ("c", 0.5, 2.0)], "name string, m double, t double")
    assert workflows.select_variant(df, "m", tie_breakers=[F.desc("t")]).first()["name"] == "c"


def test_stability_of_two_models(spark):
    long = spark.createDataFrame(
        [("a", "standard", "ndcg@10", 0.9), ("b", "standard", "ndcg@10", 0.5), ("a", "randomized", "ndcg@10", 0.1), ("b", "randomized", "ndcg@10", 0.3), ("c", "standard", "ndcg@10", 0.3)],
        "model string, domain string, metric string, value double",
    )
    row = rm.ranking_stability(long).first()
    assert (row["spearman"], row["model_count"], row["standard_order"], row["randomized_order"]) == (-1.0, 2, "a,b", "b,a")
    assert rm.ranking_stability(long.where("model = 'a'")).first()["spearman"] is None
    assert rows(rm.exposure_gap(long), "model", "gap") == [("a", 0.8), ("b", 0.2)]


def test_terciles_are_cut_in_each_group_and_empty_cohorts_stay(spark):
    train = spark.createDataFrame([(u, 0) for u in range(1, 13) for _ in range(u)], "user_id long, item_id long")
    users = spark.createDataFrame([("a", u) for u in range(1, 7)] + [("b", u) for u in range(7, 13)], "domain string, user_id long")
    cut = {(r.domain, r.user_id): r.cohort for r in reports.user_cohorts(users, train, by=["domain"]).collect()}
    assert [cut["a", u] for u in range(1, 7)] == [cut["b", u] for u in range(7, 13)]
    lists = users.select("domain", "user_id", F.col("user_id").alias("context_id"), F.lit(1).cast("long").alias("item_id"), F.lit(0).cast("long").alias("timestamp_ms"),
                         F.lit(20240123).alias("date"), F.lit(1.0).alias("score"), (F.col("user_id") % 6 == 1).cast("int").alias("long_view"))
    report = reports.user_cohort_report(lists, train, (5,), by=["domain"]).collect()
    assert sorted((r.domain, r.cohort) for r in report) == [(d, c) for d in "ab" for c in ("high", "low", "medium")]
    assert all(r.eligible_groups == 0 and r.ndcg is None and r.users == 2 for r in report if r.cohort != "low")


def test_inverted_lists_trade_recall_for_rows(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (12, 8))
    items = centers[rng.integers(0, 12, 600)] + rng.normal(0, 0.15, (600, 8))
    users = centers[rng.integers(0, 12, 40)] + rng.normal(0, 0.15, (40, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, embedding array<double>")
    centroids = inverted_lists.fit_lists(frame, 12, 6)
    assert np.allclose(centroids, inverted_lists.fit_lists(frame.repartition(2), 12, 6))
    exact = retrieval.exact_topk(asked, frame, 10)
    sweep = {r.nprobe: r for r in inverted_lists.ann_sweep(asked, frame, centroids, exact, 10, (1, 4, 12, 99)).collect()}
    assert sorted(sweep) == [1, 4, 12] and all(r.queries == 40 for r in sweep.values())
    assert sweep[12].recall_at_k == 1 and sweep[12].rows_scanned == 40 * 600 and sweep[12].share == 1
    assert sweep[4].recall_at_k >= 0.9 and sweep[4].share < 0.6 and sweep[1].rows_scanned < sweep[4].rows_scanned
    found = inverted_lists.search_lists(asked, frame, centroids, 10, 4)
    assert retrieval.retrieval_recall(exact, found, 10).first().recall_at_k == pytest.approx(sweep[4].recall_at_k)
    whole = inverted_lists.search_lists(asked, frame, centroids, 10, 12)
    assert rows(whole.select("user_id", "item_id", "retrieval_rank")) == rows(exact.select("user_id", "item_id", "retrieval_rank"))
    own = inverted_lists.nearest_lists(frame, centroids).collect()
    for r in own[:50]:
        assert r.list_id == int(((np.array(r.embedding) - centroids) ** 2).sum(axis=1).argmin()) and r.list_rank == 1
    few = frame.limit(3)
    assert len(inverted_lists.fit_lists(few, 12)) == 3
    with pytest.raises(ValueError, match="no items"):
        inverted_lists.fit_lists(frame.limit(0), 4)


def test_sweep_of_lists_keeps_no_top_list_for_each_list(spark, monkeypatch):
    """each probed list's own top k was stored and shuffled; the recall follows from the exact lists, ties included."""
    rng = np.random.default_rng(9)
    items, users = rng.integers(-2, 3, (300, 4)), rng.integers(-2, 3, (30, 4))  # many equal scores
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items.astype(float))], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users.astype(float))], "user_id long, embedding array<double>")
    centroids = inverted_lists.fit_lists(frame, 6, 2)
    exact = session.materialize(retrieval.exact_topk(asked, frame, 10))
    searched = {
        p: retrieval.retrieval_recall(exact, inverted_lists.search_lists(asked, frame, centroids, 10, p), 10).first().recall_at_k for p in (1, 3, 6)
    }
    monkeypatch.setattr(inverted_lists, "topk_within", None)
    sweep = inverted_lists.ann_sweep(asked, frame, centroids, exact, 10, (1, 3, 6))
    assert {r.nprobe: r.recall_at_k for r in sweep.collect()} == pytest.approx(searched) and searched[1] < searched[3] < searched[6] == 1


def test_greedy_steps_are_taken_for_many_lists_at_a_time(monkeypatch):
    """F16: lists of a batch are worked on together, in bounded pieces; empty queues, ties and null scores included."""
    rng, weights, k = np.random.default_rng(5), (1.0, 0.75, 0.5, 0.0), 4
    sizes, queues = [], []
    for _ in range(60):
        size, groups = int(rng.integers(1, 9)), [[] for _ in range(int(rng.integers(1, 5)))]
        for rank in range(1, size + 1):
            relevance = None if rng.random() < 0.1 else float(rng.integers(0, 4)) / 4
            groups[int(rng.integers(0, len(groups)))].append({"rank": rank, "relevance": relevance})
        sizes.append(size)
        queues.append([{"heads": heads[:k], "preference": float(rng.integers(0, 5)) / 4} for heads in groups])

    def plain(size, lists, weight):
        taken, picked = [0] * len(lists), []
        for number in range(1, min(size, k) + 1):
            best = None
            for i, q in enumerate(lists):
                if taken[i] < len(q["heads"]):
                    counts = [c + (j == i) for j, c in enumerate(taken)]
                    head, distance = q["heads"][taken[i]], sum(abs(c / number - o["preference"]) for c, o in zip(counts, lists)) / 2
                    utility = -np.inf if head["relevance"] is None else round(weight * head["relevance"] - (1 - weight) * distance, 9)
                    best = max(best or (-np.inf, -np.inf, 0), (utility, -head["rank"], i))
            taken[best[2]] += 1
            picked.append(-best[1])
        return picked

    kind = pa.list_(pa.struct([
        ("heads", pa.list_(pa.struct([("rank", pa.int32()), ("relevance", pa.float64())]))), ("preference", pa.float64()),
    ]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(sizes, pa.int64()), pa.array(queues, kind)], ["id", "_size", "_queues"])
    monkeypatch.setattr(rerank, "LISTS_AT_A_TIME", 7)
    out = list(rerank._picks(weights, k, 1)(iter([batch.slice(3), batch.slice(0, 3)])))
    assert max(b.num_rows for b in out) == 7
    found = {(i, w): p for b in out for i, w, p in zip(*[c.to_pylist() for c in b.columns])}
    assert found == {(i, w): plain(sizes[i], queues[i], w) for i in range(60) for w in weights}
