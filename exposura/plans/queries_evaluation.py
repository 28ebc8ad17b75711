"""Queries for ranking metrics, cohorts, diversity, calibration, probabilities and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposura.functions.columns import primary_category
from exposura.operators import bootstrap, probability as prob, ranking_metrics as rm, reports, rerank
from exposura.plans import views as v, workflows
from exposura.plans.registry import query

BY = ["model", "domain"]


def _per_group(spark, folder, k_values=(5, 10, 20)):
    return rm.ranking_metrics_per_group(v.predictions(spark, folder), k_values, by=BY)


def _tags(spark, folder):
    return v.item_tags(spark, folder).select("item_id", primary_category(F.col("tag")).alias("category"))


def _tagged_predictions(spark, folder):
    return v.predictions(spark, folder).join(_tags(spark, folder), "item_id", "left")


def _profiles(spark, folder):
    return reports.preference_profiles(v.train(spark, folder), _tags(spark, folder))


@query("ranking_metrics_per_group", """
select model, domain, evaluation_group, user_id, date, group_rows, k, R6(ndcg) as ndcg, R6(recall) as recall, R6(mrr) as mrr from per_group""")
def ranking_metrics_per_group(spark, folder):
    return _per_group(spark, folder)


@query("ranking_metrics", """
select model, domain, k, R6(ndcg) as ndcg, R6(recall) as recall, R6(mrr) as mrr, eligible_groups, eligible_rows from metrics""")
def ranking_metrics(spark, folder):
    return rm.average_metrics(_per_group(spark, folder), BY)


@query("mean_average_precision", """
, hits as (
  select model, domain, context_id, rank, k, positives,
    sum(long_view) over (partition by model, domain, context_id, k order by rank) as h, long_view
  from ranked join group_totals using (model, domain, context_id), ks where rank <= k),
per as (select model, domain, context_id, k, sum(long_view * h / rank) / any_value(least(k, positives)) as ap from hits group by all)
select model, domain, k, R6(avg(ap)) as map, count(*) as groups from per group by model, domain, k""")
def mean_average_precision(spark, folder):
    return rm.mean_average_precision(v.predictions(spark, folder), by=BY)


@query("metrics_by_user", """
select model, domain, user_id, k, R6(avg(ndcg)) as ndcg, R6(avg(recall)) as recall, R6(avg(mrr)) as mrr, count(*) as contexts
from per_group group by all""")
def metrics_by_user(spark, folder):
    return rm.metrics_by_user(_per_group(spark, folder), BY)


LONG_SQL = """
, long as (unpivot (select model, domain, k, ndcg, recall, mrr from metrics) on ndcg, recall, mrr into name metric value value)
, wide as (select model, metric || '@' || k as metric, max(value) filter (domain = 'standard') as standard,
  max(value) filter (domain = 'randomized') as randomized from long group by all)
"""


@query("exposure_gap", LONG_SQL + """
select model, metric, R6(standard) as standard, R6(randomized) as randomized, R6(standard - randomized) as gap,
  R6((standard - randomized) / standard) as normalized_gap from wide""")
def exposure_gap(spark, folder):
    return rm.exposure_gap(rm.long_metrics(rm.average_metrics(_per_group(spark, folder), BY)))


@query("ranking_stability", LONG_SQL + """
, w as (select * from wide where metric = 'ndcg@10')
, r as (select *, rank() over (order by standard) + (count(*) over (partition by standard) - 1) / 2 as s,
  rank() over (order by randomized) + (count(*) over (partition by randomized) - 1) / 2 as t from w)
select 'ndcg@10' as metric, R6(corr(s, t)) as spearman, count(*) as model_count,
  string_agg(model, ',' order by standard desc, model) as standard_order,
  string_agg(model, ',' order by randomized desc, model) as randomized_order from r""")
def ranking_stability(spark, folder):
    return rm.ranking_stability(rm.long_metrics(rm.average_metrics(_per_group(spark, folder, (10,)), BY)))


@query("recommendation_behavior", """
, freq as (select model, domain, item_id, count(*) as c from ranked where rank <= 10 group by all)
, placed as (select *, row_number() over (partition by model, domain order by c, item_id) as i, count(*) over (partition by model, domain) as n from freq)
select model, domain, count(*) as unique_recommended_items,
  R6(2 * sum(i * c) / (any_value(n) * sum(c)) - (any_value(n) + 1) / any_value(n)) as recommendation_gini,
  R6(count(*) / (select count(distinct item_id) from item_vectors)) as catalog_coverage from placed group by model, domain""")
def recommendation_behavior(spark, folder):
    return reports.recommendation_behavior(v.predictions(spark, folder), v.item_vectors(spark, folder), 10, BY)


COHORT_SQL = """
, base as (select model, domain, u.user_id, coalesce(h.n, 0) as history_count from (select distinct model, domain, user_id from predictions) u
  left join (select user_id, count(*) as n from train group by user_id) h using (user_id))
, placed as (select *, row_number() over (partition by model, domain order by history_count, user_id) as r,
    count(*) over (partition by model, domain) as n from base)
, user_cohorts as (select model, domain, user_id, history_count, case when 3 * (r - 1) < n - 1 then 'low' when 3 * (r - 1) < 2 * (n - 1) then 'medium' else 'high' end as cohort from placed)
"""


@query("user_cohorts", COHORT_SQL + "select distinct domain, user_id, history_count, cohort from user_cohorts")
def user_cohorts(spark, folder):
    return reports.user_cohorts(v.scored_parts(spark, folder), v.train(spark, folder), by=["domain"])


@query("user_cohort_report", COHORT_SQL + """
, sizes as (select model, domain, cohort, count(distinct user_id) as users, count(*) as rows from predictions join user_cohorts using (model, domain, user_id) group by all)
, m as (select model, domain, cohort, k, avg(ndcg) as ndcg, avg(recall) as recall, avg(mrr) as mrr, count(*) as eligible_groups,
    cast(sum(group_rows) as bigint) as eligible_rows from per_group join user_cohorts using (model, domain, user_id) group by model, domain, cohort, k)
select model, domain, cohort, k, R6(ndcg) as ndcg, R6(recall) as recall, R6(mrr) as mrr, coalesce(eligible_groups, 0) as eligible_groups,
  cast(coalesce(eligible_rows, 0) as bigint) as eligible_rows, users, rows, users < 30 as small
from (select * from sizes, ks) left join m using (model, domain, cohort, k)""")
def user_cohort_report(spark, folder):
    return reports.user_cohort_report(v.predictions(spark, folder), v.train(spark, folder), by=BY, min_users=30)


ITEM_COHORT_SQL = """
, exposure as (select item_id, count(*) as training_exposure from train group by item_id)
, item_cohorts as (select item_id, training_exposure,
    case when r / n <= 0.10 then 'head' when r / n <= 0.50 then 'mid' else 'tail' end as item_cohort
  from (select *, row_number() over (order by training_exposure desc, item_id) as r, count(*) over () as n from exposure))
"""


@query("item_cohorts", ITEM_COHORT_SQL + "select item_id, training_exposure, item_cohort from item_cohorts")
def item_cohorts(spark, folder):
    return reports.item_cohorts(v.train(spark, folder))


@query("item_cohort_report", ITEM_COHORT_SQL + """
, work as (select r.*, coalesce(training_exposure, 0) as training_exposure, coalesce(item_cohort, 'zero_history') as cohort
  from ranked r left join item_cohorts using (item_id))
, traffic as (select model, domain, cohort, count(distinct item_id) as catalog_items, count(*) as rows, avg(long_view) as positive_rate,
    count(*) filter (rank <= 20) as shown, avg(training_exposure) filter (rank <= 20) as exposure,
    count(distinct (context_id, item_id)) filter (long_view = 1) as pairs from work group by model, domain, cohort)
, at_k as (select model, domain, cohort, k, count(*) filter (rank <= k) as at_k,
    count(distinct (context_id, item_id)) filter (long_view = 1 and rank <= k) as hits from work, ks group by model, domain, cohort, k)
select model, domain, cohort, catalog_items, catalog_items < 12 as small, rows, R6(rows / sum(rows) over w) as interaction_share, R6(positive_rate) as positive_rate,
  R6(shown / greatest(sum(shown) over w, 1)) as recommended_share, R6(coalesce(exposure, 0)) as average_training_exposure, k,
  R6(at_k / sum(at_k) over w) as recommendation_share_at_k, R6(hits / greatest(pairs, 1)) as positive_recall_at_k
from traffic join at_k using (model, domain, cohort) window w as (partition by model, domain, k)""")
def item_cohort_report(spark, folder):
    return reports.item_cohort_report(v.predictions(spark, folder), v.train(spark, folder), by=BY, min_items=12)


@query("item_age_cohorts", """
, f as (select item_id, min(timestamp_ms) as first from train group by item_id)
, a as (select item_id, long_view, (timestamp_ms - first) // 86400000 as days from tests left join f using (item_id))
select case when days is null then 'unseen' when days < 7 then '<7' when days < 14 then '<14' when days < 28 then '<28' else 'older' end as age,
  count(distinct item_id) as items, count(*) as rows, R6(avg(long_view)) as positive_rate from a group by 1""")
def item_age_cohorts(spark, folder):
    return reports.item_age_report(v.scored_parts(spark, folder), v.train(spark, folder), (7, 14, 28))


@query("history_depth_cohorts", """
, h as (select user_id, count(*) as n from train group by user_id)
select case when coalesce(n, 0) = 0 then 'zero' when n < 20 then 'low' else 'mature' end as depth,
  count(distinct user_id) as users, count(*) as rows, R6(avg(long_view)) as positive_rate
from tests left join h using (user_id) group by 1""")
def history_depth_cohorts(spark, folder):
    return reports.history_depth_report(v.scored_parts(spark, folder), v.train(spark, folder), low_below=20)


@query("preference_profiles", "select user_id, category, R6(preference) as preference from profiles")
def preference_profiles(spark, folder):
    return _profiles(spark, folder)


@query("diversity", """
, c as (select model, domain, context_id, coalesce(category, 'unknown') as category, count(*) as c
  from ranked left join item_categories using (item_id) where rank <= 10 group by all)
, l as (select model, domain, context_id, sum(c) as n, sum(c * (c - 1) / 2) as same, count(*) as u,
    sum(-(c / tot) * ln(c / tot)) as e from (select *, sum(c) over (partition by model, domain, context_id) as tot from c) group by all)
select model, domain, R6(avg(case when n > 1 then 1 - same / (n * (n - 1) / 2) else 0 end)) as intra_list_category_diversity,
  R6(avg(case when n > 1 then e / ln(n) else 0 end)) as normalized_category_entropy, R6(avg(u)) as mean_unique_categories,
  count(*) as contexts, 10 as k from l group by model, domain""")
def diversity(spark, folder):
    return reports.diversity(_tagged_predictions(spark, folder), 10, BY)


@query("js_calibration", """
, mix as (select model, domain, context_id, user_id, coalesce(category, 'unknown') as category, count(*) as n
  from ranked left join item_categories using (item_id) where rank <= 10 group by all)
, lists as (select model, domain, context_id, user_id, sum(n) as size from mix group by all)
, shares as (select m.*, n / size as share from mix m join lists using (model, domain, context_id, user_id))
, wanted as (select model, domain, context_id, user_id, category, preference from lists join profiles using (user_id))
, pq as (select coalesce(w.model, s.model) as model, coalesce(w.domain, s.domain) as domain, coalesce(w.context_id, s.context_id) as context_id,
    coalesce(preference, 0) + 1e-12 as p, coalesce(share, 0) + 1e-12 as q
  from wanted w full join (select * from shares where user_id in (select user_id from profiles)) s
    on w.model = s.model and w.domain = s.domain and w.context_id = s.context_id and w.category = s.category)
, norm as (select model, domain, context_id, p / sum(p) over w as p, q / sum(q) over w as q from pq window w as (partition by model, domain, context_id))
, js as (select model, domain, context_id, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) as d from norm group by all)
select model, domain, R6(avg(d)) as js_divergence_mean, count(*) as contexts, 10 as k from js group by model, domain""")
def js_calibration(spark, folder):
    return reports.js_calibration(_tagged_predictions(spark, folder), _profiles(spark, folder), 10, BY)


PROBABILITY_SQL = """
, pr as (select event_id, long_view as y, greatest(least(1 / (1 + exp(-(value - 50) / 50)), 1 - 1e-9), 1e-9) as p from impressions)
, binned as (select *, cast((p >= 0.1) as int) + cast((p >= 0.2) as int) + cast((p >= 0.3) as int) + cast((p >= 0.4) as int)
  + cast((p >= 0.5) as int) + cast((p >= 0.6) as int) + cast((p >= 0.7) as int) + cast((p >= 0.8) as int) + cast((p >= 0.9) as int) as bin from pr)
, bins as (select bin, count(*) as n, avg(p) as mp, avg(y) as my from binned group by bin)
"""


@query("reliability", PROBABILITY_SQL + "select bin, n as count, R6(mp) as mean_probability, R6(my) as observed_rate from bins")
def reliability(spark, folder):
    return prob.reliability(v.probabilities(spark, folder))


@query("probability_metrics", PROBABILITY_SQL + """
select R6(avg((p - y) * (p - y))) as brier_score, R6(-avg(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss,
  R6((select sum(n * abs(mp - my)) / sum(n) from bins)) as expected_calibration_error, count(*) as rows from pr""")
def probability_metrics(spark, folder):
    return prob.probability_metrics(v.probabilities(spark, folder))


@query("auc_ap", PROBABILITY_SQL + """
, c as (select p, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from pr group by p)
, w as (select *, sum(neg) over (order by p) - neg as nb, sum(pos) over (order by p desc) as cp, sum(neg) over (order by p desc) as cn from c)
select R6(sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg))) as roc_auc, R6(sum(pos * cp / (cp + cn)) / sum(pos)) as pr_auc from w""")
def auc_ap(spark, folder):
    return prob.ranking_areas(v.probabilities(spark, folder))


def _boot_sql(source: str, unit: str, value: str, samples: int, by: str = "") -> str:
    """Replicate means of one slice of units per group, over ``source``."""
    start = v.stream_start("42::ubigint", "b::ubigint", "0::ubigint")
    group = f"{by}, " if by else ""
    over = f"partition by {by} " if by else ""
    using = f"({group}i)"
    return f"""
, vals as (select {group}row_number() over ({over}order by {unit}) - 1 as i, count(*) over ({over.strip()}) as n, {value} as v from {source})
, starts as (select b, {start} as start from (select unnest(range(0, {samples})) as b))
, draws as (select {group}b, cast(floor({v.stream_draw("start", "j")} * n) as bigint) as i
  from starts, (select {group}i as j, n from vals))
, reps as (select {group}b, avg(v) as m from draws join vals using {using} group by {group}b)
"""


@query("bootstrap_user_metric", """
, um as (select model, domain, user_id, avg(ndcg) as value from per_group where k = 10 group by all)
""" + _boot_sql("um", "user_id", "value", 500, "model, domain") + """
, truth as (select model, domain, avg(value) as mean, count(*) as n_users from um group by all)
select model, domain, R6(any_value(mean)) as mean, R6(quantile_cont(m, 0.025)) as ci_low, R6(quantile_cont(m, 0.975)) as ci_high,
  any_value(n_users) as n_users from reps join truth using (model, domain) group by model, domain""")
def bootstrap_user_metric(spark, folder):
    return bootstrap.bootstrap_user_metric(_per_group(spark, folder, (10,)), by=["model", "domain"])


@query("paired_bootstrap", """
, um as (select domain, user_id, model, avg(ndcg) as value from per_group where k = 10 group by all)
, diff as (
  select domain, l.model as left_model, r.model as right_model, user_id, l.value - r.value as value
  from um l join um r using (domain, user_id) where l.model < r.model)
""" + _boot_sql("diff", "user_id", "value", 500, "domain, left_model, right_model") + """
, truth as (select domain, left_model, right_model, avg(value) as mean, count(*) as n_users from diff group by all)
select domain, left_model, right_model, R6(any_value(mean)) as mean_difference, R6(quantile_cont(m, 0.025)) as ci_low,
  R6(quantile_cont(m, 0.975)) as ci_high, any_value(n_users) as n_users
from reps join truth using (domain, left_model, right_model) group by domain, left_model, right_model""")
def paired_bootstrap(spark, folder):
    return bootstrap.paired_bootstrap_of_all(_per_group(spark, folder, (10,)), by=["domain"])


@query("bootstrap_mean", ", truth as (select * from bandit where policy = 'random')" + _boot_sql("truth", "round_id", "reward", 200) + """
select R6((select avg(reward) from truth)) as estimate, (select count(*) from truth) as rows, R6(quantile_cont(m, 0.025)) as lower_95,
  R6(quantile_cont(m, 0.975)) as upper_95, R6(stddev_samp(m)) as bootstrap_standard_error, 200 as bootstrap_samples from reps""")
def bootstrap_mean(spark, folder):
    return bootstrap.bootstrap_mean(v.bandit(spark, folder).where("policy = 'random'"), "round_id", "reward", 200)


@query("select_variant", """
select model, R6(ndcg) as ndcg, R6(mrr) as mrr from metrics where k = 10 and domain = 'standard' order by metrics.ndcg desc, model limit 1""")
def select_variant(spark, folder):
    table = rm.average_metrics(_per_group(spark, folder, (10,)), BY).where("domain = 'standard'")
    return workflows.select_variant(table, "ndcg", tie_breakers=[F.col("model")]).select("model", "ndcg", "mrr")


RERANK_SQL = """
, cand as (
  select t.context_id, t.user_id, t.event_id, t.date, t.long_view, t.item_id, t.timestamp_ms, t.score, coalesce(c.category, 'unknown') as category,
    row_number() over w as rank, greatest(max(t.score) over g, 0) as high, least(min(t.score) over g, 0) as low, count(*) over g as size
  from (select * replace (domain || ':' || context_id as context_id) from predictions where model = 'popularity') t
    left join item_categories c using (item_id)
  window w as (partition by t.context_id order by t.score desc, t.item_id, t.timestamp_ms), g as (partition by t.context_id))
, cats as (
  select context_id, category, coalesce(max(preference), 0) as preference from (
    select distinct context_id, category, null as preference from cand
    union all select distinct c.context_id, p.category, p.preference from cand c join profiles p using (user_id)) group by all)
, prefs as (
  select context_id, category, case when sum(preference) over g = 0 then 1 / count(*) over g else preference / sum(preference) over g end as pref
  from cats window g as (partition by context_id))
, pref_maps as (select context_id, list(struct_pack(category := category, pref := pref)) as prefs from prefs group by context_id)
, lists as (
  select c.context_id, any_value(least(size, 10)) as steps,
    list(struct_pack(rank := rank, category := category, rel := (score - low) / greatest(high - low, 1e-12)) order by rank) as cands
  from cand c group by c.context_id)
, runs as (
  select context_id, lam, steps, cands, prefs from lists join pref_maps using (context_id), (select unnest([1.0::double, 0.9, 0.75, 0.5]) as lam))
"""
GREEDY_SQL = """
, picks as (
  select context_id, lam, steps, cands, prefs, 0 as step, []::bigint[] as picked, []::varchar[] as taken from runs
  union all
  select context_id, lam, steps, cands, prefs, step + 1, list_append(picked, best.rank), list_append(taken, best.category)
  from (
    select *, list_reduce(
      list_transform(list_filter(cands, lambda c: not list_contains(picked, c.rank)), lambda c: struct_pack(
        rank := c.rank, category := c.category, utility := round(lam * c.rel - (1 - lam) * list_sum(list_transform(prefs, lambda p:
          abs((len(list_filter(taken, lambda t: t = p.category)) + case when p.category = c.category then 1 else 0 end) / (step + 1) - p.pref))) / 2, 9))),
      lambda a, b: case when b.utility > a.utility then b else a end) as best
    from picks where step < steps))
, final as (select context_id, lam, picked from picks where step = steps)
, reranked as (
  select c.*, lam as relevance_weight, case when list_contains(picked, rank) then list_position(picked, rank)
    else len(picked) + rank - len(list_filter(picked, lambda p: p < rank)) end as rerank_position
  from cand c join final using (context_id))
"""


def _lists(spark, folder):
    """Lists of the popularity model in both domains; the domain becomes part of the context id."""
    rows = _tagged_predictions(spark, folder).where("model = 'popularity'")
    return rows.withColumn("context_id", F.concat_ws(":", "domain", "context_id"))


@query("rerank_frontier", (RERANK_SQL + GREEDY_SQL + """
select event_id, context_id, relevance_weight, rerank_position from reranked"""))
def rerank_frontier(spark, folder):
    return rerank.rerank_frontier(_lists(spark, folder), _profiles(spark, folder)).select("event_id", "context_id", "relevance_weight", "rerank_position")


@query("frontier_report", RERANK_SQL + GREEDY_SQL + """
, gt as (select context_id, sum(long_view) as pos from cand group by context_id having count(*) >= 2 and sum(long_view) > 0)
, rel as (
  select relevance_weight, context_id, sum(case when rerank_position <= 10 then long_view / log2(rerank_position + 1) else 0 end)
      / list_sum(list_transform(range(1, least(10, any_value(pos))::int + 1), lambda x: 1 / log2(x + 1))) as ndcg,
    sum(case when rerank_position <= 10 then long_view else 0 end) / any_value(pos) as recall,
    coalesce(1.0::double / min(case when long_view = 1 and rerank_position <= 10 then rerank_position end), 0.0) as mrr
  from reranked join gt using (context_id) group by relevance_weight, context_id)
, relevance as (select relevance_weight, avg(ndcg) as ndcg, avg(recall) as recall, avg(mrr) as mrr, count(*) as eligible_groups from rel group by all)
, mix as (select relevance_weight, context_id, user_id, category, count(*) as c from reranked where rerank_position <= 10 group by all)
, l as (select relevance_weight, context_id, sum(c) as n, sum(c * (c - 1) / 2) as same, count(*) as u, sum(-(c / tot) * ln(c / tot)) as e
  from (select *, sum(c) over (partition by relevance_weight, context_id) as tot from mix) group by all)
, variety as (select relevance_weight, avg(case when n > 1 then 1 - same / (n * (n - 1) / 2) else 0 end) as d,
    avg(case when n > 1 then e / ln(n) else 0 end) as en, avg(u) as u from l group by all)
, pq as (
  select relevance_weight, context_id, category, max(p) + 1e-12 as p, max(q) + 1e-12 as q from (
    select relevance_weight, context_id, category, 0.0::double as p, c / sum(c) over (partition by relevance_weight, context_id) as q
    from mix where user_id in (select user_id from profiles)
    union all
    select m.relevance_weight, m.context_id, p.category, p.preference, 0.0 from (select distinct relevance_weight, context_id, user_id from mix) m
      join profiles p using (user_id)) group by all)
, norm as (select relevance_weight, context_id, p / sum(p) over w as p, q / sum(q) over w as q from pq window w as (partition by relevance_weight, context_id))
, js as (select relevance_weight, context_id, sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) as d from norm group by all)
, freq as (select relevance_weight, item_id, count(*) as c from reranked where rerank_position <= 10 group by all)
, gp as (select *, row_number() over (partition by relevance_weight order by c, item_id) as i, count(*) over (partition by relevance_weight) as n from freq)
, g as (select relevance_weight, count(*) as unique_items, 2 * sum(i * c) / (any_value(n) * sum(c)) - (any_value(n) + 1) / any_value(n) as gini from gp group by relevance_weight)
select relevance_weight, R6(ndcg) as ndcg, R6(recall) as recall, R6(mrr) as mrr, eligible_groups,
  R6((select avg(d) from js where js.relevance_weight = r.relevance_weight)) as js_divergence_mean,
  R6(v.d) as intra_list_category_diversity, R6(en) as normalized_category_entropy, R6(u) as mean_unique_categories,
  unique_items as unique_recommended_items, R6(gini) as recommendation_gini,
  R6(unique_items / (select count(distinct item_id) from item_vectors)) as catalog_coverage
from relevance r join variety v using (relevance_weight) join g using (relevance_weight)""")
def frontier_report(spark, folder):
    return workflows.frontier_report(_lists(spark, folder), _profiles(spark, folder), v.item_vectors(spark, folder))
