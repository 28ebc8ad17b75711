"""Queries for weights, off-policy evaluation, negatives, training rows and model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposura.operators import (
    density, history, negatives as neg, ope, popularity as pop, ranker, retrieval, weights as wt,
)
from exposura.operators.bootstrap import POISSON_ONE_CDF
from exposura.operators.probability import probability_metrics
from exposura.operators.ranking_metrics import ranking_metrics
from exposura.plans import views as v, workflows
from exposura.operators.candidates import attach_labels
from exposura.operators.popularity import popularity_score
from exposura.plans.queries_retrieval import ATTACHED_SQL, EXACT_SQL, candidates_of
from exposura.plans.registry import query
from exposura.session import materialize
from exposura.sources import bandit as bandit_source
from exposura.streaming import log_stream

PRIOR = 0.3

WEIGHTS_SQL = """
, q as (select event_id, greatest(least((1 + event_id % 98) / 100.0::double, 1 - 1e-5), 1e-5) as q from impressions)
, w as (select event_id, least(q / (1 - q) * (0.7::double / 0.3::double), 10.0::double) as w from q)
"""


def _weights(spark, folder, self_normalize=False):
    return wt.density_weights(v.domain_probabilities(spark, folder), PRIOR, 10.0, self_normalize)


@query("density_weights", WEIGHTS_SQL + "select event_id, R6(w / (select avg(w) from w)) as weight from w")
def density_weights(spark, folder):
    return _weights(spark, folder, True).select("event_id", "weight")


@query("weight_diagnostics", WEIGHTS_SQL + """
select R6(avg(w)) as weight_mean, R6(stddev_pop(w)) as weight_std, R6(max(w)) as weight_max, R6(quantile_cont(w, 0.01)) as weight_p01,
  R6(quantile_cont(w, 0.5)) as weight_p50, R6(quantile_cont(w, 0.99)) as weight_p99, R6(sum(w) * sum(w) / sum(w * w)) as effective_sample_size from w""")
def weight_diagnostics(spark, folder):
    return wt.weight_diagnostics(_weights(spark, folder))


@query("percentile_clip", WEIGHTS_SQL + """
, raw as (select event_id, q / (1 - q) * (0.7::double / 0.3::double) as w from q)
select event_id, R6(greatest(least(w, (select quantile_cont(w, 0.99) from raw)), (select quantile_cont(w, 0.01) from raw))) as clipped_weight from raw""")
def percentile_clip(spark, folder):
    raw = wt.density_weights(v.domain_probabilities(spark, folder), PRIOR, None)
    return wt.clip_at_percentiles(raw).select("event_id", "clipped_weight")


@query("weight_histogram", WEIGHTS_SQL + """
, b as (select min(w) as lo, quantile_cont(w, 0.995) as hi from w)
, n as (select least(cast(floor((least(w, hi) - lo) / ((hi - lo) / 20)) as int), 19) as bin, lo, (hi - lo) / 20 as width from w, b)
select g.bin, count(n.bin) as count, R6(any_value(e.lo + e.width * g.bin)) as lower_edge, R6(any_value(e.lo + e.width * (g.bin + 1))) as upper_edge
from (select cast(unnest(range(20)) as int) as bin) g left join n on n.bin = g.bin, (select lo, (hi - lo) / 20 as width from b) e group by g.bin""")
def weight_histogram(spark, folder):
    return wt.weight_histogram(_weights(spark, folder), bins=20)


@query("bandit_validate", """
select count(*) as rounds, count(*) filter (not (action >= 0 and action < 10)) as action_out_of_range,
  count(*) filter (len(list_filter(context, lambda x: not isfinite(x))) > 0) as context_not_finite,
  count(*) filter (reward is null) as reward_not_finite, count(*) filter (not (pscore > 0 and pscore <= 1)) as pscore_invalid,
  min(len(context)) as min_context, max(len(context)) as max_context, true as valid from bandit""")
def bandit_validate(spark, folder):
    return bandit_source.bandit_audit(v.bandit(spark, folder), v.N_ACTIONS)


OPE_SQL = """
, rounds as (select *, list_dot_product(target, prediction) as dm, target[action + 1] / pscore as raw, prediction[action + 1] as q
  from bandit where policy = 'behavior')
"""


def _behavior(spark, folder):
    return bandit_source.checked_bandit(v.bandit(spark, folder), v.N_ACTIONS).where("policy = 'behavior'")


@query("importance_weights", OPE_SQL + "select round_id, R6(least(raw, 1.0)) as weight from rounds")
def importance_weights(spark, folder):
    return ope.importance_weights(_behavior(spark, folder), 1.0).select("round_id", "weight")


@query("ope_weight_diagnostics", OPE_SQL + """
, c as (select raw, least(raw, 1.0) as w from rounds)
select R6(min(w)) as minimum, R6(avg(w)) as mean, R6(stddev_pop(w)) as standard_deviation, R6(quantile_cont(w, 0.95)) as p95,
  R6(quantile_cont(w, 0.99)) as p99, R6(max(w)) as maximum, R6(sum(w) * sum(w) / greatest(sum(w * w), 1e-12)) as effective_sample_size,
  R6(avg(case when w < raw then 1 else 0 end)) as clipped_fraction from c""")
def ope_weight_diagnostics(spark, folder):
    raw = ope.importance_weights(_behavior(spark, folder), None, "raw_weight")
    return ope.weight_report(raw.withColumn("weight", F.least("raw_weight", F.lit(1.0))))


@query("ope_estimates", OPE_SQL + """
, c as (select *, unnest([null, 1.0::double, 0.5::double]) as clip from rounds)
, w as (select *, case when clip is null then raw else least(raw, clip) end as w from c)
select clip, R6(avg(dm)) as dm, R6(avg(w * reward)) as ips, R6(sum(w * reward) / greatest(sum(w), 1e-12)) as snips,
  R6(avg(dm + w * (reward - q))) as dr, R6(sum(w) * sum(w) / greatest(sum(w * w), 1e-12)) as effective_sample_size,
  R6(avg(w)) as weight_mean, R6(max(w)) as weight_max, count(*) as n_rounds from w group by clip""")
def ope_estimates(spark, folder):
    return ope.policy_values(_behavior(spark, folder), (None, 1.0, 0.5))


def _counts_sql(rounds: str) -> str:
    """Poisson(1) counts ``n`` of every round in each of 200 replicates."""
    counted = " + ".join(f"cast((u >= {edge!r}::double) as int)" for edge in POISSON_ONE_CDF)
    return f"""
, starts as (select round_id, {v.stream_start("42::ubigint", "round_id::ubigint")} as start from {rounds})
, uniform as (select round_id, b, {v.stream_draw("start", "b")} as u from starts, (select unnest(range(0, 200)) as b))
, counted as (select * from (select round_id, b, {counted} as n from uniform) where n > 0)"""


def _poisson_sql() -> str:
    return _counts_sql("rounds") + """
, reps as (
  select b, sum(n * dm) / sum(n) as dm, sum(n * raw * reward) / sum(n) as ips, sum(n * raw * reward) / greatest(sum(n * raw), 1e-12) as snips,
    sum(n * (dm + raw * (reward - q))) / sum(n) as dr from counted join rounds using (round_id) group by b)
, long as (unpivot reps on dm, ips, snips, dr into name estimator value value)
select estimator, R6(quantile_cont(value, 0.025)) as lower_95, R6(quantile_cont(value, 0.975)) as upper_95,
  R6(stddev_samp(value)) as bootstrap_standard_error from long group by estimator"""


@query("ope_bootstrap", OPE_SQL + _poisson_sql())
def ope_bootstrap(spark, folder):
    return ope.bootstrap_policy_value(_behavior(spark, folder))


@query("reward_model_mean", """
, m as (select action, avg(reward) as r from bandit where policy = 'behavior' group by action)
select a as action, R6(coalesce(r, (select avg(reward) from bandit where policy = 'behavior'))) as prediction
from (select unnest(range(0, 10)) as a) left join m on m.action = a""")
def reward_model_mean(spark, folder):
    model = ope.mean_reward_by_action(_behavior(spark, folder), v.N_ACTIONS)
    return model.select(F.posexplode("prediction").alias("action", "prediction"))


@query("reward_model_logistic")
def reward_model_logistic(spark, folder):
    rows = materialize(ope.shuffled_halves(_behavior(spark, folder).drop("prediction"), [42]))
    scored = ope.logistic_reward_model(rows.where("half = 'fit'"), rows.where("half = 'evaluate'"), v.N_ACTIONS)
    return ope.policy_value(scored)


STUDY_SQL = f"""
, b as (select round_id, action, reward, pscore from bandit where policy = 'behavior')
, shuffled as (
  select b.*, seed, row_number() over (partition by seed order by {v.u("round_id", "seed")}, round_id) - 1 as place, count(*) over (partition by seed) as n
  from b, (select unnest([42, 43, 44]) as seed))
, fit as (select seed, action, avg(reward) as r from shuffled where place < n // 2 group by all)
, overall as (select seed, avg(reward) as r from shuffled where place < n // 2 group by seed)
, model as (select o.seed, a as action, coalesce(f.r, o.r) as r from overall o cross join (select unnest(range(0, 10)) as a) left join fit f on f.seed = o.seed and f.action = a)
, dm as (select seed, avg(r) as dm from model group by seed)
, grid as (select fraction, clip_value from (select unnest([0.1::double, 0.25, 0.5, 1.0]) as fraction), (select unnest([null, 10.0::double, 50.0]) as clip_value))
, pool as (
  select s.*, fraction, clip_value, d.dm, m.r as q, 0.1 / pscore as raw, case when clip_value is null then 0.1 / pscore else least(0.1 / pscore, clip_value) end as w
  from shuffled s join dm d using (seed) join model m using (seed, action), grid
  where place >= n // 2 and place - n // 2 < greatest(1, cast(round_even((n - n // 2) * fraction, 0) as bigint)))
, est as (
  select seed, fraction, clip_value, count(*) as n_rounds, avg(dm) as dm, avg(w * reward) as ips, sum(w * reward) / greatest(sum(w), 1e-12) as snips,
    avg(dm + w * (reward - q)) as dr, min(w) as weight_minimum, avg(w) as weight_mean, stddev_pop(w) as weight_standard_deviation,
    quantile_cont(w, 0.95) as weight_p95, quantile_cont(w, 0.99) as weight_p99, max(w) as weight_maximum,
    sum(w) * sum(w) / greatest(sum(w * w), 1e-12) as effective_sample_size, avg(case when w < raw then 1 else 0 end) as clipped_fraction
  from pool group by all)
{_counts_sql("b")}
, reps as (
  select seed, fraction, clip_value, c.b, sum(c.n * dm) / sum(c.n) as dm, sum(c.n * w * reward) / sum(c.n) as ips,
    sum(c.n * w * reward) / greatest(sum(c.n * w), 1e-12) as snips, sum(c.n * (dm + w * (reward - q))) / sum(c.n) as dr
  from pool join counted c using (round_id) group by all)
, spread as (select seed, fraction, clip_value, {", ".join(
    f"R6(quantile_cont({e}, 0.025)) as {e}_lower_95, R6(quantile_cont({e}, 0.975)) as {e}_upper_95, R6(stddev_samp({e})) as {e}_bootstrap_standard_error"
    for e in ope.ESTIMATORS)} from reps group by all)
, t as (select avg(reward) as v from bandit where policy = 'random')
select e.seed, e.fraction, e.clip_value, n_rounds, R6(dm) as dm, R6(ips) as ips, R6(snips) as snips, R6(dr) as dr,
  {", ".join(f"R6({c}) as {c}" for c in ("weight_minimum", "weight_mean", "weight_standard_deviation", "weight_p95", "weight_p99",
    "weight_maximum", "effective_sample_size", "clipped_fraction"))},
  s.* exclude (seed, fraction, clip_value),
  {", ".join(f"R6(abs({e} - v)) as {e}_absolute_error, R6(abs({e} - v) / greatest(abs(v), 1e-12)) as {e}_relative_error" for e in ope.ESTIMATORS)}
from est e join spread s on s.seed = e.seed and s.fraction = e.fraction and s.clip_value is not distinct from e.clip_value, t"""


@query("ope_study", STUDY_SQL)
def ope_study(spark, folder):
    behavior, truth = bandit_source.behavior_and_truth(v.bandit(spark, folder).drop("target", "prediction"), "behavior")
    return ope.ope_study(behavior, truth, v.N_ACTIONS)


OUTCOMES_SQL = """
, o as (
  select user_id, item_id, min(timestamp_ms) filter (long_view = 1) as first_positive, min(timestamp_ms) filter (long_view = 0) as first_negative
  from train group by all)
, openings as (
  select user_id, item_id as candidate, first_positive, first_negative, row_number() over (partition by user_id order by first_negative, item_id) - 1 as idx
  from o where first_negative is not null and (first_positive is null or first_negative < first_positive))
, pools as (
  select t.user_id, t.item_id, t.first_positive as timestamp_ms,
    (select count(*) from openings p where p.user_id = t.user_id and p.first_negative < t.first_positive) as opened,
    (select count(*) from openings p where p.user_id = t.user_id and p.first_negative < t.first_positive
      and (p.first_positive is null or p.first_positive >= t.first_positive) and p.candidate <> t.item_id) as pool_size,
    (select count(*) from train e where e.timestamp_ms < t.first_positive) as prior_events
  from o t where t.first_positive is not null)
"""


@query("first_positive", "select user_id, item_id, min(timestamp_ms) as timestamp_ms from train where long_view = 1 group by all")
def first_positive(spark, folder):
    return neg.first_positives(v.train(spark, folder))


@query("negative_pools", OUTCOMES_SQL + "select user_id, item_id, timestamp_ms, opened, pool_size, prior_events from pools")
def negative_pools(spark, folder):
    return neg.negative_pools(v.train(spark, folder))


SAMPLE_SQL = OUTCOMES_SQL + f"""
, attempts as (select unnest(range(0, 5)) as attempt)
, catalog as (select item_id as candidate, row_number() over (order by item_id) - 1 as slot from (select distinct item_id from train))
, events_at as (select item_id as candidate, row_number() over (order by timestamp_ms, user_id, item_id) - 1 as event from train)
, sized as (select *, (select count(*) from catalog) as items from pools)
, exposed_quick as (
  select t.user_id, t.item_id, t.timestamp_ms, arg_min(p.candidate, attempt) as negative_item
  from sized t, attempts a join openings p on p.user_id = t.user_id and p.idx = cast(floor({v.u("t.user_id", "t.item_id", "attempt", "'exposed'", "'42'")} * opened) as bigint)
  where pool_size > 0 and (p.first_positive is null or p.first_positive >= t.timestamp_ms) and p.candidate <> t.item_id group by all)
, exposed_rest as (
  select user_id, item_id, timestamp_ms, candidate as negative_item from (
    select t.user_id, t.item_id, t.timestamp_ms, p.candidate, {v.u("t.user_id", "t.item_id", "'pool'", "'42'")} as u,
      row_number() over (partition by t.user_id, t.item_id order by p.idx) - 1 as r, count(*) over (partition by t.user_id, t.item_id) as n
    from sized t anti join exposed_quick e using (user_id, item_id) join openings p on p.user_id = t.user_id
    where pool_size > 0 and p.first_negative < t.timestamp_ms and (p.first_positive is null or p.first_positive >= t.timestamp_ms) and p.candidate <> t.item_id)
  where r = cast(floor(u * n) as bigint))
, draws as (
  select t.*, attempt, {v.u("user_id", "item_id", "attempt", "'place'", "'42'")} as u,
    {v.u("user_id", "item_id", "attempt", "'kind'", "'42'")} < prior_events / (prior_events + items) as by_event from sized t, attempts where pool_size = 0)
, drawn as (
  select d.user_id, d.item_id, d.timestamp_ms, attempt, candidate from draws d join events_at e on e.event = cast(floor(u * prior_events) as bigint) where by_event
  union all select d.user_id, d.item_id, d.timestamp_ms, attempt, candidate from draws d join catalog c on c.slot = cast(floor(u * items) as bigint) where not by_event)
, catalog_quick as (
  select d.user_id, d.item_id, d.timestamp_ms, arg_min(d.candidate, attempt) as negative_item from drawn d
  left join o on o.user_id = d.user_id and o.item_id = d.candidate
  where (o.first_positive is null or o.first_positive >= d.timestamp_ms) and d.candidate <> d.item_id group by all)
, catalog_rest as (
  select user_id, item_id, timestamp_ms, candidate as negative_item from (
    select t.user_id, t.item_id, t.timestamp_ms, c.candidate, {v.u("t.user_id", "t.item_id", "'rest'", "'42'")} as u,
      row_number() over (partition by t.user_id, t.item_id order by c.slot) - 1 as r, count(*) over (partition by t.user_id, t.item_id) as n
    from sized t anti join catalog_quick e using (user_id, item_id) cross join catalog c left join o on o.user_id = t.user_id and o.item_id = c.candidate
    where pool_size = 0 and (o.first_positive is null or o.first_positive >= t.timestamp_ms) and c.candidate <> t.item_id)
  where r = cast(floor(u * n) as bigint))
select user_id, item_id, timestamp_ms, 'exposed' as source, negative_item from exposed_quick
union all select user_id, item_id, timestamp_ms, 'exposed', negative_item from exposed_rest
union all select user_id, item_id, timestamp_ms, 'popularity', negative_item from catalog_quick
union all select user_id, item_id, timestamp_ms, 'popularity', negative_item from catalog_rest"""


@query("sample_negatives", SAMPLE_SQL)
def sample_negatives(spark, folder):
    return neg.sample_negatives(v.train(spark, folder))


@query("ranking_triples", f"""
, liked as (select distinct user_id, item_id from train where long_view = 1)
, usable as (
  select user_id, item_id, timestamp_ms, row_number() over (partition by user_id order by timestamp_ms, item_id) - 1 as idx
  from train anti join liked using (user_id, item_id) where long_view = 0)
, pos as (
  select user_id, item_id, timestamp_ms, {v.u("user_id", "item_id", "timestamp_ms", "'triple'", "'42'")} as u,
    (select count(*) from usable n where n.user_id = t.user_id and (n.timestamp_ms, n.item_id) < (t.timestamp_ms, t.item_id)) as m
  from train t where long_view = 1)
, catalog as (select item_id as candidate, row_number() over (order by item_id) - 1 as slot from (select distinct item_id from train))
, free as (
  select u.user_id, c.candidate, row_number() over (partition by u.user_id order by c.slot) - 1 as r, count(*) over (partition by u.user_id) as n
  from (select distinct user_id from pos) u cross join catalog c anti join liked l on l.user_id = u.user_id and l.item_id = c.candidate)
select p.user_id, p.item_id, p.timestamp_ms, n.item_id as negative_item, 'exposed' as source
from pos p join usable n on n.user_id = p.user_id and n.idx = cast(floor(u * m) as bigint) where m > 0
union all
select p.user_id, p.item_id, p.timestamp_ms, f.candidate, 'catalog'
from pos p join free f on f.user_id = p.user_id and f.r = cast(floor(u * f.n) as bigint) where m = 0""")
def ranking_triples(spark, folder):
    return neg.ranking_triples(v.train(spark, folder))


@query("hard_negatives", EXACT_SQL + OUTCOMES_SQL.split(", openings")[0] + """
select t.user_id, t.item_id, t.first_positive as timestamp_ms, arg_min(e.item_id, e.retrieval_rank) as negative_item, min(e.retrieval_rank) as negative_rank
from o t join exact e on e.user_id = t.user_id left join o k on k.user_id = e.user_id and k.item_id = e.item_id
where t.first_positive is not null and (k.first_positive is null or k.first_positive >= t.first_positive) and e.item_id <> t.item_id group by all""")
def hard_negatives(spark, folder):
    """From 5 deep on, so that busy users are searched several times."""
    return neg.hard_negatives(v.train(spark, folder), v.user_vectors(spark, folder), v.item_vectors(spark, folder), 5)


@query("user_history", """
, t as (select user_id, item_id, min(timestamp_ms) as timestamp_ms from train where long_view = 1 group by all)
, h as (
  select t.user_id, t.item_id, t.timestamp_ms, p.item_id as past, p.timestamp_ms as pt,
    row_number() over (partition by t.user_id, t.item_id order by p.timestamp_ms desc, p.item_id desc) as r
  from t left join train p on p.user_id = t.user_id and p.long_view = 1 and p.timestamp_ms < t.timestamp_ms)
select user_id, item_id, timestamp_ms, count(past) as history_size, coalesce(string_agg(past, ',' order by r desc), '') as history
from h where r <= 50 group by user_id, item_id, timestamp_ms""")
def user_history(spark, folder):
    return neg.user_history(v.train(spark, folder), 50).select(
        "user_id", "item_id", "timestamp_ms", F.size("history").cast("long").alias("history_size"),
        F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"),
    )


@query("final_history", """
, p as (select user_id, item_id, row_number() over (partition by user_id order by timestamp_ms desc, item_id desc) as r from train where long_view = 1)
select user_id, string_agg(item_id, ',' order by r desc) as history from p where r <= 50 group by user_id""")
def final_history(spark, folder):
    return neg.final_history(v.train(spark, folder), 50).select(
        "user_id", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history")
    )


@query("swap_weights", """
, p as (
  select event_id, context_id, long_view as y, row_number() over (partition by context_id order by score desc, item_id, timestamp_ms) as r
  from predictions where model = 'dot' and domain = 'standard')
, ideal as (select context_id, list_sum(list_transform(range(1, sum(y)::int + 1), lambda x: 1 / log2(x + 1))) as g from p group by context_id having sum(y) > 0)
select p.event_id, R6(coalesce((select sum(abs(1 / log2(p.r + 1) - 1 / log2(o.r + 1))) from p o where o.context_id = p.context_id and o.y <> p.y) / g, 0)) as swap_weight
from p left join ideal using (context_id)""")
def swap_weights(spark, folder):
    rows = v.predictions(spark, folder).where("model = 'dot' and domain = 'standard'")
    by_score = rows.withColumns({"retrieval_rank": -F.col("score"), "label": F.col("long_view")})
    return ranker.swap_weights(by_score).select("event_id", "swap_weight")


def _ranker_rows(spark, folder, split: str):
    """Observed rows of a split with features, stored."""
    log = v.split_log(spark, folder).where(F.col("split") == split) if split != "adaptation" else (
        v.part(spark, folder, "adaptation").drop("context_id", "session_position")
    )
    observed = retrieval.observed_ranking_rows(
        log, v.user_vectors(spark, folder), v.item_vectors(spark, folder), v.GAP_MINUTES, v.WINDOW_SIZE
    )
    # training rows see only what came before them; later splits see all of the training period
    return materialize(history.ranker_features(observed, v.train(spark, folder), point_in_time=split == "train"))


@query("domain_classifier")
def domain_classifier(spark, folder):
    """Weights of the training rows from a fitted domain classifier, diagnosed."""
    standard, randomized = _ranker_rows(spark, folder, "validation"), _ranker_rows(spark, folder, "adaptation")
    model = density.fit_domain_classifier(standard, randomized)
    weighted = wt.density_weights(model.probabilities(standard), model.random_prior, None)
    return wt.weight_diagnostics(weighted).withColumns(
        {"domain_auc": F.lit(model.validation_auc), "random_prior": F.lit(float(model.random_prior))}
    )


@query("pairwise_rows", ATTACHED_SQL + f"""
, c as (
  select a.context_id, a.item_id, cast(label_graded as int) as label, retrieval_rank as r, retrieval_score, coalesce(p.score, rate) as score
  from attached a left join popularity p using (item_id), train_rate)
, pool as (
  select * from (select *, row_number() over (partition by context_id, label order by {v.u("context_id", "item_id", "'pool'", "'42'")}, item_id) as place from c)
  where place <= 64)
, ideal as (
  select context_id, sum((power(2, label) - 1) / log2(pos + 1)) as g
  from (select context_id, label, row_number() over (partition by context_id order by label desc) as pos from c) where pos <= 200 group by context_id)
, below as (select a.context_id, a.label, sum(b.n) as n from (select context_id, label, count(*) as n from c group by all) a
  join (select context_id, label, count(*) as n from c group by all) b on b.context_id = a.context_id and b.label < a.label group by all)
, drawn as (
  select w.context_id, w.item_id as winner_item, l.item_id as loser_item, w.label as winner_label, l.label as loser_label, w.r, l.r as lr,
    w.retrieval_score - l.retrieval_score as d_retrieval_score, w.score - l.score as d_score,
    row_number() over (partition by w.context_id, w.item_id order by {v.u("w.context_id", "w.item_id", "l.item_id", "'pair'", "'42'")}, l.item_id) as k
  from c w join pool l on l.context_id = w.context_id and l.label < w.label)
, weighed as (
  select d.*, (power(2, winner_label) - power(2, loser_label)) / g
      * abs(case when r <= 200 then 1 / log2(r + 1) else 0 end - case when lr <= 200 then 1 / log2(lr + 1) else 0 end) as delta,
    count(*) over (partition by context_id, winner_item) as met
  from drawn d join ideal using (context_id) where k <= 16)
select w.context_id, winner_item, loser_item, winner_label, loser_label, R6(delta) as delta_ndcg, R6(delta * b.n / met) as pair_weight,
  R6(d_retrieval_score) as d_retrieval_score, R6(d_score) as d_score
from weighed w join below b on b.context_id = w.context_id and b.label = w.winner_label""")
def pairwise_rows(spark, folder):
    labelled = attach_labels(candidates_of(spark, folder), v.part(spark, folder, "standard_test"), "graded")
    return ranker.pairwise_rows(popularity_score(labelled, v.train(spark, folder)), ("retrieval_score", "score"))


@query("linear_ranker")
def linear_ranker(spark, folder):
    model = ranker.fit_linear_ranker(_ranker_rows(spark, folder, "train"))
    return ranking_metrics(model.predict(_ranker_rows(spark, folder, "standard_test")))


@query("feature_importance")
def feature_importance(spark, folder):
    rows = _ranker_rows(spark, folder, "train")
    return ranker.fit_linear_ranker(rows).feature_importance(rows)


@query("clip_sweep")
def clip_sweep(spark, folder):
    adaptation = _ranker_rows(spark, folder, "adaptation")
    domain = density.fit_domain_classifier(_ranker_rows(spark, folder, "validation"), adaptation)
    train = materialize(domain.probabilities(_ranker_rows(spark, folder, "train")))
    return workflows.clip_sweep(train, adaptation, domain.random_prior)[0]


@query("probability_model")
def probability_model(spark, folder):
    model = ranker.fit_probability_model(_ranker_rows(spark, folder, "train"), _ranker_rows(spark, folder, "validation"))
    return probability_metrics(model.predict(_ranker_rows(spark, folder, "standard_test")), "long_view")


@query("implicit_factors")
def implicit_factors(spark, folder):
    users, items = workflows.implicit_factors(v.train(spark, folder))
    rows = v.split_log(spark, folder).where("split = 'standard_test'").select("event_id", "user_id", "item_id")
    return pop.pair_score(rows, users, items)


@query("stream_log_audit", """
select source_log, max(is_random) as is_random, count(*) as rows, min(date) as min_date, max(date) as max_date,
  min(timestamp_ms) as min_timestamp_ms, max(timestamp_ms) as max_timestamp_ms from impressions group by source_log""")
def stream_log_audit(spark, folder):
    """The log audit over a file stream that is drained once."""
    path, schema = _stream_source(spark, folder)
    stream = log_stream.read_log_stream(spark, path, schema)
    return log_stream.run_to_table(log_stream.streaming_log_audit(stream), "complete").drop("users", "items")


@query("stream_quarantine", """
select case when is_random = expected then 'valid' else 'rejected' end as sink, is_random, expected as expected_random, count(*) as rows
from (select is_random, cast(event_id % 3 = 0 as int) as expected from impressions) group by all""")
def stream_quarantine(spark, folder):
    """Both sinks of a drained stream. Logs announce every third event as random, also before the random policy began."""
    path, schema = _stream_source(spark, folder)
    stream = log_stream.read_log_stream(spark, path, schema)
    parts = log_stream.drain_parts(stream.withColumn("expected_random", (F.col("event_id") % 3 == 0).cast("int")))
    return parts.groupBy("sink", "is_random", "expected_random").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_sessions", f"""
, g as (
  select user_id, timestamp_ms, long_view,
    case when timestamp_ms - lag(timestamp_ms) over w <= {v.GAP_MINUTES} * 60000 then 0 else 1 end as starts
  from impressions window w as (partition by user_id order by timestamp_ms, item_id))
, s as (select *, sum(starts) over (partition by user_id order by timestamp_ms rows unbounded preceding) as session from g)
select user_id, min(timestamp_ms) as started_ms, max(timestamp_ms) as ended_ms, count(*) as rows, cast(sum(long_view) as bigint) as positives
from s group by user_id, session""")
def stream_sessions(spark, folder):
    """Sessions of a drained stream; the SQL states the batch rule."""
    path, schema = _stream_source(spark, folder)
    return log_stream.run_to_table(log_stream.streaming_sessions(log_stream.read_log_stream(spark, path, schema), v.GAP_MINUTES), "complete")


@query("stream_distinct_counts", """
select source_log, rows, users, items, true as users_close, true as items_close
from (select source_log, count(*) as rows, count(distinct user_id) as users, count(distinct item_id) as items from impressions group by all)""")
def stream_distinct_counts(spark, folder):
    """Daily sketches of a drained stream, merged per log, beside exact counts: within five standard errors, 8 %."""
    path, schema = _stream_source(spark, folder)
    stream = log_stream.read_log_stream(spark, path, schema)
    daily = log_stream.run_to_table(log_stream.streaming_sketches(stream, ["source_log", "date"]), "complete")
    exact = v.impressions(spark, folder).groupBy("source_log").agg(
        F.count_distinct("user_id").alias("exact_users"), F.count_distinct("item_id").alias("exact_items")
    )

    def close(name):
        return F.abs(F.col(name) - F.col(f"exact_{name}")) <= 0.08 * F.col(f"exact_{name}")

    return log_stream.merged_counts(daily, ["source_log"]).join(exact, "source_log").select(
        "source_log", "rows", F.col("exact_users").alias("users"), F.col("exact_items").alias("items"),
        close("users").alias("users_close"), close("items").alias("items_close"),
    )


def _stream_source(spark, folder):
    """The impressions as a stored table that a file stream can follow: its folder and schema."""
    stored = materialize(v.impressions(spark, folder))
    return stored.inputFiles()[0].rsplit("/", 1)[0], stored.schema
