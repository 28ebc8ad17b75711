"""Queries for popularity, histories and ranking features."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposura.functions.columns import primary_category
from exposura.operators import history, popularity as pop
from exposura.plans import views as v
from exposura.plans.registry import query
from exposura.plans.workflows import popularity_baseline
from exposura.session import materialize


@query("popularity", "select item_id, exposures, positives, R6(score) as score from popularity")
def popularity(spark, folder):
    return pop.popularity(v.train(spark, folder))


@query("popularity_by_exposure", "select item_id, count(*) as exposures from train group by item_id")
def popularity_by_exposure(spark, folder):
    return pop.popularity(v.train(spark, folder)).select("item_id", "exposures")


@query("popularity_score", """
select event_id, R6(coalesce(score, rate)) as score
from split_log left join popularity using (item_id), train_rate where split = 'standard_test'""")
def popularity_score(spark, folder):
    rows = v.split_log(spark, folder).where("split = 'standard_test'").select("event_id", "item_id")
    return pop.popularity_score(rows, v.train(spark, folder)).select("event_id", "score")


@query("factor_score", """
select event_id, R6(coalesce(list_dot_product(u.embedding, i.embedding), rate)) as score
from split_log left join user_vectors u using (user_id) left join item_vectors i using (item_id), train_rate
where split = 'standard_test'""")
def factor_score(spark, folder):
    rows = v.split_log(spark, folder).where("split = 'standard_test'").select("event_id", "user_id", "item_id")
    rate = v.train(spark, folder).agg(F.avg("long_view")).scalar()
    scored = pop.pair_score(rows, v.user_vectors(spark, folder), v.item_vectors(spark, folder), fallback=float("nan"))
    return scored.select("event_id", F.nanvl("score", rate).alias("score"))


PRIOR_SQL = """
, counts as (select item_id, count(*) as n from train where long_view = 1 group by item_id),
prior as (select item_id, coalesce(ln(1 + n) / (select max(ln(1 + n)) from counts), 0) as prior
  from item_vectors left join counts using (item_id))
"""


@query("popularity_prior", PRIOR_SQL + "select item_id, R6(prior) as prior from prior")
def popularity_prior(spark, folder):
    return pop.popularity_prior(v.train(spark, folder), v.item_vectors(spark, folder))


HISTORY_SQL = """
, h as (
  select *, count(*) over i as hist_item_exposure, coalesce(sum(long_view) over i, 0) as ip,
    count(*) over u as hist_user_exposure, coalesce(sum(long_view) over u, 0) as up,
    count(*) over g as gn, coalesce(sum(long_view) over g, 0) as gp
  from {log}
  window i as (partition by item_id order by timestamp_ms range between unbounded preceding and 1 preceding),
    u as (partition by user_id order by timestamp_ms range between unbounded preceding and 1 preceding),
    g as (order by timestamp_ms range between unbounded preceding and 1 preceding)),
rates as (select *, case when gn > 0 then gp / gn else 0 end as g from h)
"""


@query("historical_features", HISTORY_SQL.format(log="impressions") + """
select event_id, hist_item_exposure, hist_user_exposure, R6((ip + 20 * g) / (hist_item_exposure + 20)) as hist_item_reward_rate,
  R6((up + 20 * g) / (hist_user_exposure + 20)) as hist_user_long_view_rate, timestamp_ms - 1 as feature_cutoff_ms from rates""")
def historical_features(spark, folder):
    return history.historical_features(v.impressions(spark, folder)).select(
        "event_id", "hist_item_exposure", "hist_user_exposure", "hist_item_reward_rate", "hist_user_long_view_rate",
        "feature_cutoff_ms",
    )


@query("historical_features_ties", HISTORY_SQL.format(log="impressions_big") + """
select timestamp_ms, count(*) as rows, cast(sum(hist_item_exposure) as bigint) as item_exposure,
  cast(sum(hist_user_exposure) as bigint) as user_exposure,
  R6(avg((ip + 20 * g) / (hist_item_exposure + 20))) as item_rate, R6(avg((up + 20 * g) / (hist_user_exposure + 20))) as user_rate
from rates group by timestamp_ms""")
def historical_features_ties(spark, folder):
    log = materialize(v.impressions_big(spark, folder))  # a join that counting, windows and the prior would each run again
    return history.historical_features(log).groupBy("timestamp_ms").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("hist_item_exposure").alias("item_exposure"),
        F.sum("hist_user_exposure").alias("user_exposure"), F.avg("hist_item_reward_rate").alias("item_rate"),
        F.avg("hist_user_long_view_rate").alias("user_rate"),
    )


@query("asof_features", """
, cum as (
  select item_id, timestamp_ms, sum(count(*)) over w as n, sum(sum(long_view)) over w as p from train
  group by item_id, timestamp_ms window w as (partition by item_id order by timestamp_ms))
select e.event_id, cast(coalesce(c.n, 0) as bigint) as prior_exposures, cast(coalesce(c.p, 0) as bigint) as prior_positives
from split_log e asof left join cum c on e.item_id = c.item_id and e.timestamp_ms > c.timestamp_ms""")
def asof_features(spark, folder):
    rows = v.split_log(spark, folder).select("event_id", "item_id", "timestamp_ms")
    return history.asof_totals(rows, v.train(spark, folder), ["item_id"], "prior_exposures", "prior_positives").select(
        "event_id", "prior_exposures", "prior_positives"
    )


PIT_SQL = """
, ic as (select item_id, timestamp_ms, sum(count(*)) over w as n, sum(sum(long_view)) over w as p from train
  group by item_id, timestamp_ms window w as (partition by item_id order by timestamp_ms)),
uc as (select user_id, timestamp_ms, sum(count(*)) over w as n, sum(sum(long_view)) over w as p from train
  group by user_id, timestamp_ms window w as (partition by user_id order by timestamp_ms)),
gc as (select timestamp_ms, sum(count(*)) over w as n, sum(sum(long_view)) over w as p from train
  group by timestamp_ms window w as (order by timestamp_ms)),
pit as (
  select e.*, coalesce(ic.n, 0) as item_n, coalesce(ic.p, 0) as item_p, coalesce(uc.n, 0) as user_n, coalesce(uc.p, 0) as user_p,
    coalesce(gc.p / gc.n, 0) as g
  from split_log e asof left join ic on e.item_id = ic.item_id and e.timestamp_ms > ic.timestamp_ms
    asof left join uc on e.user_id = uc.user_id and e.timestamp_ms > uc.timestamp_ms
    asof left join gc on e.timestamp_ms > gc.timestamp_ms)
"""


@query("point_in_time_features", PIT_SQL + """
select event_id, cast(item_n as bigint) as hist_item_exposure, cast(user_n as bigint) as hist_user_exposure,
  R6((item_p + 20 * g) / (item_n + 20)) as hist_item_reward_rate, R6((user_p + 20 * g) / (user_n + 20)) as hist_user_long_view_rate
from pit""")
def point_in_time_features(spark, folder):
    rows = v.split_log(spark, folder).select("event_id", "user_id", "item_id", "timestamp_ms")
    return history.point_in_time_aggregates(rows, v.train(spark, folder)).select(
        "event_id", "hist_item_exposure", "hist_user_exposure", "hist_item_reward_rate", "hist_user_long_view_rate"
    )


AGGREGATES_SQL = """
, item_agg as (select item_id, count(*) as hist_item_exposure, (sum(long_view) + 20 * any_value(rate)) / (count(*) + 20) as hist_item_reward_rate
  from train, train_rate group by item_id),
user_agg as (select user_id, count(*) as hist_user_exposure, (sum(long_view) + 20 * any_value(rate)) / (count(*) + 20) as hist_user_long_view_rate
  from train, train_rate group by user_id)
"""


@query("training_aggregates", AGGREGATES_SQL + """
select 'item' as entity, item_id as id, hist_item_exposure as exposure, R6(hist_item_reward_rate) as rate from item_agg
union all select 'user', user_id, hist_user_exposure, R6(hist_user_long_view_rate) from user_agg""")
def training_aggregates(spark, folder):
    items, users = history.training_aggregates(v.train(spark, folder))
    return items.select(
        F.lit("item").alias("entity"), F.col("item_id").alias("id"), F.col("hist_item_exposure").alias("exposure"),
        F.col("hist_item_reward_rate").alias("rate"),
    ).unionByName(
        users.select(
            F.lit("user").alias("entity"), F.col("user_id").alias("id"), F.col("hist_user_exposure").alias("exposure"),
            F.col("hist_user_long_view_rate").alias("rate"),
        )
    )


@query("ranker_features", AGGREGATES_SQL + """
select event_id, cast(coalesce(hist_item_exposure, 0) as double) as hist_item_exposure, R6(coalesce(hist_item_reward_rate, 0)) as hist_item_reward_rate,
  cast(coalesce(hist_user_exposure, 0) as double) as hist_user_exposure, R6(coalesce(hist_user_long_view_rate, 0)) as hist_user_long_view_rate,
  cast(hour(ts) as double) as hour, cast(isodow(ts) - 1 as double) as day_of_week, cast(tab as double) as tab,
  cast(session_position as double) as session_position, R6(coalesce(p_retailprice, 0)) as video_duration,
  R6(coalesce(c_acctbal, 0)) as fans_user_num, 0.0::double as retrieval_score, 0.0::double as register_days
from (select *, make_timestamp(timestamp_ms * 1000) as ts from contexts where slice = 'standard_test')
  left join item_agg using (item_id) left join user_agg using (user_id)
  left join part on p_partkey = item_id left join customer on c_custkey = user_id""")
def ranker_features(spark, folder):
    users = v.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("fans_user_num"))
    items = v.table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("video_duration"))
    rows = v.part(spark, folder, "standard_test")
    features = history.ranker_features(rows, v.train(spark, folder), users, items, use_side_features=True)
    return features.select(
        "event_id", "hist_item_exposure", "hist_item_reward_rate", "hist_user_exposure", "hist_user_long_view_rate", "hour",
        "day_of_week", "tab", "session_position", "video_duration", "fans_user_num", "retrieval_score", "register_days",
    )


@query("popularity_weights", PIT_SQL + """
, raw as (select event_id, 1 / sqrt(item_n + 1.0::double) as w from pit)
select event_id, R6(w / (select avg(w) from raw)) as weight from raw""")
def popularity_weights(spark, folder):
    rows = v.split_log(spark, folder).select("event_id", "user_id", "item_id", "timestamp_ms")
    features = history.asof_totals(rows, v.train(spark, folder), ["item_id"], "hist_item_exposure", "_positives")
    return pop.popularity_weights(features).select("event_id", "weight")


@query("standardize_features", """
, s as (select avg(p_size) as ms, stddev_pop(p_size) as ss, avg(p_retailprice) as mp, stddev_pop(p_retailprice) as sp from part)
select p_partkey, R6((p_size - ms) / case when ss > 1e-6 then ss else 1 end) as p_size,
  R6((p_retailprice - mp) / case when sp > 1e-6 then sp else 1 end) as p_retailprice, 0.0::double as p_brand from part, s""")
def standardize_features(spark, folder):
    # the text column cannot be coerced, so it is a flat zero feature
    return pop.standardize_features(v.table(spark, folder, "part"), ["p_size", "p_retailprice", "p_brand", "absent"], "p_partkey")


@query("recent_activity", """
select event_id, count(*) over w as recent_events, cast(coalesce(sum(long_view) over w, 0) as bigint) as recent_positives,
  cast(row_number() over (partition by user_id, item_id order by timestamp_ms) = 1 as int) as is_novel,
  timestamp_ms - lag(timestamp_ms) over (partition by user_id, category order by timestamp_ms) as ms_since_category
from (select event_id, user_id, item_id, timestamp_ms, long_view, coalesce(category, 'unknown') as category
  from impressions left join item_categories using (item_id))
window w as (partition by user_id order by timestamp_ms range between 86400000 preceding and 1 preceding)""")
def recent_activity(spark, folder):
    tags = v.item_tags(spark, folder).select("item_id", primary_category(F.col("tag")).alias("category"))
    rows = v.impressions(spark, folder).select("event_id", "user_id", "item_id", "timestamp_ms", "long_view")
    return history.recent_activity(rows.join(tags, "item_id", "left"), window_ms=86_400_000).select(
        "event_id", "recent_events", "recent_positives", "is_novel", "ms_since_category"
    )


@query("popularity_baseline", """
, scored as (
  select e.*, case when split = 'standard_test' then 'standard' else 'randomized' end as domain, user_id || ':' || date as grp,
    coalesce(score, rate) as score
  from split_log e left join popularity using (item_id), train_rate where split in ('standard_test', 'randomized_test')),
r as (select *, row_number() over (partition by domain, grp order by score desc, item_id, timestamp_ms) as rank,
    count(*) over (partition by domain, grp) as n, sum(long_view) over (partition by domain, grp) as pos from scored),
g as (select domain, grp, k, any_value(n) as n,
    sum(case when rank <= k then long_view / log2(rank + 1) else 0 end)
      / list_sum(list_transform(range(1, least(k, any_value(pos))::int + 1), lambda x: 1 / log2(x + 1))) as ndcg,
    sum(case when rank <= k then long_view else 0 end) / any_value(pos) as recall,
    coalesce(1.0::double / min(case when long_view = 1 and rank <= k then rank end), 0.0) as mrr
  from r, ks where n >= 2 and pos > 0 group by domain, grp, k)
select domain, k, R6(avg(ndcg)) as ndcg, R6(avg(recall)) as recall, R6(avg(mrr)) as mrr, count(*) as eligible_groups,
  cast(sum(n) as bigint) as eligible_rows from g group by all""")
def baseline(spark, folder):
    return popularity_baseline(v.split_log(spark, folder), v.BOUNDS)
