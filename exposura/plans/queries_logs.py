"""Queries over the log itself: loading, splits, audits, reports of exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposura.functions.columns import primary_category
from exposura.operators import audit, contexts, splits
from exposura.plans import views as v
from exposura.plans.registry import query
from exposura.sources import artifacts, files, impressions as source

LOG_COLUMNS = (
    "user_id", "item_id", "timestamp_ms", "date", "tab", "long_view", "is_click", "is_like", "is_follow", "is_comment",
    "is_forward", "is_hate", "is_profile_enter", "play_time_ms", "duration_ms", "is_random", "source_log",
)


@query("load_impressions", f"select {', '.join(LOG_COLUMNS)} from impressions")
def load_impressions(spark, folder):
    back = {new: old for old, new in source.RENAMED.items()}
    logs = v.impressions(spark, folder).select(*LOG_COLUMNS)
    result = None
    for name, flag in source.LOG_POLICY.items():
        raw = logs.where(F.col("source_log") == name).drop("source_log").withColumnsRenamed(back)
        log = source.canonical_log(raw.select(*[F.col(c).cast("string") for c in raw.columns]), name, flag)
        result = log if result is None else result.unionByName(log)
    return result.select(*LOG_COLUMNS)


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _files_sql() -> str:
    return " union all ".join(
        f"select '{t}.parquet' as file, 'parquet' as kind, (select string_agg(column_name, ',') from (describe {t})) as header, "
        f"(select count(*) from {t}) as records" for t in TABLES
    )


@query("file_summary", f"select * from ({_files_sql()})")
def file_summary(spark, folder):
    """Headers and record counts of all given tables, read off the files one by one; a table may be a folder of files."""
    report = files.table_report(files.file_report(spark, folder), folder)
    return report.where(F.col("table").isin(*[f"{t}.parquet" for t in TABLES])).select(
        F.col("table").alias("file"), "kind", F.array_join("header", ",").alias("header"), "records"
    )


@query("artifact_manifest")
def artifact_manifest(spark, folder):
    return artifacts.artifact_manifest(spark, folder)


@query("split_manifest", "select user_id, item_id, timestamp_ms, date, is_random, source_log, split from split_log")
def split_manifest(spark, folder):
    return source.split_manifest(v.split_log(spark, folder))


@query("assign_splits", "select event_id, date, is_random, split from split_log")
def assign_splits(spark, folder):
    return v.split_log(spark, folder).select("event_id", "date", "is_random", "split")


@query("validate_splits", """
select count(*) filter (split = 'train' and is_random = 1) as random_rows_in_train,
  count(*) filter (split = 'randomized_test' and is_random = 0) as standard_rows_in_randomized,
  max(date) filter (split = 'train') as train_max_date,
  min(date) filter (split in ('validation', 'standard_test')) as later_standard_min_date,
  count(distinct split) as splits_present, count(*) filter (split is null) as unknown_split_rows,
  random_rows_in_train = 0 and standard_rows_in_randomized = 0 and train_max_date < later_standard_min_date
    and splits_present = 4 and unknown_split_rows = 0 as valid
from split_log""")
def validate_splits(spark, folder):
    return splits.validate_splits(v.split_log(spark, folder))


@query("random_domain_slices", """
select case when date <= 20240122 then 'adaptation' else 'holdout' end as domain_slice, count(*) as rows,
  min(date) as min_date, max(date) as max_date, cast(sum(long_view) as bigint) as positives
from split_log where split = 'randomized_test' group by 1""")
def random_domain_slices(spark, folder):
    return splits.random_domain_slices(v.split_log(spark, folder), v.BOUNDS).groupBy("domain_slice").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.sum("long_view").alias("positives"),
    )


@query("temporal_slice", """
, ts as (select distinct timestamp_ms from train),
pick as (select timestamp_ms as cutoff from ts order by timestamp_ms
  limit 1 offset (select least(greatest(cast(floor(count(*) * 0.8::double) as bigint), 1), count(*) - 1) - 1 from ts))
select event_id, timestamp_ms, case when timestamp_ms <= cutoff then 'source' else 'ranker' end as ranker_slice
from train, pick""")
def temporal_slice(spark, folder):
    return splits.temporal_slice(v.train(spark, folder)).select("event_id", "timestamp_ms", "ranker_slice")


@query("split_summary", """
select split, count(*) as rows, count(distinct user_id) as users, count(distinct item_id) as items, min(date) as min_date,
  max(date) as max_date, min(timestamp_ms) as min_timestamp_ms, max(timestamp_ms) as max_timestamp_ms
from split_log group by split""")
def split_summary(spark, folder):
    return splits.split_summary(v.split_log(spark, folder))


@query("coverage_summary", """
select source_log, is_random, count(*) as rows, count(distinct user_id) as users, count(distinct item_id) as items,
  min(date) as min_date, max(date) as max_date from impressions group by all""")
def coverage_summary(spark, folder):
    return audit.coverage_summary(v.impressions(spark, folder))


@query("log_audit", """
select source_log, max(is_random) as is_random, count(*) as rows, min(date) as min_date, max(date) as max_date,
  min(timestamp_ms) as min_timestamp_ms, max(timestamp_ms) as max_timestamp_ms, count(distinct user_id) as users,
  count(distinct item_id) as items from impressions group by source_log""")
def log_audit(spark, folder):
    return audit.log_audit(v.impressions(spark, folder))


@query("duplicate_keys", """
select cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicate_rows, count(*) filter (n > 1) as duplicate_keys
from (select user_id, item_id, timestamp_ms, count(*) as n from impressions_big group by all)""")
def duplicate_keys(spark, folder):
    return audit.duplicate_keys(v.impressions_big(spark, folder).withColumn("source_log", F.lit("big")))


@query("missing_values", """
select 'events' as table_name, column_name, rows, missing from (
  select unnest([{'column_name': 'event_id', 'rows': count(*), 'missing': count(*) - count(event_id)},
    {'column_name': 'ts', 'rows': count(*), 'missing': count(*) - count(ts)},
    {'column_name': 'user_id', 'rows': count(*), 'missing': count(*) - count(user_id)},
    {'column_name': 'event_type', 'rows': count(*), 'missing': count(*) - count(event_type)},
    {'column_name': 'value', 'rows': count(*), 'missing': count(*) - count(value)},
    {'column_name': 'props', 'rows': count(*), 'missing': count(*) - count(props)}], recursive := true) from events)
union all
select 'item_tags', column_name, rows, missing from (
  select unnest([{'column_name': 'item_id', 'rows': count(*), 'missing': count(*) - count(item_id)},
    {'column_name': 'tag', 'rows': count(*), 'missing': count(*) - count(tag)}], recursive := true) from item_tags)""")
def missing_values(spark, folder):
    tables = {"events": v.table(spark, folder, "events"), "item_tags": v.item_tags(spark, folder)}
    return audit.missing_values(tables).drop("data_type")


@query("reward_rates", """
select source_log, is_random, count(*) as rows, R6(avg(long_view)) as long_view_rate, R6(avg(is_click)) as click_rate,
  R6(avg(is_like)) as like_rate from impressions group by all""")
def reward_rates(spark, folder):
    return audit.reward_rates(v.impressions(spark, folder))


@query("reward_rates_by_tab", """
select tab, is_random, count(*) as rows, R6(avg(long_view)) as long_view_rate, R6(avg(is_click)) as click_rate,
  R6(avg(is_like)) as like_rate from impressions group by all""")
def reward_rates_by_tab(spark, folder):
    return audit.reward_rates(v.impressions(spark, folder), ["tab", "is_random"])


@query("reward_shift", """
select tab, R6(standard) as standard, R6(randomized) as randomized, R6(standard - randomized) as shift from (
  select tab, coalesce(avg(long_view) filter (is_random = 0), 0) as standard,
    coalesce(avg(long_view) filter (is_random = 1), 0) as randomized from impressions group by tab)""")
def reward_shift(spark, folder):
    return audit.reward_shift(v.impressions(spark, folder))


@query("daily_rates", """
select date, R6(avg(long_view) filter (source_log = 'standard_early')) as standard_early,
  R6(avg(long_view) filter (source_log = 'standard_late')) as standard_late,
  R6(avg(long_view) filter (source_log = 'random')) as random from impressions group by date""")
def daily_rates(spark, folder):
    return audit.daily_rates(v.impressions(spark, folder))


@query("policy_overlap", """
, seen as (
  select 'users' as entity, user_id as id, bool_or(is_random = 0) as s, bool_or(is_random = 1) as r from impressions group by 2
  union all select 'items', item_id, bool_or(is_random = 0), bool_or(is_random = 1) from impressions group by 2)
select entity, count(*) filter (s) as standard_unique, count(*) filter (r) as randomized_unique,
  count(*) filter (s and r) as intersection from seen group by entity""")
def policy_overlap(spark, folder):
    return audit.policy_overlap(v.impressions(spark, folder))


@query("activity_by_policy", """
select 'user' as entity, user_id as id, count(*) filter (is_random = 0) as standard, count(*) filter (is_random = 1) as randomized
from impressions group by user_id
union all select 'item', item_id, count(*) filter (is_random = 0), count(*) filter (is_random = 1) from impressions group by item_id""")
def activity_by_policy(spark, folder):
    log = v.impressions(spark, folder)
    parts = [
        audit.activity_by_policy(log, key).select(F.lit(name).alias("entity"), F.col(key).alias("id"), "standard", "randomized")
        for name, key in (("user", "user_id"), ("item", "item_id"))
    ]
    return parts[0].unionByName(parts[1])


@query("tab_distribution", """
select tab, count(*) filter (source_log = 'standard_early') as standard_early,
  count(*) filter (source_log = 'standard_late') as standard_late, count(*) filter (source_log = 'random') as random
from impressions group by tab""")
def tab_distribution(spark, folder):
    return audit.tab_distribution(v.impressions(spark, folder))


@query("exposure_curve", """
, c as (select is_random, item_id, count(*) as exposures from impressions group by all)
select *, row_number() over (partition by is_random order by exposures desc, item_id) as rank from c""")
def exposure_curve(spark, folder):
    return audit.exposure_curve(v.impressions(spark, folder))


@query("item_exposure_profile", """
, c as (select item_id, count(*) as exposures, count(*) filter (is_random = 0) as s, count(*) filter (is_random = 1) as r
  from impressions group by item_id),
p as (select *, row_number() over (order by exposures, item_id) as pos, count(*) over () as n, sum(s) over () as ts, sum(r) over () as tr from c)
select item_id, exposures, R6(s / ts) as standard_frequency, R6(r / tr) as randomized_frequency,
  R6(pos / n) as exposure_percentile, cast(ceil(pos * 10 / n) as int) as popularity_decile from p""")
def item_exposure_profile(spark, folder):
    return audit.item_exposure_profile(v.impressions(spark, folder))


@query("leakage_audit", """
, cols as (
  select 'interactions' as table_name, unnest(['event_id', 'user_id', 'item_id', 'timestamp_ms', 'date', 'tab', 'long_view',
    'is_click', 'is_like', 'is_follow', 'is_comment', 'is_forward', 'is_hate', 'is_profile_enter', 'play_time_ms',
    'duration_ms', 'value', 'is_random', 'source_log']) as column_name, (select count(*) from impressions) as rows
  union all select 'items', unnest(['item_id', 'tag']), (select count(*) from item_tags)
  union all select 'parts', unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']), (select count(*) from part))
select table_name, column_name, case when column_name in ('user_id', 'item_id') then 'identifier only'
    when table_name = 'interactions' and column_name in ('timestamp_ms', 'date', 'tab') then 'allowed exposure-time context'
    when table_name = 'interactions' then 'excluded' when column_name = 'tag' then 'analysis only'
    else 'excluded from primary models' end as status, rows,
  case when column_name = 'tag' then (select count(*) from item_tags where tag is null) else 0 end as missing
from cols""")
def leakage_audit(spark, folder):
    tables = {
        "interactions": v.impressions(spark, folder), "items": v.item_tags(spark, folder), "parts": v.table(spark, folder, "part"),
    }
    return audit.leakage_audit(tables).drop("reason")


@query("primary_category", "select item_id, tag, category from item_tags join item_categories using (item_id)")
def categories(spark, folder):
    return v.item_tags(spark, folder).withColumn("category", primary_category(F.col("tag")))


@query("ranking_contexts", """
select event_id, session_position, context_id from contexts where slice = 'standard_test'""")
def ranking_contexts(spark, folder):
    return v.part(spark, folder, "standard_test").select("event_id", "session_position", "context_id")


@query("context_window_sensitivity", """
, windows as (select unnest([10, 20, 50]) as window_size),
sized as (
  select window_size, user_id || ':' || cast(session as bigint) || ':' || (session_position // window_size) as context_id, long_view
  from positions, windows where slice = 'standard_test'),
per as (select window_size, context_id, count(*) as n, sum(long_view) as p from sized group by all)
select window_size, count(*) as contexts, cast(sum(n) as bigint) as rows, count(*) filter (n >= 2 and p > 0) as eligible_contexts from per group by window_size""")
def context_window_sensitivity(spark, folder):
    log = v.split_log(spark, folder).where("split = 'standard_test'")
    return contexts.window_size_report(log, (10, 20, 50), v.GAP_MINUTES)


@query("sample_contexts", f"""
, ids as (select distinct context_id, {v.u("context_id", "'42'")} as draw from contexts where slice = 'standard_test'),
chosen as (select context_id from ids order by draw limit 50)
select event_id, context_id from contexts join chosen using (context_id) where slice = 'standard_test'""")
def sample_contexts(spark, folder):
    return contexts.sample_contexts(v.part(spark, folder, "standard_test"), 50).select("event_id", "context_id")


@query("context_start", """
select context_id, user_id, item_id, timestamp_ms from contexts where slice = 'standard_test'
qualify row_number() over (partition by context_id order by timestamp_ms, item_id) = 1""")
def context_start(spark, folder):
    return contexts.context_starts(v.part(spark, folder, "standard_test")).select("context_id", "user_id", "item_id", "timestamp_ms")
