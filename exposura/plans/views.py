"""Inputs of the registered queries, derived from the given tables, for Spark and for the SQL check.

Every view covers its whole table. ``PRELUDE`` states the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposura.operators import bootstrap
from exposura.operators.contexts import ranking_contexts
from exposura.operators.popularity import pair_score, popularity_score
from exposura.operators.splits import SplitBounds, random_domain_slices, stored_splits
from exposura.session import file_stamp, stored_once

BOUNDS = SplitBounds(
    train_end=20240114,
    validation=(20240115, 20240122),
    standard_test=(20240123, 20240130),
    randomized_test=(20240115, 20240130),
    adaptation_end=20240122,
    holdout_start=20240123,
)
GAP_MINUTES = 1440
WINDOW_SIZE = 20
N_ACTIONS = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _epoch_ms(ts: str) -> Column:
    """Milliseconds of a zone-free timestamp, independent of the session time zone."""
    day = F.unix_date(F.col(ts).cast("date")).cast("bigint") * 86_400_000
    seconds = F.expr(f"extract(SECOND FROM {ts})").cast("decimal(10,6)")
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(seconds * 1000).cast("bigint")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def impressions(spark: SparkSession, folder: str) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    date = F.date_format("ts", "yyyyMMdd").cast("int")
    rows = table(spark, folder, "events").select(
        "event_id", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        _epoch_ms("ts").alias("timestamp_ms"), date.alias("date"),
        (event % 5).cast("int").alias("tab"),
        _flag(kind.isin("view", "purchase")).alias("long_view"),
        _flag(kind.isin("click", "view", "purchase")).alias("is_click"),
        _flag(event % 7 == 0).alias("is_like"), _flag(event % 11 == 0).alias("is_follow"),
        _flag(event % 13 == 0).alias("is_comment"), _flag(event % 17 == 0).alias("is_forward"),
        _flag(event % 23 == 0).alias("is_hate"), _flag(event % 19 == 0).alias("is_profile_enter"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("play_time_ms"),
        F.lit(60000).cast("bigint").alias("duration_ms"),
        F.col("value"),
    )
    random = (event % 3 == 0) & (F.col("date") >= 20240115)
    return rows.withColumn("is_random", _flag(random)).withColumn(
        "source_log",
        F.when(F.col("is_random") == 1, "random").when(F.col("date") <= 20240114, "standard_early").otherwise("standard_late"),
    )


def split_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with its splits: a stored table that is checked once for all queries of a session."""
    made_of = ("events", folder, file_stamp(spark, f"{folder}/events.parquet"))
    return stored_splits(impressions(spark, folder), BOUNDS, made_of)


def train(spark: SparkSession, folder: str) -> DataFrame:
    return split_log(spark, folder).where("split = 'train'")


def part(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of a split with contexts; ``holdout`` and ``adaptation`` are slices of the randomized split."""
    if split in ("holdout", "adaptation"):
        rows = random_domain_slices(split_log(spark, folder), BOUNDS).where(F.col("domain_slice") == split).drop("domain_slice")
    else:
        rows = split_log(spark, folder).where(F.col("split") == split)
    return ranking_contexts(rows, GAP_MINUTES, WINDOW_SIZE)


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def user_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector, reversed, as a user; the id mapping leaves each seventh user id without one."""
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        (vec + F.floor(vec / 6)).cast("bigint").alias("user_id"), F.reverse("embedding").alias("embedding")
    )


def item_tags(spark: SparkSession, folder: str) -> DataFrame:
    item, name = F.col("vec_id"), F.concat(F.lit("c"), (F.col("vec_id") % 10).cast("string"))
    kind = item % 6
    tag = (
        F.when(item % 20 == 19, F.lit(None).cast("string"))
        .when(kind == 0, F.concat(F.lit("['"), name, F.lit("','x']")))
        .when(kind == 1, F.concat(name, F.lit(",c2")))
        .when(kind == 2, F.concat(name, F.lit("|c2")))
        .when(kind == 3, F.concat(name, F.lit(";c2")))
        .when(kind == 4, F.concat(F.lit(" "), name, F.lit(" ")))
        .otherwise(F.lit("[]"))
    )
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), tag.alias("tag"))


def scored_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Standard test and randomized holdout rows with contexts, as ``domain``."""
    log = split_log(spark, folder)
    holdout = (F.col("split") == "randomized_test") & (F.col("date") >= BOUNDS.holdout_start)
    domain = F.when(F.col("split") == "standard_test", "standard").when(holdout, "randomized")
    rows = log.withColumn("domain", domain).where(F.col("domain").isNotNull())
    return ranking_contexts(rows, GAP_MINUTES, WINDOW_SIZE, by=["domain"])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of three models on both domains: popularity, inner product, a fixed pseudo-score; one folder for each model and domain.

    All scores are computed side by side in one pass over the rows and turned into rows per model. Reports share the
    stored result, as they would share the files of a finished model run.
    """
    def build() -> DataFrame:
        rows = popularity_score(scored_parts(spark, folder), train(spark, folder)).withColumnRenamed("score", "_popularity")
        both = pair_score(rows, user_vectors(spark, folder), item_vectors(spark, folder), name="_dot")
        scores = F.array(*[
            F.struct(F.lit(model).alias("model"), score.alias("score"))
            for model, score in (
                ("popularity", F.col("_popularity")), ("dot", F.col("_dot")), ("fixed", (F.col("event_id") % 97) / F.lit(97.0)),
            )
        ])
        return both.withColumn("_s", F.explode(scores)).select(*both.columns, "_s.*").drop("_popularity", "_dot")

    made_of = ("predictions", folder, *[file_stamp(spark, f"{folder}/{name}.parquet") for name in ("events", "embeddings")])
    return stored_once(spark, made_of, build, ["model", "domain"])


def impressions_big(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as impressions: customer sees part on the ship day, heavy ties on the timestamp."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return lines.join(orders, "l_orderkey").select(
        "user_id", F.col("l_partkey").alias("item_id"), _epoch_ms("l_shipdate").alias("timestamp_ms"),
        _flag(F.col("l_returnflag") == "R").alias("long_view"), F.lit(0).alias("is_random"),
    )


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("value") - 50) / 50))
    return impressions(spark, folder).select("event_id", F.col("long_view").alias("label"), p.alias("probability"))


def domain_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return impressions(spark, folder).select(
        "event_id", ((1 + F.col("event_id") % 98) / F.lit(100.0)).alias("domain_probability")
    )


def bandit(spark: SparkSession, folder: str) -> DataFrame:
    """Impressions as bandit rounds; randomized rows are the on-policy ground truth."""
    hour = F.floor(F.pmod(F.col("timestamp_ms"), F.lit(86_400_000)) / 3_600_000)
    target = F.transform(F.sequence(F.lit(1), F.lit(N_ACTIONS)), lambda a: a / F.lit(55.0))
    prediction = F.transform(F.sequence(F.lit(0), F.lit(N_ACTIONS - 1)), lambda a: (F.lit(1.0) + a) / (F.lit(20.0) + F.col("_m")))
    rows = impressions(spark, folder).select(
        F.col("event_id").alias("round_id"), (F.col("item_id") % N_ACTIONS).cast("int").alias("action"),
        F.col("long_view").alias("reward"), ((1 + F.col("event_id") % 19) / F.lit(20.0)).alias("pscore"),
        F.array(F.col("value") / 100, hour / F.lit(24.0)).alias("context"),
        F.when(F.col("is_random") == 1, "random").otherwise("behavior").alias("policy"),
        (F.col("event_id") % 5).alias("_m"), target.alias("target"),
    )
    return rows.withColumn("prediction", prediction).drop("_m")


def u(*parts: str) -> str:
    """SQL text of the keyed hash draw."""
    return (
        "(cast('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 12) as bigint) / 281474976710656::double)"
    )


def _times(a: str, b: str) -> str:
    return f"((({a})::uhugeint * ({b})::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def plus(a: str, b: str) -> str:
    return f"((({a})::uhugeint + ({b})::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def mixed(x: str) -> str:
    """SQL text of the finisher of splitmix64."""
    def folded(value: str, bits: int) -> str:
        return f"list_transform([{value}], lambda y: xor(y, y >> {bits}))[1]"

    return folded(_times(folded(_times(folded(x, 30), bootstrap._FIRST), 27), bootstrap._SECOND), 31)


def stream_start(*keys: str) -> str:
    """SQL text of the state that a stream of draws starts from."""
    start = "0::ubigint"
    for key in keys:
        start = mixed(plus(f"xor({start}, {key})", f"{bootstrap._STEP}::ubigint"))
    return start


def stream_draw(start: str, place: str) -> str:
    """SQL text of the uniform draw at ``place``, counted from 0, of a stream."""
    return f"(({mixed(plus(start, _times(f'{place} + 1', str(bootstrap._STEP))))} >> 11)::double / 9007199254740992::double)"


PRELUDE = """
with impressions as (
  select *, case when is_random = 1 then 'random' when date <= 20240114 then 'standard_early' else 'standard_late' end as source_log
  from (
    select *, case when event_id % 3 = 0 and date >= 20240115 then 1 else 0 end as is_random from (
      select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as item_id,
        epoch_us(ts) // 1000 as timestamp_ms, cast(strftime(ts, '%Y%m%d') as int) as date,
        cast(event_id % 5 as int) as tab,
        case when event_type in ('view', 'purchase') then 1 else 0 end as long_view,
        case when event_type in ('click', 'view', 'purchase') then 1 else 0 end as is_click,
        cast(event_id % 7 = 0 as int) as is_like, cast(event_id % 11 = 0 as int) as is_follow,
        cast(event_id % 13 = 0 as int) as is_comment, cast(event_id % 17 = 0 as int) as is_forward,
        cast(event_id % 23 = 0 as int) as is_hate, cast(event_id % 19 = 0 as int) as is_profile_enter,
        cast(floor(value * 1000) as bigint) as play_time_ms, cast(60000 as bigint) as duration_ms, value
      from events))),
split_log as (
  select *, case when is_random = 1 and date between 20240115 and 20240130 then 'randomized_test'
    when is_random = 0 and date between 20240123 and 20240130 then 'standard_test'
    when is_random = 0 and date between 20240115 and 20240122 then 'validation'
    when is_random = 0 and date <= 20240114 then 'train' end as split
  from impressions),
train as (select * from split_log where split = 'train'),
slices as (
  select split as slice, * from split_log
  union all
  select case when date <= 20240122 then 'adaptation' else 'holdout' end, * from split_log where split = 'randomized_test'),
gaps as (
  select *, case when timestamp_ms - lag(timestamp_ms) over w <= 1440 * 60000 then 0 else 1 end as starts
  from slices window w as (partition by slice, user_id order by timestamp_ms, item_id)),
sessions as (
  select *, sum(starts) over (partition by slice, user_id order by timestamp_ms, item_id rows unbounded preceding) - 1 as session
  from gaps),
positions as (
  select *, row_number() over (partition by slice, user_id, session order by timestamp_ms, item_id) - 1 as session_position
  from sessions),
contexts as (
  select * exclude (starts, session),
    user_id || ':' || cast(session as bigint) || ':' || (session_position // 20) as context_id
  from positions),
item_vectors as (select vec_id as item_id, embedding::double[] as embedding from embeddings),
user_vectors as (select vec_id + vec_id // 6 as user_id, list_reverse(embedding::double[]) as embedding from embeddings),
item_tags as (
  select vec_id as item_id, case when vec_id % 20 = 19 then null
    when vec_id % 6 = 0 then '[''c' || vec_id % 10 || ''',''x'']'
    when vec_id % 6 = 1 then 'c' || vec_id % 10 || ',c2'
    when vec_id % 6 = 2 then 'c' || vec_id % 10 || '|c2'
    when vec_id % 6 = 3 then 'c' || vec_id % 10 || ';c2'
    when vec_id % 6 = 4 then ' c' || vec_id % 10 || ' '
    else '[]' end as tag
  from embeddings),
item_categories as (
  select item_id, case when tag is null or tag = '[]' then 'unknown' else regexp_extract(tag, 'c[0-9]') end as category
  from item_tags),
train_rate as (select avg(long_view) as rate from train),
popularity as (
  select item_id, count(*) as exposures, cast(sum(long_view) as bigint) as positives,
    (sum(long_view) + 20.0 * any_value(rate)) / (count(*) + 20.0) as score
  from train, train_rate group by item_id),
tests as (
  select *, 'standard' as domain from contexts where slice = 'standard_test'
  union all select *, 'randomized' from contexts where slice = 'holdout'),
predictions as (
  select t.*, coalesce(p.score, r.rate) as score, 'popularity' as model
  from tests t left join popularity p using (item_id), train_rate r
  union all
  select t.*, coalesce(list_dot_product(u.embedding, i.embedding), 0.0), 'dot'
  from tests t left join user_vectors u using (user_id) left join item_vectors i using (item_id)
  union all
  select t.*, (event_id % 97) / 97.0::double, 'fixed' from tests t),
ranked as (
  select *, row_number() over (partition by model, domain, context_id order by score desc, item_id, timestamp_ms) as rank
  from predictions),
group_totals as (
  select model, domain, context_id, count(*) as group_rows, cast(sum(long_view) as bigint) as positives
  from predictions group by all having count(*) >= 2 and sum(long_view) > 0),
ks as (select unnest([5, 10, 20]) as k),
per_group as (
  select model, domain, context_id as evaluation_group, k, arg_min(user_id, rank) as user_id, arg_min(date, rank) as date,
    any_value(group_rows) as group_rows,
    sum(case when rank <= k then long_view / log2(rank + 1) else 0 end)
      / list_sum(list_transform(range(1, least(k, any_value(positives)) + 1), lambda x: 1 / log2(x + 1))) as ndcg,
    sum(case when rank <= k then long_view else 0 end) / any_value(positives) as recall,
    coalesce(1.0::double / min(case when long_view = 1 and rank <= k then rank end), 0.0) as mrr
  from ranked join group_totals using (model, domain, context_id), ks group by model, domain, context_id, k),
metrics as (
  select model, domain, k, avg(ndcg) as ndcg, avg(recall) as recall, avg(mrr) as mrr, count(*) as eligible_groups,
    cast(sum(group_rows) as bigint) as eligible_rows
  from per_group group by all),
profiles as (
  select user_id, category, n / sum(n) over (partition by user_id) as preference
  from (select user_id, coalesce(category, 'unknown') as category, count(*) as n
        from train left join item_categories using (item_id) where long_view = 1 group by all)),
impressions_big as (
  select o_custkey as user_id, l_partkey as item_id, epoch_us(l_shipdate) // 1000 as timestamp_ms,
    case when l_returnflag = 'R' then 1 else 0 end as long_view, 0 as is_random
  from lineitem join orders on l_orderkey = o_orderkey),
bandit as (
  select event_id as round_id, cast(item_id % 10 as int) as action, long_view as reward, (1 + event_id % 19) / 20.0::double as pscore,
    [value / 100, ((timestamp_ms % 86400000) // 3600000) / 24.0::double] as context,
    case when is_random = 1 then 'random' else 'behavior' end as policy,
    list_transform(range(1, 11), lambda a: a / 55.0::double) as target,
    list_transform(range(0, 10), lambda a: (1.0::double + a) / (20.0::double + event_id % 5)) as prediction
  from impressions)
"""
