"""Queries for retrieval, candidate sets and batch recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposura.operators import candidates as cand, inverted_lists, popularity as pop, ranker, ranking_metrics as rm, retrieval
from exposura.plans import views as v, workflows
from exposura.plans.queries_features import AGGREGATES_SQL, PRIOR_SQL
from exposura.plans.registry import query
from exposura.session import materialize

EXACT_SQL = """
, exact as (
  select user_id, item_id, list_dot_product(u.embedding, i.embedding) as retrieval_score,
    row_number() over (partition by user_id order by list_dot_product(u.embedding, i.embedding) desc, item_id) as retrieval_rank
  from user_vectors u, item_vectors i)
"""
STARTS_SQL = """
, starts as (
  select context_id, user_id, timestamp_ms, date, tab, session_position from contexts where slice = 'standard_test'
  qualify row_number() over (partition by context_id order by timestamp_ms, item_id) = 1)
"""
CANDIDATES_SQL = EXACT_SQL + STARTS_SQL + """
, candidates as (
  select context_id, user_id, timestamp_ms, date, tab, session_position, item_id, retrieval_score, retrieval_rank
  from starts join exact using (user_id) where retrieval_rank <= 200)
, exposed as (select * from contexts where slice = 'standard_test')
, labels as (
  select context_id, item_id, 1 as label_binary,
    1 + max(case when is_like + is_follow + is_comment + is_forward + is_profile_enter > 0 then 1 else 0 end) as label_graded
  from exposed where long_view = 1 group by all)
"""
ATTACHED_SQL = CANDIDATES_SQL + """
, attached as (
  select c.*, coalesce(label_binary, 0) as label_binary, coalesce(label_graded, 0) as label_graded, 0 as forced_positive
  from candidates c left join labels using (context_id, item_id)
  union all
  select l.context_id, s.user_id, s.timestamp_ms, s.date, s.tab, s.session_position, l.item_id,
    (select min(retrieval_score) from candidates) - 1e-6::double,
    coalesce((select max(retrieval_rank) from candidates c where c.context_id = l.context_id), 0) + 1,
    label_binary, label_graded, 1
  from labels l join starts s using (context_id) anti join candidates c on c.context_id = l.context_id and c.item_id = l.item_id)
"""


def candidates_of(spark, folder) -> DataFrame:
    """Stored top-200 candidates of the standard test contexts."""
    contexts = v.part(spark, folder, "standard_test")
    return materialize(retrieval.retrieve_candidates(contexts, v.user_vectors(spark, folder), v.item_vectors(spark, folder), 200))


@query("embedding_audit", """
select count(*) as rows, count(distinct vec_id) as ids, count(*) - count(distinct vec_id) as duplicate_ids,
  min(len(embedding)) as min_dimension, max(len(embedding)) as max_dimension,
  count(*) filter (len(list_filter(embedding, lambda x: not isfinite(x))) > 0) as non_finite_vectors,
  true as valid from embeddings""")
def embedding_audit(spark, folder):
    return pop.embedding_audit(v.table(spark, folder, "embeddings"), "vec_id")


@query("exact_topk", EXACT_SQL + """
select user_id, item_id, R6(retrieval_score) as retrieval_score, retrieval_rank from exact where retrieval_rank <= 200""")
def exact_topk(spark, folder):
    return retrieval.exact_topk(v.user_vectors(spark, folder), v.item_vectors(spark, folder), 200)


@query("retrieve_candidates", CANDIDATES_SQL + """
select context_id, user_id, timestamp_ms, date, tab, session_position, item_id, R6(retrieval_score) as retrieval_score, retrieval_rank
from candidates""")
def retrieve_candidates(spark, folder):
    contexts = v.part(spark, folder, "standard_test")
    return retrieval.retrieve_candidates(contexts, v.user_vectors(spark, folder), v.item_vectors(spark, folder), 200)


HYBRID_SQL = PRIOR_SQL + STARTS_SQL + """
, weights as (select unnest([0.0::double, 0.1, 0.25, 0.5]) as popularity_weight)
, hybrid as (
  select user_id, popularity_weight, item_id, list_dot_product(u.embedding, i.embedding) + popularity_weight * prior as retrieval_score
  from user_vectors u, item_vectors i join prior using (item_id), weights)
, hybrid_top as (
  select *, row_number() over (partition by user_id, popularity_weight order by retrieval_score desc, item_id) as retrieval_rank
  from hybrid qualify retrieval_rank <= 200)
"""


@query("hybrid_candidates", HYBRID_SQL + """
select context_id, user_id, item_id, R6(retrieval_score) as retrieval_score, retrieval_rank
from starts join hybrid_top using (user_id) where popularity_weight = 0.25""")
def hybrid_candidates(spark, folder):
    contexts, items = v.part(spark, folder, "standard_test"), v.item_vectors(spark, folder)
    prior = pop.popularity_prior(v.train(spark, folder), items)
    return retrieval.retrieve_candidates(contexts, v.user_vectors(spark, folder), items, 200, 0.25, prior).select(
        "context_id", "user_id", "item_id", "retrieval_score", "retrieval_rank"
    )


SWEEP_SQL = HYBRID_SQL + """
, truth as (select distinct context_id, item_id from contexts where slice = 'standard_test' and long_view = 1)
, sizes as (select context_id, count(*) as positives from truth group by context_id)
, cuts as (select unnest([50, 100, 200]) as k)
, marked as (
  select popularity_weight, s.context_id, h.item_id, retrieval_rank as r, t.item_id is not null as hit
  from starts s join hybrid_top h using (user_id) left join truth t on t.context_id = s.context_id and t.item_id = h.item_id)
, per as (
  select popularity_weight, k, context_id, count(*) filter (hit and r <= k) / any_value(positives) as recall,
    coalesce(1.0::double / min(r) filter (hit and r <= k), 0) as mrr,
    coalesce(sum(1 / log2(r + 1)) filter (hit and r <= k), 0)
      / list_sum(list_transform(range(1, least(k, any_value(positives)) + 1), lambda x: 1 / log2(x + 1))) as ndcg
  from marked join sizes using (context_id), cuts group by popularity_weight, k, context_id)
, catalog as (select popularity_weight, count(distinct item_id) as catalog_items_retrieved from marked group by all)
, sweep as (
  select popularity_weight, k, count(*) as evaluated_contexts, avg(recall) as recall, avg(mrr) as mrr, avg(ndcg) as ndcg,
    any_value(catalog_items_retrieved) as catalog_items_retrieved, (select count(*) from sizes) as positive_contexts
  from per join catalog using (popularity_weight) group by popularity_weight, k)
"""
SWEEP_COLUMNS = """popularity_weight, k, evaluated_contexts, R6(recall) as recall, R6(mrr) as mrr, R6(ndcg) as ndcg,
  catalog_items_retrieved, positive_contexts, R6(evaluated_contexts / positive_contexts) as context_coverage"""


def _sweep(spark, folder, split: str = "standard_test") -> DataFrame:
    items = v.item_vectors(spark, folder)
    prior = pop.popularity_prior(v.train(spark, folder), items)
    return workflows.hybrid_sweep(v.part(spark, folder, split), v.user_vectors(spark, folder), items, prior)


@query("hybrid_sweep", SWEEP_SQL + f"select {SWEEP_COLUMNS} from sweep")
def hybrid_sweep(spark, folder):
    return _sweep(spark, folder)


@query("select_hybrid_weight", SWEEP_SQL.replace("slice = 'standard_test'", "slice = 'validation'") + f"""
select {SWEEP_COLUMNS} from sweep where k = 200 order by sweep.recall desc, sweep.ndcg desc, popularity_weight limit 1""")
def select_hybrid_weight(spark, folder):
    """The weight is chosen on the validation split, so that the test split stays unseen."""
    return workflows.select_hybrid_weight(_sweep(spark, folder, "validation"))


@query("retrieval_metrics", SWEEP_SQL + f"""
select {SWEEP_COLUMNS.replace("popularity_weight, ", "")} from sweep where popularity_weight = 0""")
def retrieval_metrics(spark, folder):
    return cand.retrieval_metrics(candidates_of(spark, folder), v.part(spark, folder, "standard_test"))


@query("candidate_count_sweep", CANDIDATES_SQL + """
, cuts as (select unnest([50, 100, 200, 500]) as k)
, wide as (select context_id, item_id, retrieval_rank as r from starts join exact using (user_id) where retrieval_rank <= 500)
, sizes as (select context_id, count(*) as positives from labels group by context_id)
select k, count(*) as evaluated_contexts, R6(avg(hits / positives)) as recall from (
  select k, w.context_id, any_value(positives) as positives, count(l.item_id) filter (r <= k) as hits
  from wide w join sizes using (context_id) left join labels l on l.context_id = w.context_id and l.item_id = w.item_id, cuts
  group by k, w.context_id) group by k""")
def candidate_count_sweep(spark, folder):
    contexts = v.part(spark, folder, "standard_test")
    found = materialize(retrieval.retrieve_candidates(contexts, v.user_vectors(spark, folder), v.item_vectors(spark, folder), 500))
    return cand.retrieval_metrics(found, contexts, (50, 100, 200, 500)).select("k", "evaluated_contexts", "recall")


@query("observed_ranking_rows", """
select event_id, context_id, R6(coalesce(list_dot_product(u.embedding, i.embedding), 0.0)) as retrieval_score,
  row_number() over (partition by context_id order by coalesce(list_dot_product(u.embedding, i.embedding), 0.0) desc, item_id, timestamp_ms) as retrieval_rank,
  long_view as label
from contexts left join user_vectors u using (user_id) left join item_vectors i using (item_id) where slice = 'standard_test'""")
def observed_ranking_rows(spark, folder):
    log = v.split_log(spark, folder).where("split = 'standard_test'")
    return retrieval.observed_ranking_rows(
        log, v.user_vectors(spark, folder), v.item_vectors(spark, folder), v.GAP_MINUTES, v.WINDOW_SIZE
    ).select("event_id", "context_id", "retrieval_score", "retrieval_rank", "label")


@query("relevance_labels", CANDIDATES_SQL + "select context_id, item_id, label_binary, label_graded from labels")
def relevance_labels(spark, folder):
    return cand.relevance_labels(v.part(spark, folder, "standard_test"))


@query("forced_positives", ATTACHED_SQL + "select context_id, item_id, label_binary, label_graded from attached where forced_positive = 1")
def forced_positives(spark, folder):
    return cand.missing_positives(candidates_of(spark, folder), v.part(spark, folder, "standard_test"))


@query("attach_labels", ATTACHED_SQL + """
select context_id, user_id, timestamp_ms, date, tab, session_position, item_id, R6(retrieval_score) as retrieval_score, retrieval_rank,
  label_binary, label_graded, forced_positive, label_graded as label from attached""")
def attach_labels(spark, folder):
    return cand.attach_labels(candidates_of(spark, folder), v.part(spark, folder, "standard_test"), "graded")


@query("candidate_diagnostics", ATTACHED_SQL + """
select *, R6(forced_positive_contexts / greatest(candidate_contexts, 1)) as forced_positive_context_rate,
  R6(forced_positive_rows / greatest(positive_candidate_rows, 1)) as forced_positive_share_of_positive_rows
from (select count(*) as candidate_rows, count(distinct context_id) as candidate_contexts,
  count(*) filter (forced_positive = 1) as forced_positive_rows,
  count(distinct context_id) filter (forced_positive = 1) as forced_positive_contexts,
  count(*) filter (label_binary > 0) as positive_candidate_rows from attached)""")
def candidate_diagnostics(spark, folder):
    return cand.candidate_diagnostics(cand.attach_labels(candidates_of(spark, folder), v.part(spark, folder, "standard_test")))


@query("group_sizes", ATTACHED_SQL + """
select context_id, count(*) as rows, count(*) filter (label_binary > 0) as positives from attached group by context_id""")
def group_sizes(spark, folder):
    return ranker.group_sizes(cand.attach_labels(candidates_of(spark, folder), v.part(spark, folder, "standard_test")))


@query("topk_per_context", """
select event_id, model, domain, context_id, rank from ranked where rank <= 10""")
def topk_per_context(spark, folder):
    return rm.top_per_group(v.predictions(spark, folder), 10, ["model", "domain", "context_id"]).select(
        "event_id", "model", "domain", "context_id", "rank"
    )


@query("recommend_batch", EXACT_SQL + AGGREGATES_SQL + """
, requests as (select user_id, max(timestamp_ms) + 1 as timestamp_ms from impressions group by user_id)
, scored as (
  select r.user_id, timestamp_ms, e.item_id, retrieval_score + 0.5 * coalesce(hist_item_reward_rate, 0)
    + 0.001 * ((timestamp_ms % 86400000) // 3600000) as score
  from requests r join exact e on e.user_id = r.user_id and retrieval_rank <= 200 left join item_agg a on a.item_id = e.item_id)
select user_id, timestamp_ms, item_id, R6(score) as score,
  row_number() over (partition by user_id order by score desc, item_id) as position from scored qualify position <= 10""")
def recommend_batch(spark, folder):
    requests = v.impressions(spark, folder).groupBy("user_id").agg((F.max("timestamp_ms") + 1).alias("timestamp_ms"))
    scorer = workflows.linear_scorer({"retrieval_score": 1.0, "hist_item_reward_rate": 0.5, "hour": 0.001})
    return workflows.recommend(
        requests, v.user_vectors(spark, folder), v.item_vectors(spark, folder), v.train(spark, folder), scorer
    ).select("user_id", "timestamp_ms", "item_id", "score", "position")


@query("unknown_requests", """
select distinct user_id from impressions anti join user_vectors using (user_id)""")
def unknown_requests(spark, folder):
    return workflows.unknown_requests(v.impressions(spark, folder).select("user_id").distinct(), v.user_vectors(spark, folder))


def _hash_sql(columns: list[str], dimension: int = 64) -> str:
    parts = " union all ".join(
        f"select p_partkey, md5('{c}=' || coalesce(cast({c} as varchar), '__NA__')) as h from part" for c in columns
    )
    return f"""
, hashed as (
  select p_partkey, cast('0x' || substr(h, 1, 12) as bigint) % {dimension} as place,
    case when substr(h, 13, 1) < '8' then 1.0::double else -1.0 end as sign from ({parts}))
, slots as (select p_partkey, place, sum(sign) as s from hashed group by all)
, norms as (select p_partkey, greatest(sqrt(sum(s * s)), 1e-12) as norm from slots group by all)
, hash_vectors as (select p_partkey as item_id, place, s / norm as x from slots join norms using (p_partkey))
"""


HASH_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


def _part_vectors(spark, folder) -> DataFrame:
    parts = v.table(spark, folder, "part").withColumnRenamed("p_partkey", "item_id")
    return retrieval.hash_vectors(parts, "item_id", HASH_COLUMNS)


@query("hash_vectors", _hash_sql(HASH_COLUMNS) + "select item_id, place, R6(x) as x from hash_vectors where abs(x) > 1e-9")
def hash_vectors(spark, folder):
    return _part_vectors(spark, folder).select("item_id", F.posexplode("embedding").alias("place", "x")).where("abs(x) > 1e-9")


PROFILE_SQL = _hash_sql(HASH_COLUMNS) + """
, liked as (select user_id, item_id, count(*) as n from impressions_big where long_view = 1 group by all)
, totals as (select user_id, sum(n) as positives from liked join (select distinct item_id from hash_vectors) using (item_id) group by all)
, coords as (select user_id, place, sum(n * x) / any_value(positives) as m
  from liked join hash_vectors using (item_id) join totals using (user_id) group by user_id, place)
, lengths as (select user_id, greatest(sqrt(sum(m * m)), 1e-12) as len from coords group by all)
"""


@query("profile_vectors", PROFILE_SQL + """
select user_id, cast(positives as bigint) as positives, place, R6(m / len) as x
from coords join lengths using (user_id) join totals using (user_id) where abs(m / len) > 1e-6""")
def profile_vectors(spark, folder):
    positives = v.impressions_big(spark, folder).where("long_view = 1")
    profiles = retrieval.profile_vectors(positives, _part_vectors(spark, folder))
    return profiles.select("user_id", "positives", F.posexplode("embedding").alias("place", "x")).where("abs(x) > 1e-6")


@query("top_profiles", PROFILE_SQL + """
select user_id, cast(positives as bigint) as positives from totals order by positives desc, user_id limit 100""")
def top_profiles(spark, folder):
    positives = v.impressions_big(spark, folder).where("long_view = 1")
    return retrieval.profile_vectors(positives, _part_vectors(spark, folder), maximum=100).select("user_id", "positives")


LSH_TABLES, LSH_BITS = 4, 3


def _lsh_sql() -> str:
    planes = retrieval.hyperplanes(LSH_TABLES, LSH_BITS, 64)
    rows = ", ".join(
        f"({t}, {b}, {plane})" for t, table in enumerate(planes) for b, plane in enumerate(table)
    )

    def buckets(name: str, key: str) -> str:
        return f"""
, {name} as (select {key}, t, sum(case when list_dot_product(embedding, plane) >= 0 then 1 << b else 0 end) as bucket, any_value(embedding) as embedding
  from {key.split('_')[0]}_vectors, planes group by {key}, t)"""

    return f"""
, planes as (select t, b, plane::double[] as plane from (values {rows}) as p(t, b, plane))""" + buckets(
        "user_buckets", "user_id") + buckets("item_buckets", "item_id") + """
, near as (select distinct u.user_id, i.item_id, list_dot_product(u.embedding, i.embedding) as s
  from user_buckets u join item_buckets i on u.t = i.t and u.bucket = i.bucket)
, found as (select user_id, item_id, s, row_number() over (partition by user_id order by s desc, item_id) as r from near qualify r <= 50)
"""


@query("approximate_topk", _lsh_sql() + "select user_id, item_id, R6(s) as retrieval_score, r as retrieval_rank from found")
def approximate_topk(spark, folder):
    return retrieval.approximate_topk(v.user_vectors(spark, folder), v.item_vectors(spark, folder), 50, LSH_TABLES, LSH_BITS)


@query("ann_recall", EXACT_SQL + _lsh_sql() + """
select count(*) as queries, R6(avg(recall)) as recall_at_k from (
  select e.user_id, count(f.item_id) / 50.0::double as recall from exact e
  left join found f on f.user_id = e.user_id and f.item_id = e.item_id where retrieval_rank <= 50 group by e.user_id)""")
def ann_recall(spark, folder):
    users, items = v.user_vectors(spark, folder), v.item_vectors(spark, folder)
    exact = retrieval.exact_topk(users, items, 50)
    found = retrieval.approximate_topk(users, items, 50, LSH_TABLES, LSH_BITS)
    return retrieval.retrieval_recall(exact, found, 50)


LISTS, LIST_ITERATIONS, PROBES = 16, 2, (1, 2, 4, 8, 12, 16)


def _lists_sql() -> str:
    """K-means of the item vectors, spelled out step by step, and every vector's lists by nearness."""
    def nearest(rows: str, centroids: str) -> str:
        return f"""select r.{rows[:4]}_id, c.list_id, row_number() over (partition by r.{rows[:4]}_id order by
    list_dot_product(r.embedding, c.centroid) - list_dot_product(c.centroid, c.centroid) / 2 desc, c.list_id) as list_rank
  from {rows} r, {centroids} c"""

    steps = f"""
, c0 as (select row_number() over (order by u, item_id) - 1 as list_id, embedding as centroid
  from (select *, {v.u("item_id", "'list'", "'42'")} as u from item_vectors) order by u, item_id limit {LISTS})"""
    for i in range(LIST_ITERATIONS):
        steps += f"""
, a{i} as (select * from ({nearest("item_vectors", f"c{i}")}) where list_rank = 1)
, m{i} as (select list_id, list(x order by p) as mean from (
    select list_id, p, avg(embedding[p]) as x from a{i} join item_vectors using (item_id), (select unnest(range(1, 65)) as p) group by list_id, p) group by list_id)
, c{i + 1} as (select list_id, coalesce(mean, centroid) as centroid from c{i} left join m{i} using (list_id))"""
    return steps + f"""
, held as (select * from ({nearest("item_vectors", f"c{LIST_ITERATIONS}")}) where list_rank = 1)
, asked as ({nearest("user_vectors", f"c{LIST_ITERATIONS}")})"""


@query("ann_sweep", EXACT_SQL + _lists_sql() + f"""
, sizes as (select list_id, count(*) as size from held group by list_id)
, probes as (select unnest({list(PROBES)}) as nprobe)
, cost as (select nprobe, count(distinct user_id) as queries, cast(sum(coalesce(size, 0)) as bigint) as rows_scanned
  from probes join asked on list_rank <= nprobe left join sizes using (list_id) group by nprobe)
, seen as (
  select nprobe, e.user_id, e.item_id, e.retrieval_rank, row_number() over (partition by nprobe, e.user_id order by e.retrieval_rank) as r
  from exact e join held h on h.item_id = e.item_id join asked a on a.user_id = e.user_id and a.list_id = h.list_id join probes on a.list_rank <= nprobe)
, hits as (select nprobe, sum(case when r <= 50 and retrieval_rank <= 50 then 1 else 0 end) / 50.0::double / count(distinct user_id) as recall from seen group by nprobe)
select nprobe, queries, rows_scanned, R6(recall) as recall_at_k, R6(rows_scanned / (queries * (select count(*) from item_vectors))) as share
from cost join hits using (nprobe)""")
def ann_sweep(spark, folder):
    users, items = v.user_vectors(spark, folder), v.item_vectors(spark, folder)
    centroids = inverted_lists.fit_lists(items, LISTS, LIST_ITERATIONS)
    return inverted_lists.ann_sweep(users, items, centroids, retrieval.exact_topk(users, items, 50), 50, PROBES)


@query("replicate_corpus", f"""
, copies as (
  select item_id + replica * (select max(item_id) + 1 from item_vectors) as new_id, replica, embedding
  from item_vectors, (select unnest(range(0, 3)) as replica))
, coords as (
  select new_id, replica, p, embedding[p + 1] + 1e-5::double * sqrt(-2.0::double * ln(greatest({v.u("new_id", "p", "'a'", "'42'")}, 1e-12)))
    * cos(2 * pi() * {v.u("new_id", "p", "'b'", "'42'")}) as x
  from (select *, unnest(range(0, 64)) as p from copies))
, lengths as (select new_id, greatest(sqrt(sum(x * x)), 1e-12) as len from coords group by all)
select new_id as item_id, replica, p as place, R6(x / len) as x from coords join lengths using (new_id)""")
def replicate_corpus(spark, folder):
    copies = retrieval.replicate_corpus(v.item_vectors(spark, folder), 3)
    return copies.select("item_id", "replica", F.posexplode("embedding").alias("place", "x"))
