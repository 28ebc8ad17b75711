"""Training examples in event time: histories, negatives and triples that never look ahead.

A user's item enters the pool of exposed negatives when it is first shown without a positive and
leaves it once it has been positive. That makes pool sizes running sums and every draw an index
lookup, so no pool is ever built as a list and a very active user is spread over time slices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.checks import standard_only
from exposura.functions.columns import uniform_hash
from exposura.functions.scale import (
    HOT_SHARE, ROWS_PER_TASK, SLICE_MS, earlier_totals, find_hot_keys, running_totals, with_time_slice,
)
from exposura.operators.history import prior_global_totals
from exposura.operators.retrieval import exact_topk
from exposura.session import materialize

STRATEGIES = ("exposed_mixed", "exposed", "popularity", "random")
# Draws by rejection before the exact draw over what is left takes over: one for all targets, then four times as many as
# before at a time, for ever fewer targets.
ATTEMPTS = 5
_MOST_AT_A_TIME = 16
# Children of a node of the rank index.
_FANOUT = 16


def first_outcomes(train: DataFrame) -> DataFrame:
    """``(user_id, item_id, first_positive, first_negative)``: first timestamp of either outcome."""
    positive = F.col("long_view") == 1
    return train.groupBy("user_id", "item_id").agg(
        F.min(F.when(positive, F.col("timestamp_ms"))).alias("first_positive"),
        F.min(F.when(~positive, F.col("timestamp_ms"))).alias("first_negative"),
    )


def first_positives(train: DataFrame) -> DataFrame:
    """One target per (user, item): the time of its first positive event."""
    return (
        standard_only(train, "training targets").where(F.col("long_view") == 1)
        .groupBy("user_id", "item_id").agg(F.min("timestamp_ms").alias("timestamp_ms"))
    )


def _last(array: Column, n: int) -> Column:
    return F.when(F.size(array) <= n, array).otherwise(F.slice(array, -n, n))


def user_history(
    train: DataFrame, length: int = 50, slice_width: int = SLICE_MS, min_rows: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Targets with ``history``: the user's last ``length`` positive items strictly before the target.

    Items are in (timestamp, item) order, repeats included. At most ``length`` items per timestamp and
    ``length`` timestamps per frame are held, so lists stay bounded.
    """
    if length < 1:
        raise ValueError("history length must be positive")
    positives = train.where(F.col("long_view") == 1)
    tied = Window.partitionBy("user_id", "timestamp_ms").orderBy(F.desc("item_id"))
    moments = (
        positives.select("user_id", "timestamp_ms", "item_id")
        .withColumn("_r", F.row_number().over(tied)).where(F.col("_r") <= length)
        .groupBy("user_id", "timestamp_ms").agg(F.array_sort(F.collect_list("item_id")).alias("_items"))
    )
    empty = F.array().cast("array<bigint>")

    def recent(rows: DataFrame, part: list[str]) -> DataFrame:
        inside = Window.partitionBy(*part).orderBy("timestamp_ms").rowsBetween(-length, -1)
        return rows.withColumn("_recent", F.coalesce(F.flatten(F.collect_list("_items").over(inside)), empty))

    hot = find_hot_keys(positives, ["user_id"], min_rows, share)
    if hot is None:
        with_lists = recent(moments, ["user_id"]).withColumn("_carry", empty)
    else:
        part = ["user_id", "_slice"]
        sliced = with_time_slice(moments, ["user_id"], "timestamp_ms", hot, slice_width)
        newest = Window.partitionBy(*part).orderBy(F.desc("timestamp_ms"))
        ends = (
            sliced.where("_hot").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= length)
            .groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "_items"))).alias("_m"))
            .select(*part, _last(F.flatten(F.transform("_m", lambda m: m["_items"])), length).alias("_end"))
        )
        slices_before = Window.partitionBy("user_id").orderBy("_slice").rowsBetween(-length, -1)
        carried = ends.select(*part, F.flatten(F.collect_list("_end").over(slices_before)).alias("_carry"))
        with_lists = recent(sliced, part).join(carried, part, "left")
    histories = with_lists.select(
        "user_id", "timestamp_ms", _last(F.concat(F.coalesce("_carry", empty), "_recent"), length).alias("history")
    )
    return first_positives(train).join(histories, ["user_id", "timestamp_ms"])


def final_history(train: DataFrame, length: int = 50) -> DataFrame:
    """Last ``length`` positive items per user over the whole training log, for queries after its end."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp_ms"), F.desc("item_id"))
    return (
        train.where(F.col("long_view") == 1).select("user_id", "timestamp_ms", "item_id")
        .withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= length)
        .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("_r"), F.col("item_id")))).alias("_h"))
        .select("user_id", F.transform("_h", lambda h: h["item_id"]).alias("history"))
    )


def _openings(outcomes: DataFrame) -> DataFrame:
    """Items that are an exposed negative for some time: opened at first_negative, closed by first_positive."""
    opened = F.col("first_negative").isNotNull()
    lasting = F.col("first_positive").isNull() | (F.col("first_negative") < F.col("first_positive"))
    return outcomes.where(opened & lasting)


def negative_pools(train: DataFrame, **scale) -> DataFrame:
    """Per target: opened items, exposed-negative pool size and the number of earlier global events.

    pool = opened before the target, minus those that turned positive before it, minus the target item.
    """
    outcomes = first_outcomes(standard_only(train, "negative sampling"))
    targets = outcomes.where(F.col("first_positive").isNotNull())
    openings = _openings(outcomes)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def marks(rows: DataFrame, at: str, opened: Column, closed: Column) -> DataFrame:
        return rows.select("user_id", F.col(at).alias("timestamp_ms"), opened.alias("_o"), closed.alias("_c"))

    events = marks(openings, "first_negative", one, none).unionByName(
        marks(openings.where(F.col("first_positive").isNotNull()), "first_positive", none, one)
    ).groupBy("user_id", "timestamp_ms").agg(F.sum("_o").alias("_o"), F.sum("_c").alias("_c"))
    points = targets.select(
        "user_id", F.col("first_positive").alias("timestamp_ms"), none.alias("_o"), none.alias("_c"), "item_id", "first_negative"
    )
    summed = earlier_totals(
        points.unionByName(events, allowMissingColumns=True), ["user_id"], "timestamp_ms", {"opened": F.col("_o"), "closed": F.col("_c")}, **scale
    ).where(F.col("item_id").isNotNull())
    own = F.coalesce((F.col("first_negative") < F.col("timestamp_ms")).cast("long"), none)
    totals = prior_global_totals(targets.select(F.col("first_positive").alias("timestamp_ms")), train)
    return summed.join(totals, "timestamp_ms").select(
        "user_id", "item_id", "timestamp_ms", "opened",
        (F.col("opened") - F.col("closed") - own).alias("pool_size"), F.col("prior_n").alias("prior_events"),
    )


def _positions(rows: DataFrame, keys: list[str], order: str, tie: str, name: str, **scale) -> DataFrame:
    """0-based position per key by (order, tie); ties are numbered inside one (key, order) only."""
    before = earlier_totals(rows, keys, order, {"_before": F.lit(1)}, **scale)
    tied = Window.partitionBy(*keys, order).orderBy(tie)
    return before.withColumn(name, F.col("_before") + F.row_number().over(tied) - 1).drop("_before")


def _draw(user: Column, item: Column, salt: str, seed: int, *more: Column) -> Column:
    return uniform_hash(user, item, *more, salt, seed)


def sample_negatives(
    train: DataFrame, strategy: str = "exposed_mixed", seed: int = 42, attempts: int = ATTEMPTS, **scale
) -> DataFrame:
    """One negative per target with its ``source``.

    exposed: uniform over the pool. Without a pool (or by strategy) the draw comes from the catalog:
    popularity picks a strictly earlier event of any user with probability n/(n+items), else a
    uniform item; random is always uniform. Earlier positives of the user and the target itself are
    rejected, and only rejected targets are drawn for again. Draws that fail ``attempts`` times are made exactly, uniformly
    over what is allowed, by a rank among the places that are free.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    log = standard_only(train, "negative sampling")
    outcomes = materialize(first_outcomes(log))
    pools = negative_pools(train, **scale)
    wants_exposed = strategy.startswith("exposed")
    source = F.when((F.col("pool_size") > 0) if wants_exposed else F.lit(False), "exposed").otherwise(
        "popularity" if strategy in ("popularity", "exposed_mixed") else "random"
    )
    targets = materialize(pools.withColumn("source", source))
    from_pool = _from_pool(targets.where("source = 'exposed'"), outcomes, seed, attempts, **scale)
    from_catalog = _from_catalog(targets.where("source <> 'exposed'"), log, outcomes, seed, attempts, **scale)
    return from_pool.unionByName(from_catalog)


_TARGET = ["user_id", "item_id", "timestamp_ms", "source"]


def _in_rounds(targets: DataFrame, drawn: Callable[[DataFrame], DataFrame], attempts: int) -> tuple[list[DataFrame], DataFrame]:
    """Accepted draws and the targets still without one.

    ``drawn`` turns targets with an ``attempt`` into candidates that are allowed. Every round is stored, and only targets
    that all draws so far have failed are drawn for again, so the rows of a round are those of its targets or few times them.
    """
    found, pending, first = [], targets, 0
    while first < attempts:
        width = min(max(1, 4 * first), _MOST_AT_A_TIME, attempts - first)
        tried = pending.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1))))
        found.append(materialize(drawn(tried).groupBy(*_TARGET).agg(F.min_by("candidate", "attempt").alias("negative_item"))))
        pending = materialize(pending.join(found[-1].select(*_TARGET), _TARGET, "left_anti"))
        first += width
        if pending.isEmpty():
            break
    return found, pending


def _ranked_place(pending: DataFrame, closings: DataFrame, total: Column, salt: str, seed: int, **scale) -> DataFrame:
    """``_TARGET`` and ``_place``: a uniform draw over the places of a user's list that are free at the target's time.

    Places are 0 to ``total`` - 1 without ``_own``, the target's own place (null: none), and without those that ``closings``
    (user_id, _place, timestamp_ms) name before the target's time. The draw is a rank among free places in order; it is
    turned into a place by going down a tree over places, ``_FANOUT`` children a node. At each level the closings under a
    node are counted as of the target's time, per child, by the same running totals that serve a hot user; nothing is
    paired with anything. The number of levels is the logarithm of the longest list.
    """
    start = pending.withColumns({"_total": total, "_node": F.lit(0).cast("long"), "_rank": F.lit(None).cast("long")})
    work = materialize(start.select(*_TARGET, "_total", "_own", "_node", "_rank"))
    longest = work.agg(F.max("_total")).first()[0] or 0
    width = 1
    while width < longest:
        width *= _FANOUT
    none = F.lit(0).cast("long")
    while True:
        width = max(1, width // _FANOUT)  # places under a child
        child = F.floor(F.col("_place") / width)
        marks = closings.select("user_id", "timestamp_ms", F.floor(child / _FANOUT).alias("_node"), *[
            (child % _FANOUT == j).cast("long").alias(f"_c{j}") for j in range(_FANOUT)
        ])
        asked = work.select("*", *[none.alias(f"_c{j}") for j in range(_FANOUT)])
        counted = earlier_totals(
            asked.unionByName(marks, allowMissingColumns=True), ["user_id", "_node"], "timestamp_ms",
            {f"_n{j}": F.col(f"_c{j}") for j in range(_FANOUT)}, **scale,
        ).where(F.col("item_id").isNotNull())

        def free(j: int) -> Column:
            low = (F.col("_node") * _FANOUT + j) * width
            inside = F.greatest(F.least(F.col("_total") - low, F.lit(width)), none)
            own = F.coalesce((F.col("_own") >= low) & (F.col("_own") < low + width), F.lit(False)).cast("long")
            return inside - F.col(f"_n{j}") - own

        counted = counted.withColumn("_free", F.array(*[free(j) for j in range(_FANOUT)]))
        left = F.aggregate("_free", none, lambda n, x: n + x)
        rank = F.when(left <= 0, F.raise_error(F.lit("a user has no valid negative item left")).cast("long")).otherwise(
            F.coalesce("_rank", F.floor(_draw(F.col("user_id"), F.col("item_id"), salt, seed) * left).cast("long"))
        )
        # the child that holds the rank, and the rank inside it
        down = F.aggregate(
            "_free", F.struct(none.alias("child"), rank.alias("rank"), F.lit(False).alias("done"), none.alias("at")),
            lambda s, n: F.when(s["done"], s).when(s["rank"] >= n, F.struct(
                s["child"].alias("child"), (s["rank"] - n).alias("rank"), F.lit(False).alias("done"), (s["at"] + 1).alias("at"),
            )).otherwise(F.struct(s["at"].alias("child"), s["rank"].alias("rank"), F.lit(True).alias("done"), s["at"].alias("at"))),
        )
        work = materialize(counted.withColumn("_d", down).select(
            *_TARGET, "_total", "_own", (F.col("_node") * _FANOUT + F.col("_d.child")).cast("long").alias("_node"), F.col("_d.rank").alias("_rank")
        ))
        if width == 1:
            return work.select(*_TARGET, F.col("_node").alias("_place"))


def _from_pool(targets: DataFrame, outcomes: DataFrame, seed: int, attempts: int, **scale) -> DataFrame:
    user, item = F.col("user_id"), F.col("item_id")
    openings = materialize(
        _positions(
            _openings(outcomes).withColumnRenamed("item_id", "candidate"), ["user_id"], "first_negative", "candidate",
            "_index", **scale,
        )
    )
    still_open = F.col("first_positive").isNull() | (F.col("first_positive") >= F.col("timestamp_ms"))

    def drawn(tried: DataFrame) -> DataFrame:
        at = F.floor(_draw(user, item, "exposed", seed, F.col("attempt")) * F.col("opened")).cast("long")
        return tried.withColumn("_index", at).join(openings, ["user_id", "_index"]).where(still_open & (F.col("candidate") != item))

    found, pending = _in_rounds(targets.select(*_TARGET, "opened"), drawn, attempts)
    if pending.isEmpty():
        return reduce(DataFrame.unionByName, found)
    places = openings.select("user_id", F.col("candidate").alias("item_id"), F.col("_index").alias("_own"))
    closings = openings.where(F.col("first_positive").isNotNull()).select(
        "user_id", F.col("_index").alias("_place"), F.col("first_positive").alias("timestamp_ms")
    )
    own = pending.join(places, ["user_id", "item_id"], "left").withColumn(
        "_own", F.when(F.col("_own") < F.col("opened"), F.col("_own"))
    )
    placed = _ranked_place(own, closings, F.col("opened"), "pool", seed, **scale)
    exact = placed.withColumnRenamed("_place", "_index").join(openings, ["user_id", "_index"]).select(
        *_TARGET, F.col("candidate").alias("negative_item")
    )
    return reduce(DataFrame.unionByName, [*found, exact])


def event_index(log: DataFrame, min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """``(_event, candidate)``: every event's place in time order, ties by user and item.

    Events are cut into slices of about ``min_rows`` rows, wherever they lie; a busy timestamp is many slices.
    """
    rows = log.select("timestamp_ms", "user_id", "item_id")
    placed = running_totals(rows, F.col("timestamp_ms"), {"_event": F.lit(1).cast("long")}, min_rows=min_rows, ties=["user_id", "item_id"])
    return placed.select("_event", F.col("item_id").alias("candidate"))


def catalog_index(log: DataFrame, min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """``(_slot, candidate)``: catalog items numbered from 0 by id."""
    items = log.select(F.col("item_id").alias("candidate")).distinct()
    slots = running_totals(items, F.col("candidate"), {"_slot": F.lit(1).cast("long")}, min_rows=min_rows)
    return materialize(slots.select("_slot", "candidate"))


def _from_catalog(targets: DataFrame, log: DataFrame, outcomes: DataFrame, seed: int, attempts: int, **scale) -> DataFrame:
    user, item, attempt, n = F.col("user_id"), F.col("item_id"), F.col("attempt"), F.col("prior_events")
    min_rows = scale.get("min_rows", ROWS_PER_TASK)
    catalog, events = catalog_index(log, min_rows), materialize(event_index(log, min_rows))
    size = catalog.count()
    known = outcomes.where(F.col("first_positive").isNotNull()).select(
        "user_id", F.col("item_id").alias("candidate"), F.col("first_positive").alias("_since")
    )
    by_event = (F.col("source") == "popularity") & (_draw(user, item, "kind", seed, attempt) < n / (n + size))

    def drawn(tried: DataFrame) -> DataFrame:
        draws = tried.withColumn("_u", _draw(user, item, "place", seed, attempt)).withColumn("_by_event", by_event)
        from_events = draws.where("_by_event").withColumn("_event", F.floor(F.col("_u") * n).cast("long")).join(events, "_event")
        from_items = draws.where("not _by_event").withColumn("_slot", F.floor(F.col("_u") * size).cast("long")).join(catalog, "_slot")
        columns = [*_TARGET, "attempt", "candidate"]
        both = from_events.select(*columns).unionByName(from_items.select(*columns)).join(known, ["user_id", "candidate"], "left")
        return both.where((F.col("_since").isNull() | (F.col("_since") >= F.col("timestamp_ms"))) & (F.col("candidate") != item))

    found, pending = _in_rounds(targets.select(*_TARGET, "prior_events"), drawn, attempts)
    if pending.isEmpty():
        return reduce(DataFrame.unionByName, found)
    closings = known.join(catalog, "candidate").select("user_id", F.col("_slot").alias("_place"), F.col("_since").alias("timestamp_ms"))
    own = pending.join(catalog.select(F.col("candidate").alias("item_id"), F.col("_slot").alias("_own")), "item_id", "left")
    placed = _ranked_place(own, closings, F.lit(size).cast("long"), "rest", seed, **scale)
    exact = placed.withColumnRenamed("_place", "_slot").join(catalog, "_slot").select(*_TARGET, F.col("candidate").alias("negative_item"))
    return reduce(DataFrame.unionByName, [*found, exact])


def ranking_triples(train: DataFrame, seed: int = 42, **scale) -> DataFrame:
    """``(user, positive item, negative item)`` per positive event, in (timestamp, item) event order.

    The negative is drawn uniformly from the user's earlier non-positive events (repeats keep their
    weight) whose item is never positive for the user, not even later. Where there is none it is
    uniform over the catalog items that are never positive for the user; a user who likes the whole
    catalog yields no triple.
    """
    log = standard_only(train, "ranking triples")
    pair = ["user_id", "item_id"]
    liked = log.where(F.col("long_view") == 1).select(*pair).distinct()
    positives = log.where(F.col("long_view") == 1).select(*pair, "timestamp_ms")
    usable = log.where(F.col("long_view") == 0).select(*pair, "timestamp_ms").join(liked, pair, "left_anti")
    tagged = usable.withColumn("_is_negative", F.lit(1)).unionByName(positives.withColumn("_is_negative", F.lit(0)))
    counted = earlier_totals(tagged, ["user_id"], "timestamp_ms", {"_before": F.col("_is_negative")}, **scale)
    tied = Window.partitionBy("user_id", "timestamp_ms").orderBy("item_id", F.desc("_is_negative")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    counted = counted.withColumn("_index", F.col("_before") + F.coalesce(F.sum("_is_negative").over(tied), F.lit(0)))
    negatives = counted.where("_is_negative = 1").select("user_id", "_index", F.col("item_id").alias("negative_item"))
    wanted = counted.where("_is_negative = 0").select(*pair, "timestamp_ms", F.col("_index").alias("prior_negatives"))
    u = uniform_hash(F.col("user_id"), F.col("item_id"), F.col("timestamp_ms"), "triple", seed)
    exposed = (
        wanted.where("prior_negatives > 0").withColumn("_index", F.floor(u * F.col("prior_negatives")).cast("long"))
        .join(negatives, ["user_id", "_index"])
        .select(*pair, "timestamp_ms", "negative_item", F.lit("exposed").alias("source"))
    )
    return exposed.unionByName(_catalog_triples(wanted.where("prior_negatives = 0"), log, liked, u, scale))


def _catalog_triples(wanted: DataFrame, log: DataFrame, liked: DataFrame, u: Column, scale: dict) -> DataFrame:
    """Uniform draw over the free catalog slots: slot = r + number of liked slots that come first.

    A liked item at slot g that is the user's j-th has g - j free slots before it, so the shift is a
    running count over those values and rows meet in a range frame instead of a join per liked item.
    """
    catalog = catalog_index(log)
    size = catalog.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_value = {**scale, "slice_width": 65_536}
    slots = liked.join(catalog, liked["item_id"] == catalog["candidate"]).select("user_id", "_slot")
    numbered = earlier_totals(slots, ["user_id"], "_slot", {"_j": F.lit(1)}, **by_value)
    liked_counts = liked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_f"))
    draws = (
        wanted.join(liked_counts, "user_id").where(F.col("_f") < size)
        .withColumn("_value", F.floor(u * (size - F.col("_f"))).cast("long"))
    )
    marks = numbered.select("user_id", (F.col("_slot") - F.col("_j")).cast("long").alias("_value"), F.lit(1).alias("_mark"))
    united = draws.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    shifted = earlier_totals(united, ["user_id"], "_value", {"_shift": F.col("_mark")}, inclusive=True, **by_value)
    return (
        shifted.where("_mark = 0").withColumn("_slot", (F.col("_value") + F.col("_shift")).cast("long")).join(catalog, "_slot")
        .select("user_id", "item_id", "timestamp_ms", F.col("candidate").alias("negative_item"), F.lit("catalog").alias("source"))
    )


def hard_negatives(train: DataFrame, users: DataFrame, items: DataFrame, k: int = 200) -> DataFrame:
    """Per target the best-scored catalog item that is neither the target nor an earlier positive of the user.

    Users are searched ``k`` deep first. The top list of a user travels as one array with the time each item first became
    positive, and each target filters it in place. Targets that find nothing, since their user likes the whole list, are
    searched again twice as deep, they alone, until all are served or the catalog ends; a list never needs to be longer
    than the user's positives and two more, so it ends below twice that. Every target of a user with a vector that has any
    allowed item gets its row.
    """
    outcomes = materialize(first_outcomes(standard_only(train, "hard negatives")))
    targets = outcomes.where(F.col("first_positive").isNotNull()).select("user_id", "item_id", F.col("first_positive").alias("timestamp_ms"))
    since = targets.select("user_id", "item_id", F.col("timestamp_ms").alias("since"))
    allowed = F.filter(
        F.coalesce("_top", F.array()),
        lambda e: (e["since"].isNull() | (e["since"] >= F.col("timestamp_ms"))) & (e["item_id"] != F.col("item_id")),
    )
    pending, catalog, found = targets.join(users.select("user_id").distinct(), "user_id", "left_semi"), items.count(), []
    while True:
        active = users.join(pending.select("user_id").distinct(), "user_id", "left_semi")
        lists = exact_topk(active, items, k).join(since, ["user_id", "item_id"], "left").groupBy("user_id").agg(
            F.array_sort(F.collect_list(F.struct("retrieval_rank", "item_id", "since"))).alias("_top")
        )
        searched = materialize(
            pending.join(lists, "user_id", "left").select("user_id", "item_id", "timestamp_ms", F.get(allowed, F.lit(0)).alias("_pick"))
        )
        found.append(searched.where(F.col("_pick").isNotNull()))
        pending = searched.where(F.col("_pick").isNull()).drop("_pick")
        if k >= catalog or pending.isEmpty():
            break
        k = min(2 * k, catalog)
    return reduce(DataFrame.unionByName, found).select(
        "user_id", "item_id", "timestamp_ms",
        F.col("_pick.item_id").alias("negative_item"), F.col("_pick.retrieval_rank").alias("negative_rank"),
    )
