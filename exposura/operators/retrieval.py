"""Top-K retrieval by inner product: exact, hybrid with popularity, and approximate by hyperplanes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.checks import require_columns
from exposura.functions.columns import l2_normalize, uniform_hash
from exposura.operators.contexts import context_starts, ranking_contexts
from exposura.operators.popularity import pair_score

# Items of one block, which stream through a task; cells of queries and places of their top lists that a task holds.
MAX_BLOCK_ROWS = 1_048_576
MAX_BLOCK_CELLS = 8_388_608
MAX_TOP_PLACES = 2_097_152
MIN_CHUNK_ROWS = 1_024
TILE_CELLS = 2_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) != 1 or lengths[0].as_py() is None:
        raise ValueError(f"vectors differ in length: {lengths.to_pylist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), lengths[0].as_py())


class _TopLists:
    """The ``k`` best items of some queries while items pass by in the order of their ids; NaN scores take no part.

    Scores above a query's ``k``-th best so far wait until they are about as many as the lists, then all are cut to ``k``.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.floor = queries, k, np.full(len(queries), -np.inf)
        self.waiting, self.count, self.kept = [], 0, 0

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, TILE_CELLS // len(ids))
        for start in range(0, len(self.queries), step):
            scores = self.queries[start:start + step] @ vectors.T
            better = scores > self.floor[start:start + step, None]
            if np.count_nonzero(better) > self.k * len(scores):
                kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1, None] if self.k < len(ids) else -np.inf
                better &= ~(scores < kth)  # ties with the k-th included
            row, column = np.nonzero(better)
            if len(row):
                self.waiting.append((row.astype(np.int32) + np.int32(start), scores[row, column], ids[column]))
                self.count += len(row)
        if self.count - self.kept > max(self.k, self.k * len(self.queries) // 2):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, item, score and rank of the best; among equal scores the item that came first goes first."""
        if not self.waiting:
            return (*[np.empty(0, np.int64)] * 2, np.empty(0), np.empty(0, np.int64))
        row, score, item = (np.concatenate(part) for part in zip(*self.waiting))
        order = np.lexsort((-score, row))
        row, score, item = row[order], score[order], item[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, score, item, place = row[best], score[best], item[best], place[best]
        self.waiting, self.count, self.kept = [(row, score, item)], len(row), len(row)
        full = place == self.k - 1
        self.floor[row[full]] = score[full]
        return row, item, score, place + 1


def topk_within(
    queries: DataFrame, items: DataFrame, k: int, by: Sequence[str] = (),
    query_col: str = "user_id", item_col: str = "item_id", vector: str = "embedding",
    max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Exact top ``k`` items per query among the items of the same ``by`` bucket.

    Returns ``(*by, query, item, retrieval_score, retrieval_rank)``. Both sides are cut into hash blocks, and every (query
    block, item block) pair of a bucket is one group of sorted rows: its queries come first and are held with their top
    lists, whose places are bounded; its items stream past in batches. Neither all pairs nor a whole hot bucket is ever
    gathered, and only top lists leave a task. ``by`` must have few distinct values, such as the buckets of a hash table.
    Query blocks shrink on small inputs to keep all cores busy.
    """
    if int(k) < 1:
        raise ValueError("k must be positive")
    by = list(by)
    keys = by or ["_all"]
    left = queries.select(*by, query_col, F.col(vector).alias("_vector"))
    right = items.select(*by, item_col, F.col(vector).alias("_vector"))
    if not by:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    spread = 2 * queries.sparkSession.sparkContext.defaultParallelism
    rows = F.count(F.lit(1))
    cells = rows * F.coalesce(F.max(F.size("_vector")), F.lit(1))
    most = max(1, min(max_block_rows, MAX_TOP_PLACES // int(k)))
    item_blocks = right.groupBy(*keys).agg(F.ceil(rows / max_block_rows).cast("int").alias("_item_blocks"))
    query_blocks = left.groupBy(*keys).agg(
        F.greatest(F.ceil(rows / most), F.ceil(cells / MAX_BLOCK_CELLS), F.least(F.lit(spread), F.ceil(rows / MIN_CHUNK_ROWS)))
        .cast("int").alias("_query_blocks")
    )
    # one row per bucket; Spark decides by its size how it is joined
    shape = item_blocks.join(query_blocks, keys)

    def spread_out(table: DataFrame, own: str, own_count: str, other: str, other_count: str, key: str) -> DataFrame:
        return (
            table.join(shape, keys)
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_count).cast("long")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
            .drop("_item_blocks", "_query_blocks")
        )

    types = {**dict(left.dtypes), **dict(right.dtypes)}
    same = dict(left.dtypes)["_vector"] == dict(right.dtypes)["_vector"]
    passed = F.col("_vector") if same else F.col("_vector").cast("array<double>")
    group = [*keys, "_qb", "_ib"]
    asking = spread_out(left, "_qb", "_query_blocks", "_ib", "_item_blocks", query_col).select(
        *group, F.lit(0).alias("_side"), F.col(query_col).alias("_query"), F.lit(None).cast(types[item_col]).alias("_item"), passed.alias("_vector")
    )
    asked = spread_out(right, "_ib", "_item_blocks", "_qb", "_query_blocks", item_col).select(
        *group, F.lit(1).alias("_side"), F.lit(None).cast(types[query_col]).alias("_query"), F.col(item_col).alias("_item"), passed.alias("_vector")
    )
    columns = [*keys, query_col, item_col, "retrieval_score", "retrieval_rank"]
    width = len(group)

    def finished(head: pa.RecordBatch, asked_by: list[pa.Array], lists: list[_TopLists], item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        names, start = pa.concat_arrays(asked_by), 0
        for top in lists:
            row, item, score, rank = top.cut()
            same_key = pa.array(np.zeros(len(row), np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[head.column(i).take(same_key) for i in range(len(keys))], names.slice(start, len(top.queries)).take(pa.array(row)),
                    pa.array(item, item_type), pa.array(score), pa.array(rank.astype(np.int32)),
                ], columns,
            )
            start += len(top.queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = current = item_type = None
        asked_by, lists = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            item_type = batch.schema.field(width + 2).type
            marks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 1)]
            edges = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                run, key = batch.slice(start, end - start), tuple(m[start] for m in marks[:width])
                if key != current:
                    if lists:
                        yield from finished(head, asked_by, lists, item_type)
                    head, current, asked_by, lists = run.slice(0, 1), key, [], []
                vectors = _matrix(run.column(width + 3))
                if marks[width][start] == 0:
                    asked_by.append(run.column(width + 1))
                    lists += [_TopLists(vectors[i:i + MIN_CHUNK_ROWS], int(k)) for i in range(0, len(vectors), MIN_CHUNK_ROWS)]
                    continue
                ids = run.column(width + 2).to_numpy(zero_copy_only=False)
                for top in lists:
                    top.add(vectors, ids)
        if lists:
            yield from finished(head, asked_by, lists, item_type)

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in columns[:-2]], "retrieval_score double", "retrieval_rank int"])
    partial = (
        asking.unionByName(asked).repartition(*group).sortWithinPartitions(*group, "_side", "_item").mapInArrow(search, schema)
    )
    ranked = Window.partitionBy(*by, query_col).orderBy(F.desc("retrieval_score"), F.col(item_col))
    return (
        partial.withColumn("retrieval_rank", F.row_number().over(ranked))
        .where(F.col("retrieval_rank") <= k)
        .select(*by, query_col, item_col, "retrieval_score", "retrieval_rank")
    )


def exact_topk(
    queries: DataFrame, items: DataFrame, k: int, query_col: str = "user_id", item_col: str = "item_id",
    vector: str = "embedding", max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Exact maximum-inner-product search; ``k`` above the catalog size returns the whole catalog."""
    return topk_within(queries, items, k, (), query_col, item_col, vector, max_block_rows)


def with_popularity(items: DataFrame, prior: DataFrame, vector: str = "embedding") -> DataFrame:
    """Append the popularity prior as one more coordinate of every item vector."""
    joined = items.join(prior.select("item_id", "prior"), "item_id", "left")
    extra = F.array(F.coalesce(F.col("prior"), F.lit(0.0)))
    return joined.select("item_id", F.concat(F.transform(vector, lambda x: x.cast("double")), extra).alias(vector))


def weighted_queries(users: DataFrame, weight: Column, vector: str = "embedding") -> DataFrame:
    """Append the popularity weight to user vectors: the inner product becomes dot + weight * prior."""
    return users.withColumn(
        vector, F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(weight.cast("double")))
    )


def retrieve_candidates(
    contexts: DataFrame, users: DataFrame, items: DataFrame, k: int = 200,
    popularity_weight: float = 0.0, prior: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` catalog items for every context, as of the context's first row.

    The score depends on the user alone, so each user is searched once and the list is joined to all
    of the user's contexts. Users without an embedding drop out.
    """
    require_columns(contexts, ["context_id", "user_id", "timestamp_ms"], "candidate contexts")
    if popularity_weight:
        if prior is None:
            raise ValueError("popularity-weighted retrieval needs the popularity prior")
        users, items = weighted_queries(users, F.lit(popularity_weight)), with_popularity(items, prior)
    starts = context_starts(contexts)
    wanted = users.join(contexts.select("user_id").distinct(), "user_id", "left_semi")
    carried = [name for name in ("date", "tab", "session_position") if name in contexts.columns]
    return starts.select("context_id", "user_id", "timestamp_ms", *carried).join(
        exact_topk(wanted, items, k), "user_id"
    ).select("context_id", "user_id", "timestamp_ms", "item_id", "retrieval_score", "retrieval_rank", *carried)


def observed_ranking_rows(
    log: DataFrame, users: DataFrame, items: DataFrame, max_gap_minutes: int = 30, window_size: int = 20,
    prior: DataFrame | None = None, popularity_weight: float = 0.0,
) -> DataFrame:
    """Score only the rows that were shown: contexts, retrieval score (0 if unknown), rank, label."""
    rows = ranking_contexts(log, max_gap_minutes, window_size)
    scored = pair_score(rows, users, items, 0.0, prior, popularity_weight, "retrieval_score")
    ranked = Window.partitionBy("context_id").orderBy(F.desc("retrieval_score"), "item_id", "timestamp_ms")
    return scored.withColumns(
        {"retrieval_rank": F.row_number().over(ranked), "label": F.col("long_view").cast("tinyint")}
    )


def hyperplanes(tables: int, bits: int, dimension: int, seed: int = 42) -> list[list[list[float]]]:
    """Random hyperplanes as plain numbers, ``[table][bit][coordinate]``, fixed by the seed.

    Their count is a parameter and does not grow with the data.
    """
    def draw(*parts: int) -> float:
        digest = hashlib.md5(":".join(["plane", *map(str, parts), str(seed)]).encode()).hexdigest()
        return int(digest[:12], 16) / float(1 << 48) - 0.5

    return [[[draw(t, b, d) for d in range(dimension)] for b in range(bits)] for t in range(tables)]


def hyperplane_buckets(
    table: DataFrame, tables: int, bits: int, dimension: int, seed: int = 42, vector: str = "embedding"
) -> DataFrame:
    """One row per hash table with ``lsh_table`` and ``lsh_bucket`` (the sign pattern of the vector)."""
    def bucket(planes: list[list[float]]) -> Column:
        value = F.lit(0)
        for bit, plane in enumerate(planes):
            side = F.aggregate(
                F.zip_with(vector, F.lit(plane), lambda x, c: x.cast("double") * c), F.lit(0.0), lambda s, x: s + x
            )
            value = value + F.when(side >= 0, F.lit(1 << bit)).otherwise(F.lit(0))
        return value

    patterns = [bucket(planes) for planes in hyperplanes(tables, bits, dimension, seed)]
    return table.select("*", F.posexplode(F.array(*patterns)).alias("lsh_table", "lsh_bucket"))


def approximate_topk(
    queries: DataFrame, items: DataFrame, k: int, tables: int = 4, bits: int = 3, dimension: int = 64,
    seed: int = 42, query_col: str = "user_id", item_col: str = "item_id",
) -> DataFrame:
    """Top ``k`` among the items that share a hyperplane bucket with the query in any table."""
    left = hyperplane_buckets(queries.select(query_col, "embedding"), tables, bits, dimension, seed)
    right = hyperplane_buckets(items.select(item_col, "embedding"), tables, bits, dimension, seed)
    found = topk_within(left, right, k, ["lsh_table", "lsh_bucket"], query_col, item_col)
    merged = found.groupBy(query_col, item_col).agg(F.max("retrieval_score").alias("retrieval_score"))
    ranked = Window.partitionBy(query_col).orderBy(F.desc("retrieval_score"), F.col(item_col))
    return merged.withColumn("retrieval_rank", F.row_number().over(ranked)).where(F.col("retrieval_rank") <= k)


def retrieval_recall(exact: DataFrame, found: DataFrame, k: int, query_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """One row: mean share of the exact top ``k`` that the other search also returned."""
    hits = found.select(query_col, item_col, F.lit(1).alias("_hit"))
    per_query = exact.join(hits, [query_col, item_col], "left").groupBy(query_col).agg(
        (F.count("_hit") / F.lit(float(k))).alias("_recall")
    )
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("_recall").alias("recall_at_k"))


def hash_vectors(table: DataFrame, key: str, columns: Sequence[str], dimension: int = 64) -> DataFrame:
    """Signed feature-hash vectors of unit length, built inside each row without a shuffle.

    Every ``column=value`` text (nulls as ``__NA__``) adds +1 or -1 to one coordinate; coordinate and
    sign come from its md5.
    """
    slots = []
    for name in columns:
        digest = F.md5(F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("__NA__"))))
        place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % dimension
        sign = F.when(F.substring(digest, 13, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))
        slots.append(F.struct(place.alias("place"), sign.alias("sign")))
    summed = F.aggregate(
        F.array(*slots), F.array_repeat(F.lit(0.0), dimension),
        lambda total, s: F.transform(total, lambda x, d: F.when(d == s["place"], x + s["sign"]).otherwise(x)),
    )
    return table.select(key, l2_normalize(summed).alias("embedding"))


def profile_vectors(
    positives: DataFrame, items: DataFrame, maximum: int | None = None, dimension: int = 64
) -> DataFrame:
    """Unit mean vector of each user's positive items, most active users first.

    Repeated (user, item) pairs are counted before the vectors are joined; the coordinate sums are
    ordinary aggregates with map-side combine. The vectors are never broadcast: Spark takes an array
    that is computed for a few numbers, however long it is. ``maximum`` keeps the top users by (positives desc,
    user asc), as the query set of a benchmark.
    """
    counted = positives.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = counted.join(items.select("item_id", "embedding").hint("merge"), "item_id")
    sums = joined.groupBy("user_id").agg(
        F.sum("_n").alias("positives"),
        *[F.sum(F.col("_n") * F.get("embedding", F.lit(d))).alias(f"_d{d}") for d in range(dimension)],
    )
    mean = F.array(*[F.col(f"_d{d}") / F.greatest(F.col("positives"), F.lit(1)) for d in range(dimension)])
    profiles = sums.select("user_id", "positives", mean.alias("_mean")).select(
        "user_id", "positives", l2_normalize(F.col("_mean")).alias("embedding")
    )
    if maximum is None:
        return profiles
    return profiles.orderBy(F.desc("positives"), "user_id").limit(maximum)


def replicate_corpus(items: DataFrame, multiplier: int, seed: int = 42, jitter: float = 1e-5) -> DataFrame:
    """``multiplier`` copies of every item with seeded Gaussian jitter, renormalised, under new ids."""
    stride = items.agg((F.max("item_id") + 1).alias("stride"))
    copies = items.select(
        "item_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))).alias("replica")
    ).withColumn("_new", F.col("item_id") + F.col("replica") * stride.scalar())

    def noise(position: Column) -> Column:
        u = F.greatest(uniform_hash(F.col("_new"), position, "a", seed), F.lit(1e-12))
        v = uniform_hash(F.col("_new"), position, "b", seed)
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * np.pi) * v)

    moved = F.transform("embedding", lambda x, position: x.cast("double") + F.lit(jitter) * noise(position))
    return copies.withColumn("_moved", moved).select(
        F.col("_new").alias("item_id"), "replica", l2_normalize(F.col("_moved")).alias("embedding")
    )
