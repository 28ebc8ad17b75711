"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are turned by a rotation learned on a bounded sample (principal axes, then a rotation that brings the
values close to their signs) and coded by their signs. A code is cut into substrings, and each block of rows keeps an
inverted index for every substring. Codes within radius ``r`` of a query agree with it, in at least one of ``m``
substrings, up to ``floor(r / m)`` bits; probing all those entries retrieves every code within the radius. What is
retrieved is reranked on the original vectors. The radius is learned on the sample too, where true neighbours are
known; since neighbours in the full table are nearer than those in a sample, it errs on the wide side. A block that
retrieves fewer than ``k`` rows for a query widens the radius for it until it has ``k`` or all.

Queries and rows are cut into blocks of bounded size; each pair of blocks is one task and returns at most ``k`` rows
for each query, whatever the vectors are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from exposura.session import materialize

SAMPLE_ROWS = 8192
BITS = 128
SUBSTRING = 8
KEPT_NEIGHBOURS = 0.96  # share of the sample's true neighbours that the radius must reach
BLOCK_CELLS = 1 << 19  # numbers in a block of rows: 8,192 vectors of 64
QUERY_CELLS = 1 << 16


@dataclass
class Coder:
    mean: np.ndarray
    turns: np.ndarray  # (dimension, BITS)
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Substrings of the codes, one byte each."""
        return np.packbits((vectors - self.mean) @ self.turns > 0, axis=1)


def _rotation(data: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A rotation of ``data`` that brings it close to its signs."""
    turn, _ = np.linalg.qr(rng.normal(size=(data.shape[1], data.shape[1])))
    for _ in range(rounds):
        turned = data @ turn
        u, _, v = np.linalg.svd(np.sign(turned).T @ data)
        turn = (u @ v).T
    return turn


def fit_coder(sample: np.ndarray, k: int, seed: int = 5) -> Coder:
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred[:4096], full_matrices=False)
    axes = axes[:min(len(axes), BITS)].T
    if axes.shape[1] == 0:
        axes = np.eye(dimension)[:, :min(dimension, BITS)]
    parts, made = [], 0
    while made < BITS:  # several rotations where there are fewer axes than bits
        turn = axes @ _rotation(centred @ axes, rng)
        parts.append(turn[:, :BITS - made])
        made += parts[-1].shape[1]
    coder = Coder(mean, np.concatenate(parts, axis=1), BITS)
    codes = coder.codes(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    products = sample[asked] @ sample.T
    products[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-products, axis=1)[:, :min(k, len(sample) - 1)]
    away = np.bitwise_count(codes[asked][:, None, :] ^ codes[near]).sum(axis=2) if near.size else np.zeros((1, 1))
    coder.radius = int(np.quantile(away, KEPT_NEIGHBOURS, method="higher"))
    return coder


class BlockIndex:
    """Inverted indexes of one block of rows, one for each substring: a bit map of the rows of each of its values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.entries = np.zeros((codes.shape[1], 1 << SUBSTRING, -(-len(codes) // 8)), np.uint8)
        place = np.arange(len(codes))
        for j in range(codes.shape[1]):
            np.bitwise_or.at(self.entries[j], (codes[:, j], place >> 3), (128 >> (place & 7)).astype(np.uint8))

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows have a code within ``radius`` of each query's: all of them, found by probing."""
        maps = np.zeros((len(queries), self.entries.shape[2]), np.uint8)
        values = np.arange(1 << SUBSTRING, dtype=np.uint8)
        reach = radius // self.codes.shape[1]
        for j in range(self.codes.shape[1]):
            asked, which = np.unique(queries[:, j], return_inverse=True)
            probed = np.stack([
                np.bitwise_or.reduce(self.entries[j][np.bitwise_count(values ^ value) <= reach], axis=0) for value in asked
            ])
            maps |= probed[which]
        found = np.unpackbits(maps, axis=1, count=len(self.codes)).view(bool)
        away = np.zeros(found.shape, np.uint8)
        for word in range(0, BITS // 8, 8):  # what was retrieved is checked on the whole code
            own, other = (np.ascontiguousarray(c[:, word:word + 8]).view(np.uint64)[:, 0] for c in (queries, self.codes))
            away += np.bitwise_count(own[:, None] ^ other[None, :])
        return found & (away <= radius)


def _search(coder_of, k: int):
    columns = ["query_id", "vec_id", "score"]

    def work(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        coder = coder_of()
        vectors, asked = np.stack(rows["vector"].to_list()), np.stack(queries["vector"].to_list())
        ids, names = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        index, codes = BlockIndex(coder.codes(vectors)), coder.codes(asked)
        out, pending, radius = [], np.arange(len(asked)), coder.radius
        while len(pending):
            own = ids[None, :] == names[pending, None]
            found = index.within(codes[pending], radius) & ~own
            enough = found.sum(axis=1) >= np.minimum(k, len(ids) - own.sum(axis=1))
            products = np.where(found, asked[pending] @ vectors.T, -np.inf)
            if len(ids) > k:
                least = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                least = np.full(len(pending), -np.inf)
            for at in np.flatnonzero(enough):
                # matrix products of equal vectors may differ in the last bit; what is near the edge is summed again
                near = np.flatnonzero(found[at] & (products[at] >= least[at] - 1e-9 * max(1.0, abs(least[at])) if np.isfinite(least[at]) else found[at]))
                score = (vectors[near] * asked[pending[at]]).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(best), names[pending[at]]), ids[near][best], score[best]))
            pending = pending[~enough]
            radius = min(BITS, radius + 8)
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else [] for i, c in enumerate(columns)})

    return work


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of the largest inner product that are found.

    Both tables have vec_id and embedding. A row's own vec_id is no candidate of its query; ties go to the smaller vec_id;
    a query with fewer candidates gets them all. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows with a null vec_id. All vectors must have the same length. Repeated rows
    count once; two vectors under one vec_id are two candidates and their queries are answered together. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def clean(df):
        vector = F.col("embedding").cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(~bad & F.exists("vector", lambda x: x != 0)).distinct()

    rows, asked = materialize(clean(embeddings)), materialize(clean(queries))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    wanted = asked.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if not shape["n"] or not wanted["n"]:
        return spark.createDataFrame([], schema)
    if len({shape["low"], shape["high"], wanted["low"], wanted["high"]}) > 1:
        raise ValueError("vectors of different lengths cannot be compared")
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE_ROWS).collect()  # a bounded sample
    coder = spark.sparkContext.broadcast(fit_coder(np.array([r["vector"] for r in sample]), k))
    row_blocks = -(-shape["n"] * shape["low"] // BLOCK_CELLS)
    query_blocks = -(-wanted["n"] * shape["low"] // QUERY_CELLS)

    def block(name, count):
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count)).alias(name)

    def every(name, count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)

    left = asked.select("vec_id", "vector", block("query_block", query_blocks), every("row_block", row_blocks))
    right = rows.select("vec_id", "vector", block("row_block", row_blocks), every("query_block", query_blocks))
    keys = ["query_block", "row_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _search(lambda: coder.value, k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
