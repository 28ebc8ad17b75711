"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

A document is searched by the shingles it shares with the benchmark as a whole, which a Bloom filter of bounded
size picks out in the first pass; containment of an item is not changed by leaving out other shingles. What is
left is indexed in partitions by its size. Containment ``t`` of an item of ``q`` shingles means a Jaccard
similarity of at least ``j = t q / (u + (1 - t) q)`` in a partition of sizes up to ``u``, so each pair of an item
class and a partition has its own number of MinHash bands of one row: enough that a pair at the threshold is missed
with a chance of ``MISSED``. Where that would take more than ``BANDS`` bands, the shingles themselves are the keys:
an item probes the ones it cannot do without, which misses nothing. Candidates are checked by exact containment.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposura.llm.ordering import drop_few
from exposura.llm.text_kernel import distinct_per_row, mix, released, row_lists, shingle_names, slices, word_names
from exposura.session import materialize

WORDS = 5
PERCENT = 80
BANDS = 64
MISSED = 1e-9
# The filter takes 32 bits for each benchmark shingle, within these bounds (two kilobytes and 32 megabytes).
_LEAST_BITS, _MOST_BITS = 14, 28
# A table of item keys up to this many rows is sent to all executors, a larger one is shuffled.
BROADCAST_ROWS = 500_000


def _all_shingles(data, offsets, lengths):
    """Distinct names of all runs of each length, with their row, sorted by row and name."""
    words, first = word_names(data, offsets)
    parts = [shingle_names(words, first, size, whole_if_short=False) for size in lengths]
    return distinct_per_row(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words, names`` of every item that has words; a short one is a single shingle."""
    def work(batches):
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                words, starts = word_names(data, offsets)
                names, owner = distinct_per_row(*shingle_names(words, starts, WORDS))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(starts)),
                    row_lists(names.view(np.int64), owner, last - first, pa.int64()),
                ], ["item_id", "n_words", "names"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    return rows.mapInArrow(work, "item_id long, n_words long, names array<long>").where("n_words > 0")


def _probes(names: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(names + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64) for salt in (11, 12)]


def _filter(items: DataFrame) -> np.ndarray:
    """A Bloom filter of all item shingles; its places are collected, as many as the filter has bits at most."""
    count = items.agg(F.sum(F.size("names"))).first()[0] or 0
    bits = min(_MOST_BITS, max(_LEAST_BITS, (32 * count - 1).bit_length() if count else 0))

    def places(batches):
        for batch in batches:
            names = batch.column(0).flatten().to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_probes(names, bits))))], ["place"])

    out = np.zeros(1 << bits, bool)
    for part in items.select("names").mapInArrow(places, "place long").distinct().toLocalIterator():
        out[part[0]] = True
    return np.packbits(out)


def size_class(n: int) -> int:
    return max(0, int(n).bit_length() - 1)


def bands_for(item_class: int, partition: int, percent: int = PERCENT) -> int:
    """Bands that a search for items of a class in a partition takes; 0 where shingles are the keys."""
    if partition < item_class - 1:
        return 1  # no document this small holds the item; kept for items at a class border
    t, q, u = percent / 100, 1 << item_class, (1 << (partition + 1)) - 1
    j = min(t * q / (u + (1 - t) * q), 0.999999) if q <= u else t * min(1.0, u / q)
    bands = math.ceil(math.log(MISSED) / math.log(1 - j))
    return bands if bands <= BANDS else 0


def _signature(names: np.ndarray, bands: int) -> np.ndarray:
    """The least mixed value of a set under each of the first ``bands`` hash functions."""
    salts = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty(bands, np.uint64)
    for at in range(0, bands, 16):
        out[at:at + 16] = mix(names[None, :] ^ salts[at:at + 16, None]).min(axis=1)
    return out


def _band_keys(names: np.ndarray, partition: int, bands: int) -> np.ndarray:
    """Band number, value and partition in one key."""
    return mix(_signature(names, bands) + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(partition << 1))


def _shingle_keys(names: np.ndarray, partition: int) -> np.ndarray:
    return mix(names ^ np.uint64(0x27D4EB2F165667C5) ^ np.uint64(partition << 1 | 1))


def _contained(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    sizes = items.select(F.size("names").alias("n"), "n_words").groupBy("n", "n_words").count().collect()  # few sizes
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")
    classes = sorted({size_class(r["n"]) for r in sizes})
    lengths = sorted({min(WORDS, r["n_words"]) for r in sizes})
    least = min(-(-percent * r["n"] // 100) for r in sizes)
    shared = spark.sparkContext.broadcast(_filter(items))

    def search(batches):
        known = np.unpackbits(shared.value).astype(bool)
        bits = len(known).bit_length() - 1
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                names, owner = _all_shingles(data, offsets, lengths)
                hit = np.logical_and(*[known[at] for at in _probes(names, bits)])
                names, owner = names[hit], owner[hit]
                counts = np.bincount(owner, minlength=last - first)
                starts = np.searchsorted(owner, np.arange(last - first + 1))
                rows, keys, sets = [], [], []
                for row in np.flatnonzero(counts >= least):
                    own = names[starts[row]:starts[row + 1]]
                    partition = size_class(len(own))
                    wanted = [bands_for(c, partition, percent) for c in classes]
                    parts = [_band_keys(own, partition, max(wanted))] if max(wanted) else []
                    if 0 in wanted:
                        parts.append(_shingle_keys(own, partition))
                    rows.append(first + row)
                    keys.append(np.unique(np.concatenate(parts)).view(np.int64))
                    sets.append(own.view(np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                        ["doc_id", "doc_names", "keys"],
                    )

    found = materialize(
        docs.select("doc_id", "text").mapInArrow(released(search), "doc_id long, doc_names array<long>, keys array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    partitions = [r[0] for r in found.select(F.floor(F.log2(F.size("doc_names") + F.lit(1e-9))).cast("int")).distinct().collect()]

    def probe(batches):
        for batch in batches:
            lists = []
            for names in batch.column(1).to_pylist():
                own = np.array(names, np.int64).view(np.uint64)
                parts = []
                for partition in partitions:
                    bands = bands_for(size_class(len(own)), partition, percent)
                    if bands:
                        parts.append(_band_keys(own, partition, bands))
                    else:  # one of these must be there, or too few are
                        parts.append(_shingle_keys(own[:len(own) - -(-percent * len(own) // 100) + 1], partition))
                lists.append(np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "names", "keys"])

    probes = items.select("item_id", "names").mapInArrow(probe, "item_id long, names array<long>, keys array<long>")
    item_keys = materialize(probes.select("item_id", F.explode("keys").alias("key")).distinct())
    small = item_keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found_keys = found.select("row", F.explode("keys").alias("key"))
    candidates = found_keys.join(F.broadcast(item_keys) if small else item_keys, "key").select("row", "item_id").distinct()
    checked = candidates.join(found.select("row", "doc_id", "doc_names"), "row").join(items.select("item_id", "names"), "item_id")
    return checked.select(
        "doc_id", "item_id", F.size("names").cast("long").alias("n_item"),
        F.size(F.array_intersect("doc_names", "names")).cast("long").alias("n_shared"),
    ).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``doc_id, item_id, n_item, n_shared, containment`` where a document holds at least ``percent`` of an item.

    ``n_item`` is the number of distinct five-word shingles of the item, A-Z lower-cased, ``n_shared`` those that
    occur anywhere in the whole document. An item of fewer words is one shingle, found where the document has
    that sequence of words. Items and texts that are null or have no words are in no pair. Each pair is returned
    once, with the largest overlap where rows repeat a doc_id or item_id; a null doc_id is left out. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    items = materialize(item_shingles(benchmark).where("item_id is not null"))
    pairs = _contained(docs, items, percent).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = F.max_by(F.struct("n_item", "n_shared", "containment"), F.struct("containment", "n_item")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark; rows with a null doc_id stay."""
    return drop_few(docs, materialize(contained_items(docs, benchmark, percent).select("doc_id").distinct()), "doc_id")
