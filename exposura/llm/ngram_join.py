"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Overlap counts of pairs of documents are accumulated block by block, and a pair is discarded as soon as
bounds that follow from the two set sizes rule it out:

1. A pair at Jaccard ``percent`` needs an overlap of ``percent (a + b) / (100 + percent)``. In any fixed order
   of all n-grams the first n-gram the two share then lies among the first ``n - ceil(percent n / 100) + 1`` of
   either, and the leading n-grams they share, with all that lies behind, must reach the needed overlap. The
   order takes n-grams of seldom-used count buckets first, so that passages that many documents share are
   hardly ever among the leading ones.
2. Rows of these leading n-grams are range-partitioned and sorted by (n-gram, set size, document). A row meets
   the next ``WINDOW`` rows of its n-gram, and the meetings of a pair are counted. In wide groups, which are larger
   or cut by a batch's edge, rows do not meet. A few more leading n-grams are taken than 1. asks for, so a pair that
   links shares that many more; it was met in other groups, or both its documents stand in several wide groups. Only
   documents that do are tied to the others of those groups. So a group never costs more than a constant per row,
   every pair that links is connected through candidate pairs, and a common n-gram or two connect nothing else.
3. Inside each connected set of candidates the product is computed exactly, in blocks of bounded size; only
   blocks whose set sizes can reach the threshold meet. A block returns each document with the smallest one it
   is linked with through the block, so rows out never exceed rows in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from exposura.llm.components import components
from exposura.llm.ordering import drop_few, join_few, join_unique
from exposura.llm.text_kernel import distinct_per_row, mix, released, row_lists, shingle_names, slices, word_names
from exposura.session import discard, materialize

WORDS = 4
PERCENT = 85
# Count buckets of the n-gram order: two megabytes, whatever the size of the corpus.
BUCKET_BITS = 18
_CHUNK = 1024
# Neighbours a leading n-gram's row is compared with.
WINDOW = 32
# One leading n-gram more for so many n-grams of a document, and the most of these.
MORE_PER, MOST_MORE = 32, 7
# Bounds of a block of the product: documents, and n-grams of all of them.
BLOCK_ROWS = 2048
BLOCK_CELLS = 1_000_000
# Columns of the incidence matrix with more documents than this are multiplied as a dense matrix.
_DENSE = 64


def _buckets(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_shingles(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, distinct shingle names, row of each)`` of slices of a batch."""
    for first, last, data, offsets in slices(column):
        names, owner = distinct_per_row(*shingle_names(*word_names(data, offsets), words))
        yield first, last - first, names, owner


def bucket_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many (document, shingle) pairs of the corpus fall in each count bucket."""
    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, names, _ in document_shingles(batch.column(0), words):
                total += np.bincount(_buckets(names), minlength=len(total))
        yield chunk_rows(total)

    def chunk_rows(total):
        parts = total.reshape(-1, _CHUNK)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * _CHUNK, pa.int32()), pa.array(total))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), lists], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, _CHUNK)
            for chunk, row in zip(batch.column(0).to_pylist(), values):
                sums[chunk] = sums.get(chunk, 0) + row
        for chunk, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([row.tolist()], pa.list_(pa.int64()))], ["chunk", "counts"])

    schema = "chunk int, counts array<long>"
    summed = docs.select("text").mapInArrow(released(count), schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in summed.collect():  # 256 rows of 1,024 counts
        out[row["chunk"] * _CHUNK:(row["chunk"] + 1) * _CHUNK] = row["counts"]
    return out


def _more(n):
    """Leading n-grams of a set of ``n`` beyond the least number; a set never has more of them than a larger one."""
    if isinstance(n, np.ndarray):
        return np.minimum(n // MORE_PER, MOST_MORE)
    return F.least(F.floor(n / MORE_PER), F.lit(MOST_MORE))


def _share(n: Column, percent: int) -> Column:
    return F.ceil(percent * n / 100)


def _wide_needed(n: Column, percent: int) -> Column:
    """In so many wide groups a set of ``n`` stands that links with one it was not met with: what its smallest partner has."""
    return 1 + _more(_share(n, percent))


def _size_class(n: Column, percent: int) -> Column:
    """Sets that link are of the same class or of two neighbouring ones."""
    return F.floor(F.log(n) / (1.0001 * math.log(100 / percent)))  # a hair wide, for sizes exactly at the bound


def profiles(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per row of ``docs``: set size, two names of the whole set, and its leading shingles in order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32).clip(max=2**32 - 1))

    def work(batches):
        order_of = shared.value
        for batch in batches:
            for first, rows, names, owner in document_shingles(batch.column(1), words):
                sizes = np.bincount(owner, minlength=rows)
                starts = np.searchsorted(owner, np.arange(rows))
                sums = []
                for salt in (1, 2):
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(names + np.uint64(salt)))])
                    sums.append((running[starts + sizes] - running[starts]).view(np.int64))
                order = np.lexsort((names, order_of[_buckets(names)], owner))
                place = np.arange(len(names)) - starts[owner]
                lead = sizes - -(-percent * sizes // 100) + 1 + _more(sizes)  # all, where that is more than there are
                keep = place < lead[owner]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                    row_lists(names[order][keep].view(np.int64), owner[keep], rows, pa.int64()),
                ], ["doc_id", "n_shingles", "name_a", "name_b", "lead"])

    return docs.select("doc_id", "text").mapInArrow(
        released(work), "doc_id long, n_shingles long, name_a long, name_b long, lead array<long>"
    )


def _compare(percent: int):
    """A function for ``mapInArrow`` over sorted rows ``(shingle, n, doc)``: pairs of a batch, and rows of its wide groups.

    A pair's ``hits`` counts the leading shingles it was met at. A group is wide if it has more than ``WINDOW`` rows or
    may go on outside the batch; its rows come out as they are.
    """
    names = ["a", "b", "n_a", "n_b", "hits", "shingle", "n", "doc"]

    def pairs(a, b, n_a, n_b):
        swap = a > b
        rows = np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)])
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, rows[0] != rows[1]]
        starts = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]) if rows.shape[1] else np.zeros(0, int)
        return table([*rows[:, starts], np.diff(np.r_[starts, rows.shape[1]])], len(starts))

    def table(columns, count, first=0):
        out = [pa.nulls(count, pa.int64())] * len(names)
        out[first:first + len(columns)] = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(out, names)

    def work(batches):
        for batch in batches:
            shingle, n, doc = (batch.column(i).to_numpy() for i in range(3))
            count = len(shingle)
            if count == 0:
                continue
            wide = np.zeros(count, bool)
            if count > WINDOW:
                wide[:count - WINDOW] = shingle[:count - WINDOW] == shingle[WINDOW:]
                wide = np.isin(shingle, shingle[wide])
            wide |= (shingle == shingle[0]) | (shingle == shingle[-1])
            left, right = [], []
            for step in range(1, min(WINDOW, count - 1) + 1):
                a, b = slice(0, count - step), slice(step, count)
                close = (shingle[a] == shingle[b]) & (100 * n[a] >= percent * n[b]) & ~wide[a]
                if not close.any():  # nor can there be any further on, rows being sorted
                    break
                at = np.flatnonzero(close)
                left.append(at)
                right.append(at + step)
            if left:
                left, right = np.concatenate(left), np.concatenate(right)
                yield pairs(doc[left], doc[right], n[left], n[right])
            yield table([shingle[wide], n[wide], doc[wide]], int(wide.sum()), first=5)

    return work


def _wide_links(wide: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect the documents of ``wide(shingle, n, doc)`` which may link without having been met.

    Inside a wide group each is tied to the smallest document of its size class, and that to the one of the next class.
    """
    often = wide.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= _wide_needed(F.col("n"), percent))
    rows = materialize(wide.join(often, ["doc", "n"], "left_semi").select("shingle", "doc", _size_class(F.col("n"), percent).alias("size_class")))
    heads = materialize(rows.groupBy("shingle", "size_class").agg(F.min("doc").alias("head")))
    above = heads.select("shingle", (F.col("size_class") - 1).alias("size_class"), F.col("head").alias("next_head"))
    return join_unique(rows, heads, ["shingle", "size_class"]).select(F.col("doc").alias("a"), F.col("head").alias("b")).unionByName(
        heads.join(above, ["shingle", "size_class"]).select(F.col("head").alias("a"), F.col("next_head").alias("b"))
    )


def candidate_pairs(leads: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ids that connect every two documents that link. ``leads``: doc_id, n_shingles, lead.

    What two sets share of their leading shingles, and what lies behind the leading part of one of them, is all they
    overlap in. A pair that links shares so many leading shingles as the smaller set has beyond the least number, and one
    more. So if it shares fewer in wide groups than ``_wide_needed``, it was met, and with these its ``hits`` and what lies
    behind reach the needed overlap; otherwise ``_wide_links`` connects it.
    """
    rows = leads.select(F.explode("lead").alias("shingle"), F.col("n_shingles").alias("n"), F.col("doc_id").alias("doc"))
    ordered = rows.repartitionByRange("shingle", "n", "doc").sortWithinPartitions("shingle", "n", "doc")
    found = materialize(ordered.mapInArrow(
        _compare(percent), "a long, b long, n_a long, n_b long, hits long, shingle long, n long, doc long"
    ))
    pairs = found.where("a is not null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("hits").alias("hits"))
    def behind(n: Column) -> Column:
        return F.greatest(_share(n, percent) - 1 - _more(n), F.lit(0))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    unmet = _wide_needed(F.greatest(n_a, n_b), percent) - 1
    needed = percent * (n_a + n_b) / (100 + percent)
    # half a shingle of slack for the division
    kept = pairs.where(F.col("hits") + unmet + F.greatest(behind(n_a), behind(n_b)) >= needed - 0.5).select("a", "b")
    wide = found.where("doc is not null").select("shingle", "n", "doc")
    links = materialize(kept.unionByName(_wide_links(wide, percent)).distinct())
    discard(found)
    return links


def block_links(docs: np.ndarray, sizes: np.ndarray, names: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Product of one block with itself: each document that links, and the smallest it is connected with here."""
    count = len(docs)
    order = np.argsort(names, kind="stable")
    names, rows = names[order], rows[order]
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    used = np.diff(np.r_[starts, len(names)])
    column = np.repeat(np.arange(len(starts)), used)
    many = used > 1
    overlap = np.zeros((count, count), np.float32)
    flat = overlap.reshape(-1)
    few = many & (used <= _DENSE)
    kept = few[column]
    own_column, own_row = column[kept], rows[kept]
    for step in range(1, int(used[few].max()) if few.any() else 0):
        same = np.flatnonzero(own_column[:-step] == own_column[step:])
        a, b = own_row[same], own_row[same + step]
        codes, times = np.unique(np.minimum(a, b) * count + np.maximum(a, b), return_counts=True)
        flat[codes] += times
    dense = np.flatnonzero(used > _DENSE)
    place = np.full(len(starts), -1)
    for at in range(0, len(dense), 1024):
        some = dense[at:at + 1024]
        place[:] = -1
        place[some] = np.arange(len(some))
        kept = place[column] >= 0
        matrix = np.zeros((count, len(some)), np.float32)
        matrix[rows[kept], place[column[kept]]] = 1
        overlap += np.triu(matrix @ matrix.T, 1)
    a, b = np.nonzero(overlap)
    shared = overlap[a, b].astype(np.int64)
    linked = 100 * shared >= percent * (sizes[a] + sizes[b] - shared)
    a, b = a[linked], b[linked]
    label = np.arange(count)
    while True:  # smallest label over links, then labels of labels, until nothing changes
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    linked_rows = np.flatnonzero(np.bincount(np.r_[a, b], minlength=count))
    return docs[linked_rows], docs[label[linked_rows]]


def _product(percent: int):
    def work(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("doc", kind="stable")
        lengths = batch["names"].map(len).to_numpy()
        names = np.concatenate(batch["names"].to_list()) if len(batch) else np.zeros(0, np.int64)
        docs, link = block_links(batch["doc"].to_numpy(), lengths, names, np.repeat(np.arange(len(batch)), lengths), percent)
        return pd.DataFrame({"a": docs, "b": link})

    return work


def verified_links(docs: DataFrame, grouped: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` inside each candidate set. ``grouped``: doc_id, n_shingles, component."""
    classed = grouped.withColumn("size_class", _size_class(F.col("n_shingles"), percent))
    totals = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("cells"))
    small = (F.col("rows") <= BLOCK_ROWS) & (F.col("cells") <= BLOCK_CELLS)
    totals = materialize(totals.withColumn("small", small))
    packed = totals.where("small").agg(F.sum("rows"), F.sum("cells")).first()
    buckets = max(1, 2 * -(-(packed[0] or 0) // BLOCK_ROWS), 2 * -(-(packed[1] or 0) // BLOCK_CELLS))
    marked = materialize(classed.join(totals.select("component", "small"), "component"))
    # candidate sets that fit in a block share blocks with others; nothing of two sets can link
    alone = marked.where("small").select("doc_id", F.pmod(F.hash("component"), F.lit(buckets)).cast("string").alias("part"))
    # larger ones are cut by size class and hash; classes meet themselves and the next one
    large = marked.where("not small")
    cuts = large.groupBy("component", "size_class").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / (BLOCK_ROWS // 2)), F.ceil(F.sum("n_shingles") / (BLOCK_CELLS // 2))).alias("cuts")
    )
    above = cuts.select("component", (F.col("size_class") - 1).alias("size_class"), F.col("cuts").alias("cuts_above"))
    below = cuts.select("component", (F.col("size_class") + 1).alias("size_class"), F.col("cuts").alias("cuts_below"))
    keys = ["component", "size_class"]
    placed = (
        large.join(cuts, keys).join(above, keys, "left").join(below, keys, "left")
        .withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.col("cuts")))
    )
    def key(class_a, cut_a, class_b, cut_b):
        return F.concat_ws(":", "component", class_a, cut_a, class_b, cut_b)
    cls = F.col("size_class")
    def seq(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    parts = F.concat(
        F.transform(seq(F.col("cuts")), lambda x: key(cls, F.least(F.col("cut"), x), cls, F.greatest(F.col("cut"), x))),
        F.transform(seq(F.coalesce("cuts_above", F.lit(0))), lambda x: key(cls, F.col("cut"), cls + 1, x)),
        F.transform(seq(F.coalesce("cuts_below", F.lit(0))), lambda x: key(cls - 1, x, cls, F.col("cut"))),
    )
    routes = alone.unionByName(placed.select("doc_id", F.explode(parts).alias("part")))
    wanted = materialize(routes.groupBy("doc_id").agg(F.collect_set("part").alias("parts")))

    def sets(batches):
        for batch in batches:
            for first, rows, names, owner in document_shingles(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), batch.column(2).slice(first, rows),
                    row_lists(names.view(np.int64), owner, rows, pa.int64()),
                ], ["doc", "parts", "names"])

    texts = join_few(docs.select("doc_id", "text"), wanted, "doc_id")
    rows = texts.select("doc_id", "text", "parts").mapInArrow(released(sets), "doc long, parts array<string>, names array<long>")
    rows = rows.select("doc", F.explode("parts").alias("part"), "names")
    return rows.groupBy("part").applyInPandas(_product(percent), "a long, b long")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``.

    Two documents link when ``percent`` of the union of their shingle sets is shared; ``component_id`` is the
    smallest doc_id reachable by links, a document's own where it has none.

    A null or empty text, or one of white space, has an empty set and no links. A text shorter than ``words``
    words is one shingle. Repeated rows give repeated rows of the result; rows with the same doc_id are one
    document whose links are joined. A null doc_id keeps its row, with a null component. Other columns are
    ignored, an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = bucket_counts(docs, words)
    profile = materialize(profiles(docs, counts, words, percent))
    known = profile.where("doc_id is not null and n_shingles > 0")
    same_set = known.groupBy("n_shingles", "name_a", "name_b").agg(F.min("doc_id").alias("leader"))
    sets = materialize(known.select("doc_id", "n_shingles", "name_a", "name_b"))
    member = materialize(join_unique(sets, same_set, ["n_shingles", "name_a", "name_b"]).select("doc_id", "n_shingles", "leader"))
    leaders = member.where("doc_id = leader").select("doc_id", "n_shingles").distinct()
    followers = materialize(member.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("leader")).alias("follows")).where("follows"))
    sizes = materialize(profile.select("doc_id", "n_shingles"))
    candidates = candidate_pairs(drop_few(known.select("doc_id", "n_shingles", "lead"), followers, "doc_id"), percent)
    discard(profile, sets)
    sets_of_candidates = components(candidates)
    grouped = leaders.join(sets_of_candidates, leaders["doc_id"] == sets_of_candidates["id"]).select("doc_id", "n_shingles", "component")
    links = materialize(verified_links(docs, materialize(grouped), words, percent))
    # copies follow their leader afterwards; only a doc_id with several sets ties leaders together
    ids = materialize(member.select("doc_id", "leader").distinct())
    least = ids.groupBy("doc_id").agg(F.min("leader").alias("least"), F.count(F.lit(1)).alias("sets"))
    ties = join_unique(ids, least.where("sets > 1"), ["doc_id"]).where("leader != least")
    labels = components(links.unionByName(ties.select(F.col("leader").alias("a"), F.col("least").alias("b"))))
    led = materialize(least.select("doc_id", F.col("least").alias("id")))
    found = join_unique(led, labels, ["id"], "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    out = join_unique(sizes, found, ["doc_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
