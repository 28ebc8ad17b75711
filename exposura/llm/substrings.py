"""Suffix-array deduplication of repeated byte strings, over sampled suffixes.

A byte is removed when a string of ``LENGTH`` bytes over it also starts somewhere else. All suffixes of a corpus
are too many to sort, and need not be: in every window of ``LENGTH`` bytes the k-byte string with the least name is
an anchor that depends on the window alone, so equal windows have equal anchors at equal places. The windows that
share an anchor form a run, and only suffixes at anchors are sorted, under the name of their leading k bytes:

1. Each run gives one row: the name of its anchor, the name of all bytes of the run, and its place. Runs equal in
   both occur more than once as a whole; nothing more needs to be known about them. Counts are combined before
   the shuffle, so a passage in a third of all documents is one row for each task.
2. Anchors with several different runs are looked at byte by byte. One copy of each run fetches its bytes. The
   suffixes are range-partitioned by their leading bytes: Spark samples the splitters; each bucket is sorted by
   them, then by anchor and run. Suffixes of one anchor that a border parts are compared across it, see below.
   Within an anchor, windows are sorted by the names of their halves, the ties of the first key by the second, as
   in multikey quicksort, and neighbours are compared. An anchor with very many runs is cut into parts. Windows that
   a part has once meet those of other parts by name, as rows of an aggregation: first the bytes that ``NODE``
   adjoining windows have in common, since windows around bytes that no other part has are in no other part, and then
   the windows that are left. No task needs an anchor as a whole.
3. The repeated windows of a run hold at all its places. Spans are joined for each document and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from exposura.llm.ordering import join_unique
from exposura.llm.text_kernel import mix, prefix_names, released, slices, span_names
from exposura.session import materialize

LENGTH = 400
ANCHOR = 128
# Runs of one anchor that are compared in one task at a time; a run has at most length - anchor + 1 windows.
PART_RUNS = 1024
# Leading bytes of a suffix that decide its range; never more than its anchor has.
LEAD = 16
# Adjoining windows that are looked up by their common bytes first.
NODE = 16
# Windows compared at a time, which bounds the memory of a bucket: some 80 bytes for each.
_WINDOWS = 300_000
# A text is anchored piece by piece; pieces overlap so that no window is lost.
_PIECE = 1 << 20
# The name of a text's file, and its place there.
_ROW = "struct<file:long,place:long>"


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(bytes, offsets, row of each text, place of each text's first byte)`` of pieces of bounded size."""
    if len(offsets) != 2 or len(data) <= _PIECE:
        yield data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for at in range(0, len(data) - length + 1, _PIECE):
        part = data[at:at + _PIECE + length - 1]
        yield part, np.array([0, len(part)]), np.array([0]), np.array([at])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: row, anchor place, first and last window, anchor name, run name."""
    count = len(data) - length + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_names(data)
    places = np.arange(len(data) - anchor + 1)
    names = span_names(prefix, places, places + anchor)
    low = np.uint64((1 << 24) - 1)  # room for the places of a piece; equal names go to the first place
    if len(data) > int(low):
        raise ValueError("a piece is too long")
    keyed = (names & ~low) | places.astype(np.uint64)
    width, span = length - anchor + 1, 1
    while span * 2 <= width:  # least of windows of 1, 2, 4, ... places
        keyed = np.minimum(keyed[:-span], keyed[span:])
        span *= 2
    rest = width - span
    least = np.minimum(keyed[:len(keyed) - rest], keyed[rest:]) if rest else keyed
    least = (least[:count] & low).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:count]
    valid = np.arange(count) + length <= ends
    new = np.ones(count, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    stop = np.flatnonzero(np.r_[(least[1:] != least[:-1]) | ~valid[1:], True] & valid)
    at = least[first]
    rows = np.searchsorted(offsets, first, "right") - 1
    run = mix(span_names(prefix, first, stop + length) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return rows, at, first, stop, names[at], run


def find_runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``anchor, run, row, first, back, more``: a run's first window starts at ``first``, its anchor ``back`` bytes on,
    and ``more`` windows follow the first."""
    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, _, data, offsets in slices(batch.column(1)):
                for part, own, owner, base in _pieces(data, offsets, length):
                    rows, at, first, stop, name, run = runs_of(part, own, length, anchor)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(name.view(np.int64)), pa.array(run.view(np.int64)), ids.take(pa.array(start + owner[rows])),
                            pa.array(first - own[rows] + base[rows]), pa.array((at - first).astype(np.int32)), pa.array((stop - first).astype(np.int32)),
                        ], ["anchor", "run", "row", "first", "back", "more"])

    return docs.select("row", "text").mapInArrow(released(work), f"anchor long, run long, row {_ROW}, first long, back int, more int")


def _fetch(length: int, lead: int):
    """Bytes of the runs that a text has been asked for."""
    def work(batches):
        for batch in batches:
            texts, asked = batch.column(0), batch.column(1)
            out = [[], [], [], [], [], []]
            for text, wanted in zip(texts, asked):
                raw = memoryview(text.as_buffer())
                for one in wanted.as_py():
                    out[0].append(one["anchor"])
                    out[1].append(one["run"])
                    out[2].append(one["part"])
                    out[3].append(one["back"] if one["cut"] else None)
                    out[4].append(bytes(raw[one["first"]:one["first"] + one["more"] + length]))
                    out[5].append(bytes(raw[one["first"] + one["back"]:][:lead]))
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "run", "part", "back", "bytes", "lead"]
                )

    return work


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of some runs: which occur more than once, which were seen first in order, and each one's run."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes, counts)
    prefix, half = prefix_names(data), length // 2
    leading = span_names(prefix, first, first + half)
    order = np.argsort(leading, kind="stable")
    tied = np.flatnonzero(np.r_[False, leading[order[1:]] == leading[order[:-1]]] | np.r_[leading[order[1:]] == leading[order[:-1]], False]) if len(order) else np.zeros(0, int)
    again, novel = np.zeros(len(owner), bool), np.ones(len(owner), bool)
    if len(tied):
        some = order[tied]
        second = span_names(prefix, first[some] + half, first[some] + length)
        inner = np.lexsort((some, second, leading[some]))
        some, second = some[inner], second[inner]
        same = (leading[some[1:]] == leading[some[:-1]]) & (second[1:] == second[:-1])
        again[some[1:][same]] = True
        again[some[:-1][same]] = True
        novel[some[1:][same]] = False
    return again, novel, owner


def _spans_of(flags: np.ndarray, owner: np.ndarray, runs: int) -> list[list[tuple[int, int]]]:
    """For each run, its stretches of flagged windows as (first window, last window)."""
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    start = np.flatnonzero(flags & np.r_[True, ~flags[:-1] | (owner[1:] != owner[:-1])]) if len(flags) else np.zeros(0, int)
    stop = np.flatnonzero(flags & np.r_[~flags[1:] | (owner[1:] != owner[:-1]), True]) if len(flags) else np.zeros(0, int)
    out: list[list[tuple[int, int]]] = [[] for _ in range(runs)]
    for a, b in zip(start, stop):
        out[owner[a]].append((int(place[a]), int(place[b])))
    return out


def _node_width(length: int, anchor: int) -> int:
    return min(NODE, length - anchor + 1)


def node_names(texts: list[bytes], backs: list[int], owner: np.ndarray, place: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Of some windows (``place`` in run ``owner``): run, node and name of the node's common bytes, each once.

    Equal windows stand at equal distances from their anchors, so they are in the same node.
    """
    back = np.array(backs, np.int64)
    nodes = np.unique(np.stack([owner, (place - back[owner]) // width], axis=1), axis=0)
    runs, node = nodes[:, 0], nodes[:, 1]
    sizes = np.array([len(t) for t in texts])
    at = (np.cumsum(sizes) - sizes + back)[runs] + node * width
    names = span_names(prefix_names(np.frombuffer(b"".join(texts), np.uint8)), at + width - 1, at + length)
    return runs, node, mix(names + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _compare(length: int, width: int):
    """Repeated windows of each run of sorted rows ``(anchor, part, run, back, bytes)``; equal (anchor, part) stand together.

    A run that has a ``back``, since its anchor is cut into parts, comes with its bytes, the windows not seen before in
    its part, and their nodes.
    """
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    named = pa.list_(pa.struct([("node", pa.int32()), ("core", pa.int64())]))

    def stretches(spans, rows):
        return pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in rows], pair)

    def flush(keys, texts):
        again, novel, owner = repeated_windows(texts, length)
        spans = _spans_of(again, owner, len(texts))
        novel &= np.array([key[3] is not None for key in keys])[owner]
        fresh, nodes = _spans_of(novel, owner, len(texts)), [[] for _ in texts]
        if novel.any():
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            found = node_names(texts, [key[3] or 0 for key in keys], owner[novel], place[novel], length, width)
            for i, node, core in zip(found[0].tolist(), found[1].tolist(), found[2].view(np.int64).tolist()):
                nodes[i].append({"node": node, "core": core})
        rows = [i for i in range(len(texts)) if spans[i] or fresh[i]]
        return pa.RecordBatch.from_arrays([
            *[pa.array([keys[i][k] for i in rows], pa.int64()) for k in range(3)], pa.array([keys[i][3] for i in rows], pa.int32()),
            stretches(spans, rows), stretches(fresh, rows), pa.array([nodes[i] for i in rows], named),
            pa.array([texts[i] if fresh[i] else None for i in rows], pa.binary()),
        ], ["anchor", "part", "run", "back", "windows", "fresh", "nodes", "bytes"])

    def work(batches):
        keys, texts, windows = [], [], 0
        for batch in batches:
            for anchor, part, run, back, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                # anchors may share a comparison, as equal windows have equal anchors; one part of an anchor stays whole
                if windows > _WINDOWS and keys and (anchor, part) != keys[-1][:2]:
                    yield flush(keys, texts)
                    keys, texts, windows = [], [], 0
                keys.append((anchor, part, run, back))
                texts.append(text)
                windows += len(text) - length + 1
        if keys:
            yield flush(keys, texts)

    return work


_PAIRS = "array<struct<a:int,b:int>>"
_COMPARED = f"anchor long, part long, run long, back int, windows {_PAIRS}, fresh {_PAIRS}, nodes array<struct<node:int,core:long>>, bytes binary"


def _named_windows(length: int, width: int):
    """Over ``(anchor, run, back, fresh, bytes, open)``: a row for each fresh window of an open node, named by its halves."""
    half = length // 2

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                anchors, runs, places, leading, second = [], [], [], [], []
                for anchor, run, back, fresh, raw, nodes in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns]):
                    place = np.concatenate([np.arange(one["a"], one["b"] + 1) for one in fresh])
                    place = place[np.isin((place - back) // width, nodes)]
                    prefix = prefix_names(np.frombuffer(raw, np.uint8))
                    anchors.append(np.full(len(place), anchor, np.int64))
                    runs.append(np.full(len(place), run, np.int64))
                    places.append(place.astype(np.int32))
                    leading.append(span_names(prefix, place, place + half).view(np.int64))
                    second.append(span_names(prefix, place + half, place + length).view(np.int64))
                columns = [pa.array(np.concatenate(c)) for c in (anchors, runs, places, leading, second)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "run", "a", "leading", "second"])

    return work


def _across_parts(compared: DataFrame, length: int, width: int) -> DataFrame:
    """``anchor, run, a, b``: windows that are new to their part and occur in another part of the anchor too."""
    cut = compared.where("bytes is not null")
    nodes = cut.select("anchor", "part", "run", F.explode("nodes").alias("n")).select("anchor", "part", "run", "n.node", "n.core")
    met = nodes.groupBy("anchor", "core").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("anchor", "core")
    open_ones = nodes.join(materialize(met), ["anchor", "core"]).groupBy("anchor", "run").agg(F.collect_list("node").alias("open"))
    rows = cut.select("anchor", "run", "back", "fresh", "bytes").join(open_ones, ["anchor", "run"])
    named = materialize(rows.select("anchor", "run", "back", "fresh", "bytes", "open").mapInArrow(
        released(_named_windows(length, width)), "anchor long, run long, a int, leading long, second long"
    ))
    # a part gives each of its windows once, so a count is one of parts
    name = ["anchor", "leading", "second"]
    again = named.groupBy(*name).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*name)
    return named.join(again, name).select("anchor", "run", "a", F.col("a").alias("b"))


def repeated_spans(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``row, spans``: for each text with repeated strings, its spans (start, end) to remove, sorted and not touching."""
    every = materialize(find_runs(docs, length, anchor))
    # most anchors occur once; their runs need no further look
    live = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor")
    runs = materialize(join_unique(every, live, ["anchor"], "left_semi"))
    counted = materialize(runs.groupBy("anchor", "run").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "more", "back")).alias("copy")
    ))
    several = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    several = several.withColumn("parts", F.ceil(F.col("runs") / PART_RUNS))
    asked = join_unique(counted, several, ["anchor"]).select(
        "copy.row", F.struct(
            "anchor", "run", F.pmod(F.xxhash64("run"), F.col("parts")).alias("part"), "copy.first", "copy.more", "copy.back", (F.col("parts") > 1).alias("cut"),
        ).alias("one"),
    ).groupBy("row").agg(F.collect_list("one").alias("asked"))
    # the same columns as in the last join, so that texts are shuffled once for both
    texts = docs.select("row", "doc_id", "text").join(asked, "row")
    fetched = texts.select("text", "asked", "row", "doc_id").mapInArrow(
        released(_fetch(length, min(LEAD, anchor))), "anchor long, run long, part long, back int, bytes binary, lead binary"
    )
    order = ["lead", "anchor", "part"]
    bucketed = fetched.repartitionByRange(*order).sortWithinPartitions(*order, "run").select("anchor", "part", "run", "back", "bytes")
    largest = several.agg(F.max("parts")).first()[0] or 1
    width = _node_width(length, anchor)
    compared = bucketed.mapInArrow(released(_compare(length, width)), _COMPARED)
    if largest > 1:
        compared = materialize(compared)
    windows = compared.select("anchor", "run", F.explode("windows").alias("w")).select("anchor", "run", "w.a", "w.b")
    if largest > 1:
        windows = windows.unionByName(_across_parts(compared, length, width))
    whole = counted.where("times > 1").select("anchor", "run", F.lit(0).alias("a"), F.col("copy.more").alias("b"))
    found = runs.join(windows.unionByName(whole), ["anchor", "run"]).select(
        "row", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + length).alias("end")
    )
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut(batches):
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        columns = [[], [], [], [], []]
        for text, found in zip(texts, spans):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            merged = []
            for one in found.as_py() or []:
                if merged and one["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], one["end"])
                else:
                    merged.append([one["start"], one["end"]])
            digest, at, removed, parts = hashlib.sha256(), 0, 0, []
            for start, end in merged:
                parts.append(bytes(raw[at:start]))
                removed += end - start
                at = end
            parts.append(bytes(raw[at:]))
            kept = b"".join(parts)
            digest.update(kept)
            for column, value in zip(columns, (len(raw), removed, len(merged), digest.hexdigest(), kept)):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``; a row is named by its place in its file, the same however a later scan is split."""
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("row"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Texts are UTF-8 bytes, a null text is empty; ``kept`` is what is left, as bytes, since a span may cut a character.
    Strings are judged on the input and never cross texts; a string that repeats within one text counts, overlaps
    included. Repeated rows are texts of their own and so remove each other from ``length`` bytes on; a doc_id may be
    null. Other columns are ignored, an empty table gives an empty result. ``docs`` is read more than once: pass a stored
    table, or rows of one. What is no Parquet table is stored first.
    """
    try:
        numbered = _numbered(docs)
    except AnalysisException:  # its rows have no place in a file
        numbered = _numbered(materialize(docs.select("doc_id", "text")))
    spans = repeated_spans(numbered, length, anchor)
    joined = numbered.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(released(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
