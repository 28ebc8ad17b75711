"""Merkle manifest of a table: a tree of digests per source, one over the sources, and a proof for every row.

Leaves are digests of whole rows. Sixteen consecutive nodes become one, per source and then over the
sources in order, until one root is left. A row's proof are the digests beside its path; whoever holds the
row, the proof and the root can tell whether the row was changed.

Proofs are found by pointer jumping. Every inner node starts with a pointer to its parent and the segment of
siblings that lie on that step. Each round joins the nodes with themselves: a node takes over the pointer of the
node it points at and appends that node's segment to its own, so the distance covered doubles, and after
a number of rounds that grows with the logarithm of the height every pointer has reached the root. Leaves
take part as runs of sixteen, which share all but their first step.

No step holds more than one run, a path, or a slice of sorted rows. The tables that rounds look
up shrink sixteenfold with each level passed; they are broadcast only below ``BROADCAST_NODES``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from exposura.llm.ordering import SLICE_ROWS, with_place
from exposura.session import materialize

# Children of a node.
FANOUT = 16
# A table of nodes of at most this many rows is broadcast; one row is a path, up to some ten levels of 1 KB.
BROADCAST_NODES = 2_000
# The tree over the sources; trees of sources are numbered from 0.
TOP = -1

_STEP = "array<struct<before:string,after:string>>"


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of a row in hex: each value as its number of UTF-8 bytes, ``:`` and itself; a null as ``-``."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def _parent(level: DataFrame) -> DataFrame:
    """Runs of a level ``(tree, pos, n, digest, …)``: the members in order and the digest over theirs."""
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in level.columns if c not in ("tree", "pos", "n")])))
    runs = level.groupBy("tree", F.floor(F.col("pos") / FANOUT).cast("long").alias("run")).agg(
        F.first("n").alias("n"), members.alias("members")
    )
    joined = F.array_join(F.transform("members", lambda m: m["digest"]), "")
    return runs.withColumn("digest", F.when(F.col("n") > 1, F.sha2(joined, 256)).otherwise(joined))


def _beside(members: Column, pos: Column) -> Column:
    """The digests of a run before and after the member at ``pos``."""
    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(members, keep), lambda m: m["digest"]), "")

    return F.struct(
        side(lambda m: m["pos"] < pos).alias("before"), side(lambda m: m["pos"] > pos).alias("after")
    )


def _climb(level: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Inner steps of trees from ``level`` (tree, pos, n, digest) at ``height`` up, and the ends ``(tree, height, digest)``.

    Steps are ``(tree, height, pos, up, segment)``: ``up`` is the parent's place at the next height.
    """
    steps, ends = [], [level.where("n = 1").select("tree", F.lit(height).alias("height"), "digest")]
    level = level.where("n > 1")
    while not level.isEmpty():
        runs = materialize(_parent(level))
        steps.append(
            runs.select("tree", "run", "members", F.explode("members.pos").alias("pos")).select(
                "tree", F.lit(height).alias("height"), "pos", F.col("run").alias("up"),
                F.array(_beside(F.col("members"), F.col("pos"))).cast(_STEP).alias("segment"),
            )
        )
        height += 1
        above = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), "digest")
        ends.append(above.where("n = 1").select("tree", F.lit(height).alias("height"), "digest"))
        level = above.where("n > 1")
    return steps, reduce(DataFrame.unionByName, ends)


def _lookup(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def _jump(nodes: DataFrame) -> DataFrame:
    """Paths to the root for ``nodes(tree, height, pos, up_tree, up_height, up, segment, subroot)``; a null ``up`` is the root.

    In round r only nodes at least 2**(r-1) steps above another are looked up. A looked-up node has at most
    16**(2**(r-1)) nodes that point at it, which are many only when there are so few such nodes that they are broadcast.
    """
    nodes, reach = materialize(nodes), 1
    while not nodes.where("up is not null").isEmpty():
        above = nodes.where((F.col("tree") == TOP) | (F.col("height") > reach)).select(
            F.col("tree").alias("up_tree"), F.col("height").alias("up_height"), F.col("pos").alias("up"),
            F.col("up_tree").alias("next_tree"), F.col("up_height").alias("next_height"), F.col("up").alias("next"),
            F.col("segment").alias("further"), F.col("subroot").alias("further_subroot"),
        )
        going = nodes.where("up is not null").join(_lookup(above), ["up_tree", "up_height", "up"]).select(
            "tree", "height", "pos", F.col("next_tree").alias("up_tree"), F.col("next_height").alias("up_height"),
            F.col("next").alias("up"), F.concat("segment", "further").alias("segment"),
            F.coalesce("subroot", "further_subroot").alias("subroot"),
        )
        nodes, reach = materialize(nodes.where("up is null").unionByName(going)), reach * 2
    return nodes


def fold(leaf: Column, segment: Column) -> Column:
    """The root that a leaf and its path lead to: at each step the digest over the siblings with the node in its place."""
    return F.aggregate(segment, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_text(segment: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(segment, lambda step: F.concat(step["before"], step["after"])), "")


def proofs(leaves: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row of ``leaves(source, doc_id, leaf, …)`` with ``subroot``, ``root`` and ``segment``, its path to the root.

    Leaves of a source ascend by doc_id, nulls first, then by leaf; rows equal in all of that are told apart by their
    place in the stored table. Sources ascend bytewise, null first. An empty table gives no rows. ``segment`` is an array
    of steps ``(before, after)``, the siblings on both sides. Further columns are kept.
    """
    kept = [c for c in leaves.columns if c not in ("source", "leaf")]
    stored = materialize(leaves)
    sizes = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    trees = materialize(with_place(sizes, [], "source", [], "tree", slice_rows))
    placed = with_place(stored, ["source"], "doc_id", ["leaf"], "pos", slice_rows)
    numbered = placed.join(
        trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).select("tree", "pos", "n", F.col("leaf").alias("digest"), F.struct(*kept).alias("kept"))
    runs = materialize(_parent(numbered))

    # inner nodes of the sources: the ends of their trees are the leaves of the tree over the sources
    first = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), "digest")
    steps, ends = _climb(first, 1)
    ends = materialize(ends)
    top = ends.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).alias("n"), "digest")
    top_steps, top_ends = _climb(top, 0)
    last = materialize(top_ends).first()
    root = F.lit(last["digest"] if last else None).cast("string")

    inner = [s.select(
        "tree", "height", "pos", F.col("tree").alias("up_tree"), (F.col("height") + 1).alias("up_height"), "up", "segment",
        F.lit(None).cast("string").alias("subroot"),
    ) for s in [*steps, *top_steps]]
    # the end of a source's tree is the same node as its leaf of the top tree: a step without siblings
    joints = ends.select(
        "tree", "height", F.lit(0).cast("long").alias("pos"), F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).alias("up_height"),
        F.col("tree").alias("up"), F.array().cast(_STEP).alias("segment"), F.col("digest").alias("subroot"),
    )
    crown = F.lit(None)
    head = [] if last is None else [ends.sparkSession.range(1).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(last["height"]).alias("height"),
        F.lit(0).cast("long").alias("pos"), crown.cast("long").alias("up_tree"),
        crown.cast("int").alias("up_height"), crown.cast("long").alias("up"), F.array().cast(_STEP).alias("segment"),
        crown.cast("string").alias("subroot"),
    )]
    paths = _jump(reduce(DataFrame.unionByName, [*inner, joints, *head])).where(f"tree != {TOP} and height = 1").select(
        "tree", F.col("pos").alias("run"), "subroot", F.col("segment").alias("further")
    )
    return runs.join(paths, ["tree", "run"]).select(
        "n", "members", "subroot", "further", F.explode("members").alias("own")
    ).select(
        F.col("own.kept.*"), F.col("own.digest").alias("leaf"), "subroot", root.alias("root"),
        F.when(F.col("n") > 1, F.concat(F.array(_beside(F.col("members"), F.col("own.pos"))).cast(_STEP), "further"))
        .otherwise(F.col("further")).alias("segment"),
    )


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, tampered: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Digests and proofs of a document table, and whether each row still belongs to the root.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (of the original rows), and folded_root and verified,
    which take the row as it is where ``tampered`` is true: its text with A-Z lower-cased. A null condition counts
    as false. Nulls in any column are told apart from empty values; repeated rows each have a place of their own.
    """
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = row_digest([text if c == "text" else F.col(c) for c in FIELDS])
    found = F.when(F.lit(False) if tampered is None else tampered, changed)
    leaves = docs.select("doc_id", "source", row_digest([F.col(c) for c in FIELDS]).alias("leaf"), found.alias("found"))
    proven = proofs(leaves, slice_rows)
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("segment")), 256).alias("proof_sha256"),
        fold(F.coalesce("found", "leaf"), F.col("segment")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
