"""Repair of the structure of conversations, solved on an automaton that all conversations share from their ends.

A conversation is a sequence of rows with a role and a text, by turn. A row's signature letter tells
its role's initial (s, u, a or another) and its first fault (none, blank, duplicate, truncated). The cheapest repair
of the rest of a conversation hangs only on that rest and on the state of the grammar ``(s?(ua)+)?``: so
the suffixes of all signatures are the nodes of one automaton, every node is solved once for each of
the four states (cost to go, best next edit, and with it the best audit suffix), and a conversation
reads its audit off the path from its own node to the end.

The automaton is built from sorted input. Signatures are range-partitioned by their reverse and sorted; neighbours
then share the longest possible suffix, and a task keeps only the path of the current one, a few bytes for each
letter. What two tasks share is solved in both. Conversations of equal signature are not one key: the conversation's
own id continues the sort.

Nothing collects the rows of a conversation. Rows are put in order by a range partition that cuts long
conversations, letters are gathered in pieces of at most ``PIECE`` rows, and texts stream past the audit in order. A
digest over a whole conversation has to be made in order, so that stream is one task for each conversation, with
the memory of a batch and one letter for each of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from exposura.llm.ordering import SLICE_ROWS, with_place
from exposura.llm.text_kernel import released
from exposura.session import materialize

WHITE = " \t\n\x0b\f\r"
# Rows of one piece of a signature.
PIECE = 4096
# Characters of role, text and signature that decide where ranges are cut; sorting goes by more.
KEY_CHARS = 32

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
# States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
# Letters: A-D without fault, E-H blank, I-L duplicate, M-P truncated; in each of them s, u, a, another role.
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
_DELETED = "x"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, dropped)`` damaged by ``crc32(conv_id:turn) % 20``.

    0 drops the row (it stays, marked), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets the role user. Null
    roles and texts, and null ids and turns in the hashed text, count as one space.
    """
    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))),
    ).drop("col")


def in_order(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows(conv_id, turn, role, text, dropped)``, stored, with ``place``, a number that ascends along every conversation.

    Rows go by turn, nulls first; rows of one turn by the first characters of role and text, then by ``name``, the
    digest of both. Cuts lie anywhere, so a long conversation, or a turn with many rows, is in many slices.
    """
    name = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.withColumns({
        "name": F.unhex(name), "_role": F.left("role", F.lit(KEY_CHARS)), "_text": F.left("text", F.lit(KEY_CHARS)),
        "_row": F.monotonically_increasing_id(),
    })
    order = ["conv_id", "turn", "_role", "_text", "name", "_row"]
    parts = max(1, -(-rows.count() // slice_rows))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_role", "_text", "_row")
    return materialize(placed.withColumn("place", F.monotonically_increasing_id()))


def signatures(ordered: DataFrame) -> DataFrame:
    """``(conv_id, gaps, letters)`` for every conversation of ``in_order``; letters are empty where all rows were dropped."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    rows = ordered.select(
        "conv_id", "turn", "place", "dropped", F.when(~F.col("dropped"), F.col("name")).alias("name"),
        initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )
    seen = with_place(rows, ["conv_id", "name"], "place", [], "earlier")
    fault = F.when(F.col("blank"), 1).when(F.col("earlier") > 0, 2).when(F.col("truncated"), 3).otherwise(0)
    letter = F.when(F.col("dropped"), "").otherwise(F.char(F.lit(64) + 4 * fault + F.col("initial")))
    turn = F.when(~F.col("dropped"), F.col("turn"))
    pieces = seen.select("conv_id", "place", letter.alias("letter"), turn.alias("turn")).groupBy(
        "conv_id", F.floor(F.col("place") / PIECE).alias("piece")
    ).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda r: r["letter"]), "").alias("letters"),
        F.size(F.collect_set("turn")).alias("turns"), F.min("turn").alias("least"), F.max("turn").alias("most"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "letters", "turns", "least", "most"))).alias("pieces"))
    counted = whole.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["letters"]), "").alias("letters"),
        F.filter("pieces", lambda p: p["turns"] > 0).alias("p"),
    )
    # turns ascend, so two pieces share at most the turn at their border
    shared = F.zip_with(
        F.expr("slice(p, 1, greatest(size(p) - 1, 0))"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))"),
        lambda a, b: F.when(a["most"] == b["least"], 1).otherwise(0),
    )
    distinct = F.aggregate("p", F.lit(0), lambda n, p: n + p["turns"]) - F.aggregate(shared, F.lit(0), lambda n, s: n + s)
    span = F.array_max(F.transform("p", lambda p: p["most"])) - F.array_min(F.transform("p", lambda p: p["least"])) + 1
    return counted.select("conv_id", F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"), "letters")


def _after(state: int) -> int:
    """The state behind an inserted or changed row: users and assistants take turns."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: int) -> int | None:
    """The state behind a row that keeps its role, or None where the grammar forbids it."""
    if initial == 0:
        return SYSTEM if state == START else None
    return _after(state) if initial == _after(state) - 1 else None


# Behind the last row: what is missing is inserted.
_END = ((0, 2 * INSERT_COST, INSERT_COST, 0), ("", INSERT, INSERT, ""))


@lru_cache(maxsize=4096)
def _solve(letter: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs to go and best edits of a node, by state, from its letter and the costs of the node behind it.

    Among equally cheap edits the least letter wins; what follows it is the least itself, so whole audits are least.
    """
    best = []
    for state in range(4):
        choices = [(DELETE_COST + rest[state], DELETE)]
        if letter != _DELETED:
            fault, initial = divmod(ord(letter) - 65, 4)
            extra = TRUNCATED_COST if fault == 3 else 0
            kept = _kept(state, initial)
            if kept is not None:
                choices.append((extra + rest[kept], KEEP))
            choices.append((extra + REROLE_COST + rest[_after(state)], REROLE))
        best.append(min(choices))
    out = []
    for state in range(4):  # one insertion is enough before a row that is edited here, since two lead back
        onward = best[_after(state)][0]
        if state == START or state == SYSTEM:
            onward = min(onward, INSERT_COST + best[ASSISTANT][0])
        out.append(min(best[state], (INSERT_COST + onward, INSERT)))
    return tuple(c for c, _ in out), tuple(e for _, e in out)


class _Path:
    """Solved nodes along one signature, from its end; a neighbour in reverse order reuses what it shares."""

    def __init__(self) -> None:
        self.letters = ""
        self.base = [0]  # costs to go are kept as a least cost and what each state has beyond it: few different tuples
        self.nodes = [_END]

    def follow(self, letters: str) -> int:
        """Make ``letters``, a reversed signature, the current path; returns the number of nodes that were new."""
        old, shared, most = self.letters, 0, min(len(self.letters), len(letters))
        step = 1 << max(0, most.bit_length())
        while step:  # longest common beginning by halving
            if shared + step <= most and old[shared:shared + step] == letters[shared:shared + step]:
                shared += step
            step >>= 1
        del self.nodes[shared + 1:], self.base[shared + 1:]
        for letter in letters[shared:]:
            costs, edits = _solve(letter, self.nodes[-1][0])
            least = min(costs)
            self.base.append(self.base[-1] + least)
            self.nodes.append((tuple(c - least for c in costs), edits))
        self.letters = letters
        return len(letters) - shared

    def audit(self) -> tuple[int, str]:
        """Cost and edits of the current signature."""
        out, state, depth = [], START, len(self.letters)
        cost = self.base[depth] + self.nodes[depth][0][START]
        while edit := self.nodes[depth][1][state]:
            out.append(edit)
            if edit == KEEP:
                state = _kept(state, (ord(self.letters[depth - 1]) - 65) % 4)
            elif edit != DELETE:
                state = _after(state)
            depth -= edit != INSERT
        return cost, "".join(out)


_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, new_nodes long"
_INITIAL_OF = str.maketrans({chr(65 + 4 * f + i): "suao"[i] for f in range(4) for i in range(4)})


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, last, found = _Path(), None, None
    for batch in batches:
        columns = {c: [] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "new_nodes")}
        for letters, back in zip(batch.column("letters").to_pylist(), batch.column("back").to_pylist()):
            new = path.follow(back)
            if new or back != last:
                last, found = back, path.audit()
            counts = [sum(letters.count(chr(65 + 4 * f + i)) for i in range(4)) for f in (1, 2, 3)]
            roles = letters.translate(_INITIAL_OF)
            legal = roles.count("su") + roles.count("ua") + roles.count("au")
            for name, value in zip(columns, (*counts, max(0, len(roles) - 1) - legal, *found, new)):
                columns[name].append(value)
        arrays = [batch.column("conv_id"), batch.column("gaps")]
        arrays += [pa.array(v, pa.string() if name == "audit" else pa.int64()) for name, v in columns.items()]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "gaps", *columns])


def plan_repairs(signed: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Counts of faults, cost and audit of every row of ``signed(conv_id, gaps, letters)``.

    ``new_nodes`` is the number of nodes of the shared automaton that this row was the first in its task to need.
    """
    deleted = "".join(chr(65 + 4 * f + i) for f in (1, 2) for i in range(4))
    signed = materialize(signed)
    keyed = signed.withColumn("back", F.reverse(F.translate("letters", deleted, _DELETED * len(deleted))))
    parts = max(1, -(-signed.count() // slice_rows))
    cut = keyed.withColumn("_cut", F.left("back", F.lit(KEY_CHARS))).repartitionByRange(parts, "_cut", "conv_id").drop("_cut")
    return cut.sortWithinPartitions("back", "conv_id").mapInArrow(released(_plan), _PLAN)


class _Edits:
    """One conversation's audit, applied to its rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _turn(self) -> str:
        self.state = _after(self.state)
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith(INSERT, self.at):
            self.at += 1
            yield self._turn(), "", INSERT

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = _kept(self.state, INITIALS.index(role[0]))
            yield role, text, KEEP
        elif edit == REROLE:
            yield self._turn(), text, REROLE


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(head, pieces)`` for each conversation: its planned row, and an iterator over its repaired rows, to be used up."""
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    rows = ((place, role, text, batch, i) for batch in batches for i, (place, role, text) in enumerate(zip(
        batch.column("place").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())))
    row = next(rows, None)
    while row is not None:
        head = {name: row[3].column(name)[row[4]].as_py() for name in names}

        def repaired(edits=_Edits(head["audit"])):
            nonlocal row
            while (row := next(rows, None)) is not None and row[0] >= 0:
                yield from edits.row(row[1], row[2])
            yield from edits.inserted()

        pieces = repaired()
        yield head, pieces
        for _ in pieces:  # whatever the caller left
            pass


_DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "conv_id long, seq long, role string, text string, edit string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, pieces in _conversations(batches):
        digest, first = hashlib.sha256(), True
        for role, text, _ in pieces:
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        out.append({**head, "repaired_sha256": digest.hexdigest()})
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _DIGEST_TYPES)
            out = []
    yield pa.RecordBatch.from_pylist(out, _DIGEST_TYPES)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for head, pieces in _conversations(batches):
        for seq, (role, text, edit) in enumerate(pieces):
            out.append({"conv_id": head["conv_id"], "seq": seq, "role": role, "text": text, "edit": edit})
            size += len(text) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, _ROW_TYPES)
                out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, _ROW_TYPES)


def _types(schema: str) -> pa.Schema:
    return pa.schema([(part.split()[0], pa.int64() if part.split()[1] == "long" else pa.string()) for part in schema.split(",")])


_DIGEST_TYPES, _ROW_TYPES = _types(_DIGESTS), _types(_ROWS)


def _stream(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Each conversation's plan and then its rows in order, conversations spread by their id."""
    ordered = in_order(rows.select("conv_id", "turn", "role", "text", "dropped"), slice_rows)
    plans = plan_repairs(signatures(ordered), slice_rows).drop("new_nodes")
    both = plans.withColumn("place", F.lit(-1).cast("long")).unionByName(
        ordered.where(~F.col("dropped")).select("conv_id", "place", "role", "text"), allowMissingColumns=True
    )
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _undamaged(conversations: DataFrame) -> DataFrame:
    if "dropped" in conversations.columns:
        return conversations
    return conversations.withColumns({
        "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" ")), "dropped": F.lit(False)
    })


def repair_conversations(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The repaired rows ``(conv_id, seq, role, text, edit)`` of ``conversations(conv_id, turn, role, text)``.

    Edits: K kept, R with the role user or assistant instead, I inserted with an empty text; deleted rows are gone.
    Blank rows and rows whose role and text came earlier in the conversation are always deleted; a row that does not end in
    ``.!?`` costs extra unless deleted. Null roles and texts count as one space; rows without a conv_id are one
    conversation. An empty table gives no rows; columns beyond the four are not carried.
    """
    return _stream(_undamaged(conversations), slice_rows).mapInArrow(released(_repaired), _ROWS)


def audit_conversations(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per conversation: gaps between turns, counts of faults, cost and audit of the repair, digest of its result.

    Takes what ``repair_conversations`` takes, or rows of ``damage``, where a conversation may have lost all its rows:
    it gets zeros, an empty audit and the digest of nothing.
    """
    return _stream(_undamaged(conversations), slice_rows).mapInArrow(released(_digests), _DIGESTS)
