"""Repair of the structure of conversations: the cheapest edits, by a Viterbi search whose survivors coalesce."""

from __future__ import annotations

import hashlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.shared import parts, stored

#: What the repaired roles so far end in: nothing, a leading system row, a user's, an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits; a truncated row that stays costs one more.
RENAME, DELETE, INSERT = 2, 3, 2
#: By how much an end in the first state can at most be completed worse than the same in the second: where the
#: second costs more than that above the first, no cheapest repair goes through it.
BEHIND = {(ASSISTANT, EMPTY): 3, (USER, EMPTY): 5, (SYSTEM, EMPTY): 4, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 2, (ASSISTANT, USER): 2, (USER, ASSISTANT): 2}
#: What an end still needs, by state.
CLOSING = [(), ("user", "assistant"), ("assistant",), ()]
_SPACE = " \t\n\x0b\x0c\r"
_SENT = 10_000


def _moves():
    """What can be done with a row, by its role's initial and whether it is truncated: (state before, state after, letters, cost, number
    in the list of edits); and the edits: letter, role inserted before it, role given."""
    edits, moves = [("D", None, None)], {}
    for initial in ("s", "u", "a", ""):
        for truncated in (False, True):
            found = [(p, p, "D", DELETE, 0) for p in range(4)]
            if initial == "s":
                edits.append(("K", None, None))
                found.append((EMPTY, SYSTEM, "K", int(truncated), len(edits) - 1))
            for p in range(4):
                for after, role in ((USER, "user"), (ASSISTANT, "assistant")):
                    # A role that cannot follow needs one row between; more than that never pays.
                    missing = ("assistant" if after == USER else "user") if (p == USER) == (after == USER) else None
                    keeps = initial == role[0]
                    edits.append(("K" if keeps else "R", missing, None if keeps else role))
                    cost = (0 if keeps else RENAME) + (INSERT if missing else 0) + int(truncated)
                    found.append((p, after, ("I" if missing else "") + edits[-1][0], cost, len(edits) - 1))
            moves[initial, truncated] = found
    return moves, edits


MOVES, EDITS = _moves()
DELETIONS = [(p, p, "D", DELETE, 0) for p in range(4)]


class Survivors:
    """For each state the cheapest edits that end in it, as paths in a tree of back pointers.

    Equally cheap paths into a state are compared by all their letters from where they part. Ends after the same rows all end in the letter
    of the last row, so none is the beginning of another, and what one compares stays so for all that follows: each end keeps its place in
    that order, which stands for its whole unresolved suffix. A node counts its children and the survivors that end there; one
    nobody counts is freed, and as long as the root has one child alone, that child's edit is certain and leaves.
    """

    def __init__(self):
        self.parent, self.counts, self.kids, self.edit = array("q", [-1]), array("q", [1]), array("q", [0]), array("h", [0])
        self.free, self.root, self.rows = [], 0, deque()
        self.ends = {EMPTY: (0, 0, 0)}  # state: cost, place in the order, node

    def _node(self, parent: int, edit: int) -> int:
        if self.free:
            node = self.free.pop()
            self.parent[node], self.counts[node], self.kids[node], self.edit[node] = parent, 1, 0, edit
        else:
            node = len(self.parent)
            for column, value in ((self.parent, parent), (self.counts, 1), (self.kids, 0), (self.edit, edit)):
                column.append(value)
        self.counts[parent] += 1
        self.kids[parent] += node + 1  # the sum of the children: with one child, that child
        return node

    def _drop(self, node: int) -> None:
        while not self.counts[node] and node != self.root:
            self.free.append(node)
            parent = self.parent[node]
            self.counts[parent] -= 1
            self.kids[parent] -= node + 1
            node = parent

    def step(self, row, moves, copies: int = 1) -> Iterator[tuple]:
        """Take a row and, beyond the first, copies of it that must go; yields (row, edit) of all that became certain."""
        best, ends = {}, self.ends
        for before, after, letters, cost, edit in moves:
            if before in ends:
                total, place, node = ends[before]
                found = (total + cost, place, letters, node, edit)
                if after not in best or found < best[after]:
                    best[after] = found
        cheap = {s: f for s, f in best.items() if not any(
            (o, s) in BEHIND and best[o][0] + BEHIND[o, s] < f[0] for o in best)}
        least = min(f[0] for f in cheap.values())
        order = sorted(cheap, key=lambda s: cheap[s][1:3])
        # Costs count from the least: deleting further copies costs every end the same.
        self.ends = {s: (cheap[s][0] - least, place, self._node(cheap[s][3], cheap[s][4])) for place, s in enumerate(order)}
        for _, _, node in ends.values():
            self.counts[node] -= 1
            self._drop(node)
        self.rows.append((row, copies))
        while self.counts[self.root] == 1 and self.kids[self.root]:
            child = self.kids[self.root] - 1
            self.free.append(self.root)
            self.root = child
            self.parent[child] = -1
            yield *self.rows.popleft(), EDITS[self.edit[child]]

    def close(self) -> tuple[list[tuple], tuple]:
        """What is still open, and the roles to add at the end."""
        state = min(self.ends, key=lambda s: (self.ends[s][0] + INSERT * len(CLOSING[s]), self.ends[s][1]))
        path, node = [], self.ends[state][2]
        while node != self.root:
            path.append(EDITS[self.edit[node]])
            node = self.parent[node]
        return [(*row, edit) for row, edit in zip(self.rows, reversed(path), strict=True)], CLOSING[state]


def _decide(stream: DataFrame) -> DataFrame:
    """One row per different row of a turn: its edit, the role to insert before it, its new role and its fault; and, with
    ``kind`` 2, what is inserted at a conversation's end."""
    names = ["conv", "turn", "digest", "kind", "edit", "inserted", "given", "fault"]

    def search(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, key, survivors, marked, seen, facts = [], None, None, None, False, 0, None

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return done

        def settled(rows):
            for (turn, digest, fault), _, (edit, inserted, given) in rows:
                out.append((conv, turn, digest, 0, edit, [inserted] if inserted else [], given, fault))

        def end_run():
            if not seen:
                return
            initial, blank, truncated = facts
            fault = "blank" if blank else "duplicate" if marked else "truncated" if truncated else None
            moves = DELETIONS if blank or marked else MOVES[initial if initial in ("s", "u", "a") else "", truncated]
            settled(survivors.step((*key, fault), moves, seen))

        def end_conversation():
            end_run()
            if survivors is not None and key is not None:
                rows, closing = survivors.close()
                settled(rows)
                if closing:
                    out.append((conv, *key, 2, "I", list(closing), None, None))

        for rows in got:
            kinds = [rows.schema.field("conv").type, rows.schema.field("turn").type, pa.binary(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            for now, turn, digest, kind, initial, blank, truncated in zip(*(rows.column(c).to_pylist() for c in (
                    "conv", "turn", "digest", "kind", "initial", "blank", "truncated")), strict=True):
                if survivors is None or now != conv:
                    end_conversation()
                    conv, key, survivors, marked, seen = now, None, Survivors(), False, 0
                if key != (turn, digest):
                    end_run()
                    key, marked, seen = (turn, digest), False, 0
                if kind:
                    seen, facts = seen + 1, (initial, blank, truncated)
                else:
                    marked = True
                if len(out) >= _SENT:
                    yield batch()
        end_conversation()
        if out:
            yield batch()

    fields = stream.schema
    schema = T.StructType([fields["conv"], fields["turn"], T.StructField("digest", T.BinaryType()), T.StructField("kind", T.IntegerType()),
                           T.StructField("edit", T.StringType()), T.StructField("inserted", T.ArrayType(T.StringType())),
                           T.StructField("given", T.StringType()), T.StructField("fault", T.StringType())])
    return stream.mapInArrow(search, schema)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows), "conv").sortWithinPartitions("conv", "turn", "digest", "kind")


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits that turn every conversation's roles into an optional system row and then pairs of user and assistant, or
    into nothing, as one row per edit: ``conv``, ``place`` (from 0), ``edit``, ``turn`` and ``was`` (the row's own turn and role; null for
    an insertion), ``fault``, ``role`` and ``text`` (after the edit; the role is null for a deletion).

    Edits are K (keep, free), R (role to user or assistant), D (delete) and I (insert a row with an empty text, anywhere). Blank rows and duplicates (the
    same role and text stood before in the conversation) must go; a truncated row, whose last character but for white space is none of
    ``.!?``, costs one if it stays. The first of these faults is the row's. A role counts by its first letter. Of equally cheap repairs that
    whose letters come first in ASCII order is taken.

    Rows are taken by turn, null first, and those of one turn by a digest of role and text. Null roles and texts count as one space.
    Rows with a null conversation are one conversation. A repeated row is a duplicate unless it is blank. Other columns
    take no part, whatever their names. An empty table gives an empty one.

    The search sees a few bytes per row, in order, in one task for a conversation, since an edit depends on all before it; it holds only rows whose edit is
    not certain yet. Where equal texts stand is found by an aggregate over all conversations, not within a task. Texts are exchanged once, to
    meet their edits; the rows of a conversation lie in one partition of the result, in order.
    """
    base = rows.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    trimmed = F.rtrim("text", F.lit(_SPACE))
    base = base.withColumn("digest", digest)
    narrow = base.select("conv", "turn", "digest", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"),
                         (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.lit(1).alias("kind"))

    at = F.struct("turn")
    repeated = narrow.where("not blank").groupBy("conv", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    repeated = stored(repeated.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first"), "repeated-rows")
    again = narrow.join(repeated, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).where(at > F.col("first"))
    marks = again.select("conv", "turn", "digest").distinct().withColumn("kind", F.lit(0))
    decided = _decide(_in_order(narrow.unionByName(marks, allowMissingColumns=True)))

    both = base.withColumn("kind", F.lit(1)).unionByName(decided, allowMissingColumns=True)
    return _apply(_in_order(both))


def _apply(stream: DataFrame) -> DataFrame:
    """Edits beside the rows that follow them."""
    fields = stream.schema
    schema = T.StructType([fields["conv"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), fields["turn"],
                           T.StructField("was", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])

    def apply(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, decision, out, size = object(), 0, None, [], 0
        for rows in got:
            kinds = [rows.schema.field("conv").type, pa.int64(), pa.string(), rows.schema.field("turn").type, *[pa.string()] * 4]
            columns = [rows.column(c).to_pylist() for c in ("conv", "turn", "kind", "role", "text", "edit", "inserted", "given", "fault")]
            for now, turn, kind, role, text, edit, inserted, given, fault in zip(*columns, strict=True):
                if now != conv:
                    conv, place = now, 0
                if kind != 1:
                    for added in inserted:
                        out.append((conv, place, "I", None, None, None, added, ""))
                        place += 1
                    decision = (edit, given, fault)
                    continue
                edit, given, fault = decision
                out.append((conv, place, edit, turn, role, fault, None if edit == "D" else given or role, text))
                place += 1
                size += len(text)
                # Further rows of the same turn that are equal are duplicates of this one.
                decision = ("D", None, "blank" if fault == "blank" else "duplicate")
                if len(out) >= _SENT or size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return stream.mapInArrow(apply, schema)


def summaries(edits: DataFrame) -> DataFrame:
    """One row per conversation from the result of ``repair`` as it comes: ``gaps`` between the turns it had, its ``blank``, ``duplicate`` and
    ``truncated`` rows, ``illegal`` neighbours (roles that must not follow each other), the ``cost``, the letters of all edits (``audit``), and the SHA-256
    of the repaired rows, ``role:text`` by line. Only these letters and a few numbers are held of a conversation."""
    schema = T.StructType([edits.schema["conv"], *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType())])
    costs = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}

    def fold(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []

        def end():
            gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["turns"]
            out.append((conv, min(gaps, (1 << 63) - 1), *state["faults"].values(), state["illegal"], state["cost"], state["audit"].decode(), state["sha"].hexdigest()))

        for rows in got:
            kinds = [rows.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = [rows.column(c).to_pylist() for c in ("conv", "edit", "turn", "was", "fault", "role")]
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            for now, edit, turn, was, fault, role, text in zip(*columns, texts, strict=True):
                if state is None or now != conv:
                    if state is not None:
                        end()
                    conv, state = now, {"least": None, "most": None, "turns": 0, "last": None, "faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0),
                                        "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "any": False}
                state["audit"] += edit.encode()
                state["cost"] += costs[edit] + (fault == "truncated" and edit != "D")
                if fault:
                    state["faults"][fault] += 1
                if edit != "I":
                    if state["last"] is not None and state["last"] + was[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["last"] = was[:1]
                    if turn is not None:
                        state["turns"] += turn != state["most"]
                        state["least"], state["most"] = turn if state["least"] is None else state["least"], turn
                if role is not None:
                    state["sha"].update((b"\n" if state["any"] else b"") + role.encode() + b":" + text)
                    state["any"] = True
            if len(out) >= _SENT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out = []
        if state is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return edits.mapInArrow(fold, schema)


def damaged(rows: DataFrame, fate: Column, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults put into conversations, for trials: rows whose ``fate`` is 0 go, 1 lose their text, 2 their ``.!?``, 3 stand twice,
    4 become the user's. Null roles and texts become one space."""
    given, said = F.coalesce(F.col(f"`{role}`"), F.lit(" ")), F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    said = F.when(fate == 1, "").when(fate == 2, F.translate(said, ".!?", "")).otherwise(said)
    return rows.where(fate != 0).select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.when(fate == 4, "user").otherwise(given).alias("role"), said.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)))).drop("col")
