"""Repair of conversation structure by a Viterbi decoder that emits edits as soon as its survivors coalesce.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Cheapest edits are found over four
states: nothing kept, after the system turn, after a user turn, after an assistant turn. Each state keeps one survivor,
the cheapest way there and of equals the one whose edits read first in ASCII. Survivors share a tree of backpointers
whose nodes count their children and survivors; a node that loses both goes, and as long as the root has one child and
no survivor of its own, that child's edit is final and leaves. So memory holds what is still open, not the conversation.

Equal costs are settled by the whole open edits, yet in constant time: at one place in the rows, two survivors' edits
either differ before the last row's letter, which gives each a rank, or only in inserts after it, kept as a tail.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadspark.llm.arrow import small

SPACE = " \t\n\x0b\f\r"
FAULTS = [None, "blank", "duplicate", "truncated"]
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs; keeping is free
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
# where a kept, reroled or inserted turn of this initial leads
NEXT = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# EXTRA[s][t]: what it costs at most to follow from t any continuation of s; a survivor dearer than another by more cannot win
EXTRA = {BEGIN: {ASSISTANT: 3, USER: 5}, SYSTEM: {ASSISTANT: 0, USER: 2, BEGIN: 0}, USER: {ASSISTANT: 2, SYSTEM: 2, BEGIN: 2}, ASSISTANT: {USER: 2, BEGIN: 0}}

BATCH_ROWS, BATCH_CHARS = 2048, 4 << 20

EDITS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("cost", T.LongType()),
    T.StructField("turn", T.LongType()), T.StructField("fault", T.StringType()), T.StructField("old_role", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


# --- rows ---------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The damaged rows and how many times each stands (``times``: 0, 1 or 2), by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 doubles it, 4 makes it a user's. Nulls are one space.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def judge(rows: DataFrame, times: str = "times") -> DataFrame:
    """Every row's own fault, rows of a conversation together and in order: by turn, nulls first, then role and text.

    One exchange, by conversation. Whether role and text were seen earlier is a row number over a sort within it, which
    spills; rows that do not stand (``times`` 0) stay as marks of their conversation.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text", F.col("times") == 0).orderBy(F.asc_nulls_first("turn")))
    fault = F.when(end == "", 1).when(F.col("seen") > 1, 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    together = rows.select("conv_id", "turn", "role", "text", F.col(times).alias("times")).repartition("conv_id")
    ordered = together.withColumn("seen", seen).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    return ordered.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))


# --- decoder ------------------------------------------------------------------------------------

class Node:
    """An edit in the tree of backpointers; ``heads`` counts the survivors that end here."""

    __slots__ = ("parent", "children", "heads", "edit")

    def __init__(self, parent: Node | None, edit: tuple | None):
        self.parent, self.children, self.heads, self.edit = parent, [], 0, edit
        if parent is not None:
            parent.children.append(self)


class Decoder:
    """Cheapest edits of one conversation, row by row. ``push`` and ``finish`` return the edits that became final."""

    def __init__(self):
        self.root = Node(None, None)
        self.root.heads = 1
        # state: (cost, rank, tail, node)
        self.alive = {BEGIN: (0, 0, "", self.root)}
        self._insert()

    def _release(self, node: Node) -> None:
        node.heads -= 1
        while node.heads == 0 and not node.children and node is not self.root:
            node.parent.children.remove(node)
            node = node.parent

    def _insert(self) -> None:
        """Let inserts lead to states more cheaply, or equally and earlier in ASCII."""
        alive = self.alive
        for source, target in ((BEGIN, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if source in alive:
                cost, rank, tail, node = alive[source]
                cost, tail = cost + INSERT, tail + "I"
                old = alive.get(target)
                if old is None or (cost, rank, tail) < old[:3]:
                    new = Node(node, ("I", INSERT, None, ROLE[target]))
                    new.heads = 1
                    alive[target] = (cost, rank, tail, new)
                    if old is not None:
                        self._release(old[3])

    def push(self, row: tuple) -> list[tuple]:
        """``row`` is (turn, role, text, fault)."""
        role, fault = row[1], row[3]
        best: dict[int, tuple] = {}

        def offer(target: int, state: int, letter: str, cost: int, new_role: str | None) -> None:
            total, rank, tail, _ = self.alive[state]
            found = (total + cost, rank, tail + letter, state, letter, cost, new_role)
            if target not in best or found[:3] < best[target][:3]:
                best[target] = found

        extra = TRUNCATED if fault == 3 else 0
        for state in self.alive:
            offer(state, state, "D", DELETE, None)
            if fault != 1 and fault != 2:
                target = NEXT.get(role[:1], {}).get(state)
                if target is not None:
                    offer(target, state, "K", extra, role)
                target = ASSISTANT if state == USER else USER
                offer(target, state, "R", REROLE + extra, ROLE[target])
        ranks = {key: k for k, key in enumerate(sorted({b[1:3] for b in best.values()}))}
        old, self.alive = self.alive, {}
        for target, (total, rank, text, state, letter, cost, new_role) in best.items():
            node = Node(old[state][3], (letter, cost, row, new_role))
            node.heads = 1
            self.alive[target] = (total, ranks[rank, text], "", node)
        for _, _, _, node in old.values():
            self._release(node)
        self._insert()
        for state in list(self.alive):
            if any(t in self.alive and self.alive[t][0] + more < self.alive[state][0] for t, more in EXTRA[state].items()):
                self._release(self.alive.pop(state)[3])
        return self._final()

    def _final(self) -> list[tuple]:
        out = []
        while self.root.heads == 0 and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out.append(self.root.edit)
        return out

    def finish(self) -> list[tuple]:
        ends = [s for s in (BEGIN, ASSISTANT) if s in self.alive]
        winner = min(ends, key=lambda s: self.alive[s][:3])
        for state in list(self.alive):
            if state != winner:
                self._release(self.alive.pop(state)[3])
        self.alive[winner][3].heads = 0
        return self._final()


def repair(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """Every conversation's edits in order (``EDITS``), one row each: K(eep), R(erole), D(elete), I(nsert).

    ``conversations`` holds conv_id, turn, role and text; other columns are ignored, but that ``times``, where given,
    names the column that says how often a row stands, as ``damage`` gives. ``cost`` is the edit's. Deleted rows have a null ``role`` and
    keep their text; inserted ones have a null turn, fault and old role and an empty text. A conversation without
    rows gives one row with a null edit. A null conv_id is a conversation of its own. Null roles and texts count as one
    space, an empty role has no initial and so cannot be kept. Rows of equal turn stand by role and text. Rows of
    the result lie by conversation and in order within their partition; an empty table gives an empty one.

    A conversation passes through one task as a sorted stream, whatever its length; memory holds its open edits.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(1) if times is None else F.col(times).cast("int")).alias("times"),
    )
    names = [f.name for f in EDITS]
    types = to_arrow_schema(EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        current, decoder, place = None, None, 0

        def add(edits: list[tuple]) -> None:
            nonlocal place, held
            for letter, cost, row, role in edits:
                turn, old, text, fault = row if row is not None else (None, None, "", 0)
                out.append((current[0], place, letter, cost, turn, FAULTS[fault], old, role, text))
                place, held = place + 1, held + len(text)

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out), types)]
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close() -> None:
            if current is not None:
                add(decoder.finish())
                if place == 0:
                    out.append((current[0], 0, None, 0, None, None, None, None, None))

        for batch in small(batches):
            for conv, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    close()
                    current, decoder, place = (conv,), Decoder(), 0
                for k in range(times):
                    # the second of two equal neighbours has been seen
                    add(decoder.push((turn, role, text, 2 if k and fault != 1 else fault)))
                if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield flush()
        close()
        if out:
            yield flush()

    return judge(rows).mapInArrow(run, EDITS)


def audits(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair`` as they lie: counts, cost, the edits' letters, and the
    SHA-256 of the repaired ``role:text`` joined by line ends. Streams; only the letters grow with a conversation."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current = None
        counts: dict = {}

        def close() -> None:
            if current is not None:
                turns = counts["turns"]
                gaps = counts["last"] - counts["first"] + 1 - turns if turns else 0
                done.append((current[0], gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], counts["cost"], letters.getvalue(), digest.hexdigest()))

        for batch in small(batches):
            for conv, edit, cost, turn, fault, old, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    close()
                    current, letters, digest, before, empty = (conv,), io.StringIO(), hashlib.sha256(), None, True
                    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "first": None, "last": None}
                if edit is None:
                    continue
                letters.write(edit)
                counts["cost"] += cost
                if edit != "I":
                    if fault is not None:
                        counts[fault] += 1
                    if before is not None and before + old[:1] not in legal:
                        counts["illegal"] += 1
                    before = old[:1]
                    if turn is not None and turn != counts["last"]:
                        counts["turns"] += 1
                        counts["first"], counts["last"] = turn if counts["first"] is None else counts["first"], turn
                if edit != "D":
                    digest.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode())
                    empty = False
            if len(done) >= BATCH_ROWS:
                yield batch_of(done)
        close()
        if done:
            yield batch_of(done)

    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=types.names)

    return edits.select("conv_id", "edit", "cost", "turn", "fault", "old_role", "role", "text").mapInArrow(run, schema)
