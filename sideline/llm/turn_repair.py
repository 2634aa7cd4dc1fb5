"""Conversation structure repair as a secondary-sorted stream (operator 12).

Rows are dealt by conversation and sorted by turn; then two streams carry a small state across Arrow batches. The first reads
a conversation from its end and gives each row a *backpointer* of two bytes: for each of the four states of the grammar
``(s?(ua)+)?`` the cheapest edit of this row and the inserts before it, given the least cost of the rest. The second reads
from the start, follows the backpointers and hashes the repaired text as it goes. Between them the rows, with their
backpointers, go through Spark's own sort, which spills; no row of a conversation is held in a worker, so a conversation of
any length takes one edit letter a row (the audit it returns). All of this is one shuffle.

Each row's first fault counts: blank (no character but separators), duplicate (role and text seen earlier in the
conversation), truncated (its last such character is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 2, Delete 3
(required for blank and duplicate rows), Insert an empty user or assistant row 2; a truncated row that stays costs 1 more.
The cheapest edits win, ties go to the audit (initials of the edits in order) that is least in ASCII: reading forward, the
least letter that still reaches the least cost. A role is judged by its initial; one other than s, u and a can only be reroled
or deleted.

Null roles and texts are one space. Turns are sorted with nulls first; rows of one turn by role, text and copy. A null
conversation is one of its own. Repeated rows are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # state: the role before
# Role that the grammar asks for after a state; a system row may also open a conversation.
WANTED = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
INF = 1 << 40
VISIBLE = r"[^\x20\x09-\x0D]"
SEPARATORS = " \t\n\x0b\x0c\r"
# Conversation and turn travel as text: pandas would turn integers with nulls among them into floats.
STREAM = "conv string, turn string, role string, text string, fault int, gone boolean, tie string, nth int"
REPAIRED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
AT_END = tuple(0 if s in ENDS else 2 * INSERT if s == SYSTEM else INSERT for s in range(4))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with ``gone``: by a checksum of conversation and turn, one row in 20 each is dropped (kept
    as a row that is ``gone``), emptied, stripped of full stops, repeated, or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``nth`` (how often role and text have occurred up to here) and ``fault``. Conversations lie whole in one partition."""
    placed = rows.withColumn("tie", F.sha2("text", 256)).repartition("conv")
    same = Window.partitionBy("conv", "gone", "role", "tie").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim(F.col("text"), F.lit(SEPARATORS)), -1, 1)
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return placed.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


def _least(goal: tuple[int, ...], state: int, role: int, fault: int) -> tuple[int, int, int]:
    """(cost, inserts, letter) of the best edits from a state through one row, the least letters first among equals."""
    best = None
    for inserts in range(3):
        spent = inserts * INSERT
        here = state
        for _ in range(inserts):
            here = WANTED[here]
        stays = LEFT_TRUNCATED if fault == TRUNCATED else 0
        ways = [(0, DELETE + goal[here])]
        if fault in (NONE, TRUNCATED):
            if role == WANTED[here] or (role == SYSTEM and here == START):
                ways.append((2, stays + goal[role]))
            ways.append((3, REROLE + stays + goal[WANTED[here]]))
        for letter, cost in ways:
            # Letters in order: D before I before K before R; an insert comes before the row's own letter.
            key = (spent + cost, "I" * inserts + LETTERS[letter])
            if best is None or key < best[0]:
                best = (key, inserts, letter)
    return best[0][0], best[1], best[2]


def _plan(goal: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end from before a row, and the row's backpointer: four bits a state, inserts and letter."""
    costs, pointer = [], 0
    for state in range(4):
        cost, inserts, letter = _least(goal, state, role, fault)
        costs.append(cost)
        pointer |= (inserts << 2 | letter) << 4 * state
    return tuple(costs), pointer


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``pointer`` to rows sorted by conversation and descending turn."""
    conv, goal, memo = None, AT_END, {}
    for batch in batches:
        pointers = []
        for c, role, fault, gone in zip(*(batch[x].tolist() for x in ("conv", "role", "fault", "gone")), strict=True):
            if conv is None or conv[0] != c:
                conv, goal = (c,), AT_END
            if gone:
                pointers.append(0)
                continue
            low = min(goal)  # states differ by little, so few tables recur
            key = (tuple(g - low for g in goal), ROLES.get(role[:1], START), fault)
            if key not in memo:
                memo[key] = _plan(*key)
            costs, pointer = memo[key]
            goal = tuple(g + low for g in costs)
            pointers.append(pointer)
        yield batch.assign(pointer=pd.Series(pointers, dtype="int32", index=batch.index))


class _Repair:
    """State of one conversation on its way forward."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, START, 0
        self.counts = [0, 0, 0, 0]
        self.letters: list[str] = []
        self.sha, self.empty = hashlib.sha256(), True
        self.illegal, self.before = 0, None
        self.low = self.high = None
        self.turns = 0

    def emit(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        self.state = WANTED[self.state]
        self.cost += INSERT
        self.letters.append("I")
        self.emit(NAMES[self.state], "")

    def row(self, turn, role: str, text: str, fault: int, pointer: int) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.counts[fault] += 1
        bits = pointer >> 4 * self.state & 15
        for _ in range(bits >> 2):
            self.insert()
        letter = LETTERS[bits & 3]
        self.letters.append(letter)
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if letter == "R" else 0) + (LEFT_TRUNCATED if fault == TRUNCATED else 0)
        self.state = WANTED[self.state] if letter == "R" else ROLES[initial]
        self.emit(NAMES[self.state] if letter == "R" else role, text)

    def close(self) -> tuple:
        while self.state not in ENDS:
            self.insert()
        gaps = min(self.high - self.low + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest())


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from rows sorted by conversation and turn, with their backpointers."""
    names = [c.split(" ")[0] for c in REPAIRED.split(", ")]
    now, done = None, []
    for batch in batches:
        columns = (batch[x].tolist() for x in ("conv", "turn", "role", "text", "fault", "gone", "pointer"))
        for c, turn, role, text, fault, gone, pointer in zip(*columns, strict=True):
            if now is None or now.conv != c:
                if now is not None:
                    done.append(now.close())
                now = _Repair(c)
            if not gone:
                now.row(None if turn is None else int(turn), role, text, fault, pointer)
        yield pd.DataFrame(done, columns=names)
        done = []
    if now is not None:
        yield pd.DataFrame([now.close()], columns=names)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation (columns of ``REPAIRED``, conv as long) from rows (conv, turn, role, text, gone); ``gone`` rows only
    name their conversation."""
    ready = faults(rows)
    names = [c.split(" ")[0] for c in STREAM.split(", ")]
    order = [F.col("turn").cast("long"), F.col("role"), F.col("tie"), F.col("nth")]
    down = ready.withColumns({c: F.col(c).cast("string") for c in ("conv", "turn")}).sortWithinPartitions("conv", *(c.desc_nulls_last() for c in order))
    pointed = down.select(*names).mapInPandas(_backward, f"{STREAM}, pointer int")
    up = pointed.sortWithinPartitions("conv", *(c.asc_nulls_first() for c in order))
    out = up.select("conv", "turn", "role", "text", "fault", "gone", "pointer").mapInPandas(_forward, REPAIRED)
    return out.withColumn("conv", F.col("conv").cast("long"))


def conversation_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The given columns as (conv, turn, role, text), null roles and texts as one space."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
