"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over sorted rows.

A conversation's roles should read ``(s?(ua)+)?`` by their initials: perhaps one system turn, then user and assistant in
turn, or nothing. Edits of a row: Keep (free), Rerole to user or assistant (1), Delete (2); an empty user or assistant
turn can be Inserted anywhere (5). Blank rows and repeats of an earlier row (same role and text) must be deleted; a
truncated row (its last character that is no white space is none of ``.!?``) that is not deleted adds 5. Of several
cheapest ways the one whose edits' initials come first in ASCII is taken. The roles that result follow from those
initials, so it is one way.

How it runs. Rows are dealt by conversation and sorted by turn, once; a task streams them through ``mapInPandas`` and
holds, across Arrow batches, four states (what the output ends in: nothing, system, user, assistant). A state has its
cost, its place in the order of the states' edit strings, and a running SHA-256 of its repaired text, so no text is
kept. Of what led to each state one byte is kept for a row, four for all states; beyond ``SPILL`` bytes these go to a
file of the task, and are read back from its end, in blocks, when the conversation is over. A state's string ends with
an edit of the last row, so none is the beginning of another, and their order settles every later tie between them.

Repeats are found before: by the 128-bit hash of conversation, role and text, the first turn of each combines before its
shuffle, and only marks of later rows join the stream, ahead of the rows of their turn. So memory grows with neither
the rows nor the distinct texts of a conversation; a giant one is one task's stream, in constant memory but for its marks of one
turn.

Nulls: null roles and texts are one space, null turns come first; a null conv_id is a conversation. Rows of one turn are
in the order of role, then text; of equal ones the first is no repeat. A role counts by its first character. Empty
table: no rows. Texts of any length are read whole, once. A conversation whose rows are all marked ``dropped`` has
zeros, an empty audit and the hash of nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and what a truncated row adds that stays.
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Bytes of backpointers that a task holds for a conversation; more go to a file. Bytes that are read back at once.
SPILL, BLOCK = 16 << 20, 1 << 20

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 62
_WHITE = " \t\n\v\f\r"
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_EDITS = "DKR"

_RESULT = "conv_id long, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserted(state: int, n: int) -> list[int]:
    """States that ``n`` inserted turns lead through; which role an inserted turn has follows from the state."""
    out = []
    for _ in range(n):
        state = _ASSISTANT if state == _USER else _USER
        out.append(state)
    return out


def _after(state: int, initial: str) -> int | None:
    """The state after a turn of this role, or None if it may not stand there."""
    if initial == "s":
        return _SYSTEM if state == _START else None
    if initial == "u":
        return _USER if state != _USER else None
    return _ASSISTANT if initial == "a" and state == _USER else None


def _moves(initial: str, gone: bool, truncated: bool) -> list[tuple[int, int, int, int, int]]:
    """Ways over a row: (state before, inserted turns, edit, state after, cost). More than two inserted turns go round."""
    out = []
    for state in range(4):
        for n in range(3):
            at, cost = (_inserted(state, n) or [state])[-1], INSERT * n
            out.append((state, n, 0, at, cost + DELETE))
            if gone:
                continue
            more = TRUNCATED if truncated else 0
            if (kept := _after(at, initial)) is not None:
                out.append((state, n, 1, kept, cost + more))
            out.append((state, n, 2, _ASSISTANT if at == _USER else _USER, cost + REROLE + more))
    return out


def _letters(n: int, edit: int) -> str:
    return "I" * n + _EDITS[edit]


class _Steps:
    """Transitions of all four states over a row, remembered: they depend on the row's kind and on the states' relative
    costs and order only, of which there are few."""

    def __init__(self) -> None:
        self.moves: dict[tuple, list] = {}
        self.known: dict[tuple, tuple] = {}

    def step(self, kind: tuple[str, bool, bool], costs: tuple[int, ...], order: tuple[int, ...]) -> tuple:
        """costs: above the least, -1 if out of reach; order: of the states' strings. Returns what the least rises by, the
        new costs and order, and for each state (state before, inserted turns, edit) or None."""
        key = (kind, costs, order)
        if key not in self.known:
            if kind not in self.moves:
                self.moves[kind] = _moves(*kind)
            best: list[tuple | None] = [None] * 4
            for before, n, edit, to, cost in self.moves[kind]:
                if costs[before] >= 0:
                    way = (costs[before] + cost, order[before], _letters(n, edit), before, n, edit)
                    best[to] = way if best[to] is None else min(best[to], way)
            there = [w for w in best if w is not None]
            least = min(w[0] for w in there)
            rank = {w: k for k, w in enumerate(sorted(there, key=lambda w: w[1:]))}
            new = tuple(-1 if w is None else w[0] - least for w in best), tuple(0 if w is None else rank[w] for w in best)
            self.known[key] = (least, *new, tuple(None if w is None else w[3:] for w in best))
        return self.known[key]


class _Backpointers:
    """Four bytes for each row, in memory up to ``spill`` bytes, then in a file."""

    def __init__(self, spill: int):
        self.spill, self.held, self.file = spill, bytearray(), None

    def add(self, ways: tuple) -> None:
        self.held += bytes(255 if w is None else w[0] | w[1] << 2 | w[2] << 4 for w in ways)
        if len(self.held) >= self.spill:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held.clear()

    def audit(self, state: int, inserted: int) -> str:
        """The edits that end in a state, with turns inserted after the last row."""
        out = ["I" * inserted]
        for block in self._blocks():
            for k in range(len(block) - 4, -1, -4):
                way = block[k + state]
                out.append(_letters(way >> 2 & 3, way >> 4)[::-1])
                state = way & 3
            out = ["".join(out)]
        return out[0][::-1] if out else ""

    def _blocks(self) -> Iterator[bytes]:
        yield bytes(self.held)
        if self.file is not None:
            end = self.file.tell()
            while end:
                start = max(0, end - BLOCK // 4 * 4)
                self.file.seek(start)
                yield self.file.read(end - start)
                end = start
            self.file.close()


class Conversation:
    """What is carried of one conversation while its rows stream by."""

    def __init__(self, steps: _Steps, spill: int = SPILL):
        self.steps, self.pointers = steps, _Backpointers(spill)
        self.costs, self.order, self.cost = (0, -1, -1, -1), (0, 0, 0, 0), 0
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.row: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        """The next row by turn; ``repeated``: whether a row before has its role and text."""
        if turn is not None:
            self.turns += turn != self.last or self.first is None
            self.first, self.last = turn if self.first is None else self.first, turn
        # Equal rows of one turn stand side by side.
        repeated, self.row = repeated or self.row == (turn, role, text), (turn, role, text)
        bare = text.rstrip(_WHITE)
        blank = not bare
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and bare[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        rise, self.costs, self.order, ways = self.steps.step((initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated), self.costs, self.order)
        self.cost += rise
        self.pointers.add(ways)
        self._hash(ways, role, text)

    def _hash(self, ways: tuple, role: str, text: str) -> None:
        old, body = self.hashes, None
        self.hashes = [None] * 4
        for to, way in enumerate(ways):
            if way is None:
                continue
            state, n, edit = way
            if not n and not edit:
                self.hashes[to] = old[state]  # nothing is written; whoever writes copies first
                continue
            hashed, state = self._with(old[state], state, n)
            if edit:
                body = text.encode() if body is None else body
                hashed.update(("" if state == _START else "\n").encode() + (role if edit == 1 else _ROLE[to]).encode() + b":")
                hashed.update(body)
            self.hashes[to] = hashed

    @staticmethod
    def _with(hashed, state: int, n: int):
        """A copy of the hash with ``n`` inserted turns, and the state after them."""
        hashed = hashed.copy()
        for to in _inserted(state, n):
            hashed.update((("" if state == _START else "\n") + _ROLE[to] + ":").encode())
            state = to
        return hashed, state

    def result(self) -> tuple:
        ends = []
        for state in range(4):
            for n in range(3):
                if self.costs[state] >= 0 and (_inserted(state, n) or [state])[-1] in (_START, _ASSISTANT):
                    ends.append((self.costs[state] + INSERT * n, self.order[state], n, state))
        rise, _, n, state = min(ends)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        audit = self.pointers.audit(state, n)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + rise, audit, self._with(self.hashes[state], state, n)[0].hexdigest()


def _repaired(batches: Iterator[pd.DataFrame], spill: int) -> Iterator[pd.DataFrame]:
    """Rows by conversation and turn, marks ahead of the rows of their turn; a row for each conversation."""
    names = [f.split(" ")[0] for f in _RESULT.split(", ")]
    steps, key, talk = _Steps(), None, None
    marked: set[tuple[int, int]] = set()
    marks_of: tuple | None = None
    for batch in batches:
        done = []
        columns = [batch[c].tolist() for c in ("known", "conv_id", "has_turn", "at", "kind", "role", "text", "h1", "h2")]
        for known, conv_id, has_turn, at, kind, role, text, h1, h2 in zip(*columns, strict=True):
            if key != (known, conv_id):
                if key is not None:
                    done.append((key[1] if key[0] else None, key[0], *talk.result()))
                key, talk, marks_of = (known, conv_id), Conversation(steps, spill), None
            if marks_of != at:
                marked, marks_of = set(), at
            if kind == 0:
                marked.add((h1, h2))
            elif kind == 1:
                talk.add(at if has_turn else None, role, text, (h1, h2) in marked)
        if done:
            yield _frame(done, names)
    if key is not None:
        yield _frame([(key[1] if key[0] else None, key[0], *talk.result())], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["conv_id"] = pd.array([r[0] for r in rows], dtype="Int64")
    return out


def repair(turns: DataFrame, dropped: str | None = None, spill: int = SPILL) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text): ``conv_id``, ``gaps`` (whole turn numbers that
    are missing between the first and the last), ``blank``, ``duplicate``, ``truncated`` (rows by their first fault),
    ``illegal`` (neighbours whose roles may not follow each other), ``cost``, ``audit`` (initials of the edits in order)
    and ``repaired_sha256`` (of ``role:text`` of the repaired turns, joined by line feeds).

    ``dropped``: a boolean column; its rows only tell that their conversation exists.
    """
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    # No nulls, which pandas would turn into floats: null ids and turns are told by flags.
    rows = turns.select(conv.isNotNull().alias("known"), F.coalesce(conv, F.lit(0)).alias("conv_id"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(-(1 << 63))).alias("at"), F.when(gone, 2).otherwise(1).alias("kind"), space("role").alias("role"), space("text").alias("text"))
    h = lambda seed: F.xxhash64(F.lit(seed), "known", "conv_id", "role", "text")
    rows = rows.withColumns({"h1": h(1), "h2": h(2)})
    return _streamed(rows, _marks(rows), spill)


def _marks(rows: DataFrame) -> DataFrame:
    """A mark for each turn at which a role and text stand that stood at an earlier turn."""
    key = ["known", "conv_id", "h1", "h2"]
    slim = rows.where("kind = 1").select(*key, "has_turn", "at")
    place = F.struct("has_turn", "at")
    first = slim.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    return slim.join(first, key).where(place > F.col("first")).select(*key, "has_turn", "at")


def _streamed(rows: DataFrame, marks: DataFrame, spill: int) -> DataFrame:
    marks = marks.select("known", "conv_id", "has_turn", "at", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "h1", "h2")
    stream = rows.unionByName(marks).repartition("known", "conv_id").sortWithinPartitions("known", "conv_id", "has_turn", "at", "kind", "role", "text")
    return stream.mapInPandas(lambda batches: _repaired(batches, spill), _RESULT).drop("known")


#: What is done to a row, by the remainder of its checksum.
DROPPED, EMPTIED, UNPOINTED, REPEATED, REROLED, OF = 0, 1, 2, 3, 4, 20


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with damage by CRC-32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 marks a row as ``dropped``,
    1 empties its text, 2 takes out ``.!?``, 3 repeats the row at its turn, 4 sets its role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate: Column = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % OF
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == EMPTIED, "").when(F.col("fate") == UNPOINTED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == REPEATED, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == REROLED, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == DROPPED).alias("dropped"), copies.alias("copy")).drop("copy")
