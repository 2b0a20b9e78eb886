"""Repair of the role structure of conversations by a Viterbi search whose survivors coalesce.

The roles of a repaired conversation are an optional system turn and pairs of a user's and an assistant's turn, or nothing. Rows of a
conversation come in order and are read once. The search keeps, for each state of that grammar, the cheapest edits so far, as
a path in a tree of backpointers. Nodes count who refers to them; a path that is given up frees its nodes, and as soon as all survivors
share an ancestor, the edits up to it are final, are given out and forgotten. So memory holds the edits on which the survivors differ,
not the conversation.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of leaving a truncated row in.
COSTS, TRUNCATED = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in the states of ENDS.
_MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLE_AFTER = (None, None, "user", "assistant")
ENDS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"
_FINE, _CUT, _DEAD = "fine", "truncated", "must go"


def _new_turn(state: int) -> int:
    """The state after a user's or an assistant's turn: in every state only one of them can follow."""
    return _MOVES[state]["a" if state == 2 else "u"]


def _order(x: str, y: str) -> int | str:
    """How x stands to y: "<", ">", or how many inserts y has more when one continues the other (negative when x has more)."""
    if x.startswith(y) or y.startswith(x):
        return len(y) - len(x)
    return "<" if x < y else ">"


def _compare(orders: dict, a: tuple, b: tuple) -> int | str:
    """How the complete suffix of candidate a stands to that of b: a candidate is (state, cost, survivor, letters after the survivor's).

    Edits that continue other edits over the same rows are inserts alone, so such a pair never has the same costs, and any other pair
    differs at a place that later edits leave as it is.
    """
    known = 0 if a[2] == b[2] else orders[a[2], b[2]]
    if isinstance(known, str):
        return known
    return _order(INSERT * -known + a[3], INSERT * known + b[3])


def _chosen(orders: dict, candidates: list[tuple]) -> tuple[tuple, tuple]:
    """The best candidate of each state that can still be part of a cheapest repair, and the orders of their suffixes, in pairs."""
    best: dict[int, tuple] = {}
    for c in candidates:
        other = best.get(c[0])
        if other is None or c[1] < other[1] or (c[1] == other[1] and _compare(orders, c, other) == "<"):
            best[c[0]] = c
    # After an assistant's turn all can follow that can follow in any other state, but a kept system turn, which deleting replaces.
    cost = {s: c[1] for s, c in best.items()}
    paired = min(cost.get(3, cost[2] + COSTS[INSERT]), cost[2] + COSTS[INSERT]) if 2 in cost else cost.get(3)
    if paired is not None:
        if 0 in cost and cost[0] > paired + COSTS[DELETE]:
            del best[0]
        if 1 in cost and cost[1] > paired:
            del best[1]
    kept = tuple(best[s] for s in sorted(best))
    return kept, tuple(((a[0], b[0]), _compare(orders, a, b)) for a in kept for b in kept if a[0] != b[0])


def _inserted(candidates: list[tuple]) -> list[tuple]:
    """The candidates, each also with one or two inserts after it; more would lead back to a state that is had for less."""
    out = list(candidates)
    for state, cost, survivor, letters in candidates:
        for _ in range(2):
            state, cost, letters = _new_turn(state), cost + COSTS[INSERT], letters + INSERT
            out.append((state, cost, survivor, letters))
    return out


@functools.lru_cache(maxsize=None)
def _step(front: tuple, orders: tuple, initial: str, fault: str) -> tuple[tuple, tuple]:
    """One row more. front has (state, cost above the cheapest) of the survivors; the result is that of ``_chosen``.

    A step depends on differences of costs and on orders alone, of which there are few, so that nearly all steps are looked up.
    """
    out = []
    for state, cost in front:
        out.append((state, cost + COSTS[DELETE], state, DELETE))
        if fault != _DEAD:
            left = cost + (TRUNCATED if fault == _CUT else 0)
            out.append((_new_turn(state), left + COSTS[REROLE], state, REROLE))
            if initial in _MOVES[state]:
                out.append((_MOVES[state][initial], left + COSTS[KEEP], state, KEEP))
    return _chosen(dict(orders), _inserted(out))


class _Node:
    """Some edits of a path after its parent's: refs counts the children and the survivor that refer to the node."""

    __slots__ = ("parent", "letters", "children", "refs")

    def __init__(self, parent: _Node | None, letters: str):
        self.parent, self.letters, self.children, self.refs = parent, letters, [], 0
        if parent is not None:
            parent.children.append(self)
            parent.refs += 1


class Repair:
    """The search over one conversation. ``give(edit, role, text)`` is called for each edit as soon as it is final, in order."""

    def __init__(self, give: Callable[[str, str | None, str | None], None]):
        self.give, self.rows, self.state, self.cost = give, deque(), 0, 0
        self.root = _Node(None, "")
        self.nodes = {0: self.root}
        self.root.refs = 1
        self._advance(*_chosen({}, _inserted([(0, 0, 0, "")])))

    def _advance(self, kept: tuple, orders: tuple) -> None:
        old, low = self.nodes, min(c[1] for c in kept)
        self.nodes = {state: _Node(old[survivor], letters) for state, _, survivor, letters in kept}
        for node in self.nodes.values():
            node.refs += 1
        for node in old.values():  # no longer survivors: what nobody refers to is freed, up to what somebody does
            node.refs -= 1
            while node.refs == 0 and node.parent is not None:
                node.parent.children.remove(node)
                node.parent.refs -= 1
                node = node.parent
        self.cost += low
        self.front, self.orders = tuple((c[0], c[1] - low) for c in kept), orders
        while self.root.refs == 1 and self.root.children:
            self._settle(self.root.children[0])

    def _settle(self, node: _Node) -> None:
        """Give out the edits of a child of the root and make it the root."""
        for letter in node.letters:
            role, text = (None, "") if letter == INSERT else self.rows.popleft()
            if letter == KEEP:
                self.state = _MOVES[self.state][role[:1]]
            elif letter != DELETE:
                self.state = _new_turn(self.state)
                role = _ROLE_AFTER[self.state]
            self.give(letter, *((None, None) if letter == DELETE else (role, text)))
        node.parent = None
        self.root = node

    def row(self, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text))
        initial = role[:1]
        self._advance(*_step(self.front, self.orders, initial if initial in ("s", "u", "a") else "", fault))

    def end(self) -> int:
        """Give out the rest and return the cost of all edits."""
        costs, orders = dict(self.front), dict(self.orders)
        ends = [s for s in ENDS if s in costs]
        last = ends[0] if len(ends) < 2 or (costs[0], orders[0, 3] != "<") < (costs[3], orders[0, 3] == "<") else ends[1]
        path, node = [], self.nodes[last]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._settle(node)
        return self.cost + costs[last]


class _Summary:
    """Counts, edits and digest of a conversation; ``held`` is the largest number of rows that waited for a decision."""

    def __init__(self, key: str):
        self.key, self.letters, self.sha = key, [], hashlib.sha256()
        self.first = self.low = self.high = self.last_turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.held = 0
        self.repair = Repair(self._give)

    def _give(self, edit: str, role: str | None, text: str | None) -> None:
        self.letters.append(edit)
        if edit != DELETE:
            self.sha.update(f"{'' if self.first is None else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.last_turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        fault = fault_of(text, seen)
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.repair.row(role, text, _CUT if fault == "truncated" else _FINE if fault is None else _DEAD)
        self.held = max(self.held, len(self.repair.rows))

    def end(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.letters), self.sha.hexdigest(), self.held


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate, truncated, or None."""
    end = text.rstrip(_SPACE)[-1:]
    return "blank" if not end else "duplicate" if seen else "truncated" if end not in ".!?" else None


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows by conversation and turn, each with whether its role and text are in an earlier row; one shuffle serves both sorts."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    absent = F.col("absent") if "absent" in turns.columns else F.lit(False)
    rows = turns.select(
        key.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(absent, F.lit(False)).alias("absent")
    )
    earlier = Window.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    met = rows.repartition("conv").withColumn("seen", F.row_number().over(earlier) > 1)
    return met.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "seen")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        turn = [None if missing else int(t) for t, missing in zip(pdf["turn"], pdf["turn"].isna(), strict=True)]
        yield from zip(pdf["conv"], turn, pdf["role"], pdf["text"], pdf["seen"], pdf["absent"], strict=True)


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, held``.

    turns has conv_id, turn, role, text and optionally absent: a row that is absent only names its conversation. Rows are taken by turn,
    nulls first, then by role and text; a null role or text counts as one space. The first fault of a row counts: blank (no
    character but white space), duplicate (role and text of an earlier row), truncated (the last such character is none of ".!?").
    audit has the initials of the cheapest edits, of equal costs the least in ASCII. A conversation without rows has zeros, no edits and the
    digest of nothing; a null conv_id is a conversation of its own; an empty table gives no rows; repeated rows are duplicates.
    A role that is empty or starts with none of s, u, a cannot be kept. Texts are read whole; other columns are ignored.

    A conversation is read by one task, in order and in parts, as a digest of its text can be made in no other way; sorts spill.
    Held in memory are its audit and the rows not yet decided (``held`` at most), which are few unless roles leave two repairs equally good to the end.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done = None, []
        for conv, turn, role, text, seen, absent in _rows(batches):
            if at is None or at.key != conv:
                if at is not None:
                    done.append(at.end())
                at = _Summary(conv)
                if len(done) >= 1000:
                    yield pd.DataFrame(done, columns=names)
                    done = []
            if not absent:
                at.row(turn, role, text, bool(seen))
        yield pd.DataFrame(done + ([at.end()] if at is not None else []), columns=names)

    schema = f"conv string, {_COUNTS}, audit string, repaired_sha256 string, held long"
    names = [x.split()[0] for x in schema.split(", ")]
    found = _in_order(turns).mapInPandas(read, schema)
    return found.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *names[1:])


def repaired(turns: DataFrame) -> DataFrame:
    """The edits themselves, ``conv_id, place, edit, role, text`` in order of place: role and text are the repaired row's, null where it is deleted.

    Rows, nulls, ties and faults are as in ``report``; edits are written while the conversation is read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, at, out, place = None, None, [], 0

        def give(*edit: str | None) -> None:
            nonlocal place
            out.append((conv, place, *edit))
            place += 1

        for own, _, role, text, seen, absent in _rows(batches):
            if at is None or own != conv:
                if at is not None:
                    at.end()
                conv, at, place = own, Repair(give), 0
            if not absent:
                fault = fault_of(text, bool(seen))
                at.row(role, text, _CUT if fault == "truncated" else _FINE if fault is None else _DEAD)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if at is not None:
            at.end()
        yield pd.DataFrame(out, columns=names)

    names = ["conv", "place", "edit", "role", "text"]
    found = _in_order(turns).mapInPandas(read, "conv string, place long, edit string, role string, text string")
    return found.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *names[1:])


def damaged(conversations: DataFrame, lot: Column | None = None) -> DataFrame:
    """Conversations with faults laid in by lot, 0 to 19: 0 takes the row away (it stays as ``absent``), 1 empties its text, 2 removes its
    ".!?", 3 repeats it, 4 makes it the user's. The lot is drawn from conv_id and turn unless given. Nulls count as one space."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    drawn = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))), F.lit(20)) if lot is None else lot
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), drawn.alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("lot") == 0, "").otherwise(text).alias("text"), (F.col("lot") == 0).alias("absent"), F.explode(twice).alias("copy")
    ).drop("copy")
