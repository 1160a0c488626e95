r"""Repairing the structure of conversations at least cost.

Each turn gets its first fault: *blank* (nothing but blanks), *duplicate* (role and text
seen earlier in the conversation) or *truncated* (it does not end in ``.``, ``!`` or
``?``). Turns may be kept (cost 0), given the role user or assistant (3), deleted (4;
blank and duplicate turns have to be), and empty user or assistant turns inserted anywhere
(3); a truncated turn that stays costs 3 more. Afterwards the initials of the roles match
``(s?(ua)+)?``, and of all cheapest ways the one whose edits read least in ASCII is taken.

A conversation is a graph with a node for each place between turns and each state of that
pattern. Costs are integers up to 6, so distances to the end come from a queue of buckets
by distance, as Dial has it; the edits are then walked from the start over arcs that lie on
cheapest ways, the least letter first. A letter leads to one state only, so the walk is
forced.

Turns are range-sorted by conversation and turn and fall into cells of at most ``CELL``
rows, and a conversation's part of a cell is a block of one byte a turn. Where a
conversation has several blocks, each gives the cheapest cost from every state to every
state; these matrices, a few numbers for each block, are multiplied from the end to give the
distances at each border, and every block is then walked for each state it may be entered
in. So texts of one conversation never meet in one task, however many it has.

Defined cases: a null role or text reads as one space; turns are ordered by number (null
first), then role, then the text's SHA-256, so copies lie next to each other and all but
the first are duplicates; a role of another initial, or an empty one, fits nowhere as it
is; texts of any length are read whole; a null conv_id is a conversation of its own; an
empty table gives no conversation; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import materialise, ranges_for

#: Costs of the edits; a truncated turn that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a cell, a power of two.
CELL = 4096

#: States of the pattern: nothing yet, after the system turn, after a user, after an assistant (0 and 3 may end).
STATES, ENDS = 4, (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FAR = 1 << 40
#: No distance differs from its neighbours' by more than two edits and their surcharge.
_BUCKETS = 16


def _arcs(code: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edit) of the turn ``code``, in the order of the edits' letters.

    Codes are the initial (``-`` for one that fits nowhere), in upper case (``+``) where the
    turn is truncated, and ``d`` where it has to be deleted.
    """
    arcs = [(q, q, DELETE, "D-") for q in range(STATES)]
    if code == "d":
        return arcs
    more = TRUNCATED if code.isupper() or code == "+" else 0
    own = code.lower()
    arcs += [(p, q, more, f"K{own}") for (p, role), q in _NEXT.items() if role == own]
    return arcs + [(p, q, REROLE + more, f"R{role}") for (p, role), q in _NEXT.items() if role != "s"]


_TURN = {code: _arcs(code) for code in "suaSUA-+d"}
_ADDED = [(p, q, INSERT, f"I{role}") for (p, role), q in _NEXT.items() if role != "s"]
#: The same by the state they lead to, and by the state they leave.
_INTO = {code: [[(p, cost) for p, q, cost, _ in arcs if q == k] for k in range(STATES)] for code, arcs in {**_TURN, "": _ADDED}.items()}
_FROM = {code: [sorted((edit, q, cost) for p, q, cost, edit in arcs if p == k) for k in range(STATES)] for code, arcs in {**_TURN, "": _ADDED}.items()}


def distances(codes: str, ends: list[int]) -> list[int]:
    """Cheapest cost from (place, state), at ``4 * place + state``, to ``ends`` after the last turn, by a bucket queue."""
    n = len(codes)
    best = [_FAR] * (STATES * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    low = min(ends)
    for q, cost in enumerate(ends):
        if cost < _FAR:
            best[STATES * n + q] = cost
            buckets[cost % _BUCKETS].append(STATES * n + q)
    at, idle = low, 0
    while idle < _BUCKETS:
        bucket = buckets[at % _BUCKETS]
        idle = 0 if bucket else idle + 1
        while bucket:
            node = bucket.pop()
            if best[node] != at:
                continue  # reached at less since
            place, q = divmod(node, STATES)
            reached = [(STATES * place + p, at + cost) for p, cost in _INTO[""][q]]
            if place:
                reached += [(STATES * place - STATES + p, at + cost) for p, cost in _INTO[codes[place - 1]][q]]
            for other, cost in reached:
                if cost < best[other]:
                    best[other] = cost
                    buckets[cost % _BUCKETS].append(other)
        at += 1
    return best


def walk(codes: str, ends: list[int], best: list[int], state: int) -> tuple[str, int]:
    """Edits (letter and role each) of the least cheapest way from ``state`` before the first turn, and the state it ends in."""
    steps, place, n = [], 0, len(codes)
    while True:
        left = best[STATES * place + state]
        if place == n and left == ends[state]:
            return "".join(steps), state
        added = [(edit, place, q, cost) for edit, q, cost in _FROM[""][state]]
        turn = [(edit, place + 1, q, cost) for edit, q, cost in _FROM[codes[place]][state]] if place < n else []
        edit, place, state = min((edit, to, q) for edit, to, q, cost in added + turn if cost + best[STATES * to + q] == left)
        steps.append(edit)


_GOAL = [0 if q in ENDS else _FAR for q in range(STATES)]


def _matrix(codes: str) -> list[int]:
    """Cheapest cost from each state before the turns to each state after them, row by row."""
    columns = [distances(codes, [0 if q == k else _FAR for q in range(STATES)])[:STATES] for k in range(STATES)]
    return [columns[q][p] for p in range(STATES) for q in range(STATES)]


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault and ``initial`` of each turn, copies numbered by ``copy``.

    Copies of one turn are counted before anything is sent; of a role and text that come
    up in several turns only the least turn is joined back.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = materialise(rows, "repair-turns")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (rows.digest == first.d)
    later = F.coalesce(order > F.col("first"), F.lit(False))
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(end == "", "blank").when(later | (F.col("copy") > 0), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    rows = rows.join(first, same, "left").select("conv_id", "turn", "role", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), "text", "first")
    return rows.select("conv_id", "turn", "role", "digest", "copy", "text", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def blocks_of(ordered: DataFrame) -> DataFrame:
    """One row a block: first, conv_id, ``codes`` and ``initials`` (a character a turn), in the order of ``at``."""
    fits = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    short = F.when(F.col("fault") == "truncated", F.translate(F.upper(fits), "-", "+")).otherwise(fits)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(short)
    turn = F.struct("at", code.alias("code"), F.rpad("initial", 1, " ").alias("initial"))
    rows = ordered.groupBy("conv_id", F.expr(f"at div {CELL}").alias("cell")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    join = lambda field: F.array_join(F.transform("t", lambda x: x[field]), "")
    return rows.select(F.col("t")[0]["at"].alias("first"), "conv_id", join("code").alias("codes"), join("initial").alias("initials"))


def _by_conversation(blocks: DataFrame, value: str) -> DataFrame:
    """``first`` and ``value`` of the blocks of each conversation that has several, in order."""
    listed = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", value))).alias("b"))
    return listed.where(F.size("b") > 1).select("b")


def borders(blocks: DataFrame) -> DataFrame:
    """first, ends: the distances after each block of a conversation of several blocks."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_matrix(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["first", "conv_id", "matrix"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(0).to_pylist():
                ends = np.array(_GOAL, np.int64)
                for block in reversed(own):
                    out.append((block["first"], ends.tolist()))
                    ends = np.minimum((np.array(block["matrix"]).reshape(STATES, STATES) + ends).min(axis=1), _FAR)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["first", "ends"])

    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv_id").alias("c"))
    cut = blocks.join(several, blocks.conv_id.eqNullSafe(several.c), "left_semi").select("first", "conv_id", "codes")
    made = cut.mapInArrow(matrices, f"first long, conv_id {blocks.schema['conv_id'].dataType.simpleString()}, matrix array<long>")
    return _by_conversation(made, "matrix").mapInArrow(multiplied, "first long, ends array<long>")


def solved(blocks: DataFrame) -> DataFrame:
    """first, conv_id, initials, cost and ``steps`` of each block: two characters an edit, its letter and the initial it gives."""

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for codes, ends in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                entries = range(1 if ends is None else STATES)
                ends = ends or _GOAL
                best = distances(codes, ends)
                ways = [walk(codes, ends, best, q) for q in entries]
                rows.append(([steps for steps, _ in ways], [q for _, q in ways], best[0]))
            steps, exits, cost = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(steps, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())), pa.array(cost, pa.int64())],
                names=["first", "conv_id", "initials", "ways", "exits", "cost"],
            )

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(0).to_pylist():
                state = 0
                for block in own:
                    out.append((block["first"], state))
                    state = block["exits"][state]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32())], names=["first", "entry"])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    seen = blocks.join(borders(blocks), "first", "left").select("first", "conv_id", "codes", "initials", "ends")
    ways = materialise(seen.mapInArrow(walks, f"first long, conv_id {kind}, initials string, ways array<string>, exits array<int>, cost long"), "repair-ways")
    entry = _by_conversation(ways, "exits").mapInArrow(entered, "first long, entry int")
    return ways.join(entry, "first", "left").select("first", "conv_id", "initials", "cost", F.get("ways", F.coalesce("entry", F.lit(0))).alias("steps"))


class Repair:
    """The tables of one repair: ``turns`` as ordered, and ``blocks`` with the edits."""

    def __init__(self, turns: DataFrame):
        rows = materialise(faulty(turns), "repair-faults")
        order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy"))
        dealt = rows.repartitionByRange(ranges_for(rows), *order).sortWithinPartitions(*order)
        #: conv_id, turn, role, text, fault, initial and ``at``, which orders all turns.
        self.turns = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "repair-ordered")
        self.blocks = materialise(solved(materialise(blocks_of(self.turns), "repair-blocks")), "repair-steps")

    def edited(self) -> DataFrame:
        """Every edit in order of (at, step): conv_id, edit (D, I, K or R), and role and text of the turn it leaves (null if deleted)."""
        # each turn takes the insertions before it, and the last of a block those after it
        own = F.posexplode(F.regexp_extract_all("steps", F.lit("(?:I.)*[DKR].(?:(?:I.)+$)?"), F.lit(0)))
        steps = self.blocks.select("first", own).select((F.col("first") + F.col("pos")).alias("at"), F.col("col").alias("own"))
        each = self.turns.join(steps, "at").select("conv_id", "at", F.col("role").alias("was"), F.col("text").alias("said"), F.posexplode(F.regexp_extract_all("own", F.lit(".."), F.lit(0))).alias("step", "code"))
        edit, given = F.substring("code", 1, 1), F.when(F.substring("code", 2, 1) == "u", "user").otherwise("assistant")
        role = F.when(edit == "K", F.col("was")).when(edit != "D", given)
        text = F.when(edit.isin("K", "R"), F.col("said")).when(edit == "I", "")
        return each.select("conv_id", "at", "step", edit.alias("edit"), role.alias("role"), text.alias("text"))

    def audit(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation."""
        count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
        span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        counts = self.turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
        letters = F.regexp_replace("steps", "(.).", "$1")
        listed = self.blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", letters.alias("letters"), "initials", "cost"))).alias("b"))
        joined = lambda field: F.array_join(F.transform("b", lambda x: x[field]), "")
        ways = listed.select(F.col("conv_id").alias("c"), _illegal(joined("initials")).alias("illegal"), F.col("b")[0]["cost"].alias("cost"), joined("letters").alias("audit"))
        return counts.join(ways, counts.conv_id.eqNullSafe(ways.c)).drop("c")


def _illegal(initials: Column) -> Column:
    """Adjacent pairs that are none of su, ua and au: all pairs less those."""
    legal = lambda pair: F.regexp_count(initials, F.lit(f"{pair[0]}(?={pair[1]})"))
    return (F.greatest(F.length(initials) - 1, F.lit(0)) - legal("su") - legal("ua") - legal("au")).cast("long")
