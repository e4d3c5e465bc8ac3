"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has at most one system turn, first, and then user and assistant turns in alternation, from a user
turn to an assistant turn. For any sequence of turns, dynamic programming over this automaton finds the cheapest way to a legal
one: a turn keeps its role, is relabelled, or is merged with the turn before, and empty turns are inserted. The repaired turns are
rendered with markers that texts cannot forge.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import small, stash

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
# To relabel puts words in another mouth, so it costs more than a merge and an empty answer.
MERGE, INSERT, RELABEL = 2, 3, 6
OPEN, CLOSE = "<|", "|>"
START = "start"
#: Roles that may follow a state, and the empty turns that must come between.
NEXT = {
    START: {"system": [], "user": [], "assistant": ["user"]},
    "system": {"user": [], "assistant": ["user"]},
    "user": {"assistant": [], "user": ["assistant"]},
    "assistant": {"user": [], "assistant": ["user"]},
}
STATES = (START, *ROLES)
AT_END = {START: [], "system": ["user", "assistant"], "user": ["assistant"], "assistant": []}


Cost = tuple[int, int, int, int]  # with its edits: cost, relabels, merges, inserts


def _plus(a: Cost, b: Cost) -> Cost:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]


def _walk(turns: list[tuple[str | None, str]], start: str) -> dict[str, tuple[Cost, tuple | None]]:
    """Of each state that ``turns`` can lead to from ``start``: the least cost, and the way there."""
    best: dict[str, tuple[Cost, tuple | None]] = {start: ((0, 0, 0, 0), None)}
    for role, text in turns:
        role = (role or "").strip().lower()
        role = ALIASES.get(role, role)
        new: dict[str, tuple[Cost, tuple | None]] = {}
        for state, (cost, way) in best.items():
            for to in ROLES:
                wrong = int(to != role)
                steps = []
                if state == to:
                    steps.append(((MERGE, 0, 1, 0), "merge", []))
                if to in NEXT[state]:
                    between = NEXT[state][to]
                    steps.append(((INSERT * len(between), 0, 0, len(between)), "new", between))
                for extra, how, between in steps:
                    total = (cost[0] + extra[0] + RELABEL * wrong, cost[1] + wrong, cost[2] + extra[2], cost[3] + extra[3])
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (way, how, between, to, text))
        best = new
    return best


def _ended(state: str) -> Cost:
    """The cost of a legal end after ``state``."""
    return INSERT * len(AT_END[state]), 0, 0, len(AT_END[state])


def _written(way: tuple | None) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Texts that are merged with the turn before the first step, and the turns of a way."""
    steps = []
    while way is not None:
        steps.append(way)
        way = way[0]
    before: list[str] = []
    out: list[tuple[str, list[str]]] = []
    for _, how, between, to, text in reversed(steps):
        if how == "merge":
            (out[-1][1] if out else before).append(text)
        else:
            out += [(r, [""]) for r in between]
            out.append((to, [text]))
    return before, out


def repair(turns: list[tuple[str | None, str]]) -> tuple[int, list[tuple[str, str]], dict[str, int]]:
    """Cost, legal turns and counts of edits of the cheapest repair. Equal costs: fewer relabels, then merges, then inserts."""
    cost, state, way = min(((_plus(c, _ended(s)), s, way) for s, (c, way) in _walk(turns, START).items()), key=lambda e: (e[0], e[1]))
    out = _written(way)[1] + [(r, [""]) for r in AT_END[state]]
    return cost[0], [(r, "\n\n".join(t)) for r, t in out], {"relabels": cost[1], "merges": cost[2], "inserts": cost[3]}


END = f"\n{OPEN}end{CLOSE}\n"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN)


def render(turns: list[tuple[str, str]]) -> str:
    """Turns as text; backslashes and opening markers in texts are escaped, so that :func:`parse` gives the same turns."""
    return "".join(f"{OPEN}{r}{CLOSE}\n{_escaped(t)}{END}" for r, t in turns)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        close = text.index(CLOSE, at)
        role, i, plain = text[at + len(OPEN) : close], close + len(CLOSE) + 1, []
        while not text.startswith(OPEN, i):
            if text[i] == "\\":
                i += 1
                plain.append(OPEN if text.startswith(OPEN, i) else "\\")
                i += len(OPEN) if text.startswith(OPEN, i) else 1
            else:
                plain.append(text[i])
                i += 1
        out.append((role, "".join(plain)[:-1]))
        at = i + len(f"{OPEN}end{CLOSE}\n")
    return out


_OUT = pa.schema([("none", pa.bool_()), ("c", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int32()), ("n_rendered", pa.int32()), ("cost", pa.int32()), ("relabels", pa.int32()), ("merges", pa.int32()), ("inserts", pa.int32()), ("roles", pa.string()), ("rendered", pa.string())])
_OUT_SQL = "none boolean, c long, part long, n_turns int, n_rendered int, cost int, relabels int, merges int, inserts int, roles string, rendered string"
_CELLS = pa.schema([("none", pa.bool_()), ("c", pa.int64()), ("part", pa.int64()), ("cells", pa.list_(pa.int32()))])
_WAYS = pa.schema([("none", pa.bool_()), ("c", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("open", pa.bool_()), ("last", pa.bool_())])
#: Rows that lead to a conversation; ``none``: those without conv_id.
_KEY = ["none", "c"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 512)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations; rows of (none, c, role, text) in order."""

    def out() -> Iterator[tuple]:
        for key, own in groupby(_rows(batches), key=lambda r: r[:2]):
            turns = [(r[2], r[3] or "") for r in own]
            cost, legal, edits = repair(turns)
            yield *key, 0, len(turns), len(legal), cost, edits["relabels"], edits["merges"], edits["inserts"], ",".join(r for r, _ in legal), render(legal)

    return _batches(out(), _OUT)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part its least costs from each state to each role, four numbers, and whether its first turn is merged with the turn
    before; a cost of -1: no way. Rows of (none, c, part, role) in order."""

    def out() -> Iterator[tuple]:
        for key, own in groupby(_rows(batches), key=lambda r: r[:3]):
            turns, cells = [(r[3], "") for r in own], []
            for start in STATES:
                best = _walk(turns, start) if (start == START) == (key[2] == 0) else {}
                for end in ROLES:
                    cost, way = best.get(end, ((-1, 0, 0, 0), None))
                    while way is not None and way[0] is not None:
                        way = way[0]
                    cells += [*cost, int(way is not None and way[1] == "merge")]
            yield *key, cells

    return _batches(out(), _CELLS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the cheapest way through all parts of a conversation enters and leaves each; ``open``: whether the next part goes on with
    its last turn. Rows of (none, c, part, cells) in order; three bytes a part are held."""

    def out() -> Iterator[tuple]:
        for key, own in groupby(_rows(batches), key=lambda r: r[:2]):
            came, best = bytearray(), {0: (0, 0, 0, 0)}
            for *_, cells in own:
                new: dict[int, Cost] = {}
                for end in (1, 2, 3):
                    ways = []
                    for start, cost in best.items():
                        cell = cells[(start * 3 + end - 1) * 5 :][:5]
                        if cell[0] >= 0:
                            ways.append((_plus(cost, cell), start, cell[4]))
                    if ways:
                        new[end], start, joins = min(ways)
                    came.append(start * 2 + joins if ways else 255)
                best = new
            end = min(best, key=lambda e: (_plus(best[e], _ended(STATES[e])), STATES[e]))
            n, opened = len(came) // 3, False
            for part in range(n - 1, -1, -1):
                start, joins = divmod(came[part * 3 + end - 1], 2)
                yield *key, part, start, end, opened, part == n - 1
                end, opened = start, bool(joins)

    return _batches(out(), _WAYS)


def _format_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations; rows of (none, c, part, start, end, open, last, role, text) in order."""

    def out() -> Iterator[tuple]:
        for (*key, start, end, opened, last), own in groupby(_rows(batches), key=lambda r: r[:7]):
            turns = [(r[7], r[8] or "") for r in own]
            cost, way = _walk(turns, STATES[start])[STATES[end]]
            before, legal = _written(way)
            if last:
                cost = _plus(cost, _ended(STATES[end]))
                legal += [(r, [""]) for r in AT_END[STATES[end]]]
            text = "".join("\n\n" + _escaped(t) for t in before) + (END if before and (legal or not opened) else "")
            text += render([(r, "\n\n".join(t)) for r, t in legal])
            yield *key, len(turns), len(legal), *cost, ",".join(r for r, _ in legal), text[: -len(END)] if opened and legal else text

    return _batches(out(), _OUT)


def _parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """``rows`` with ``at``, their place in their conversation, and ``part``. Counted over ranges: no task holds a conversation."""
    # Of a text only its beginning, so that the sample that ranges are cut at is small; in a range whole texts are sorted.
    ranged = rows.repartitionByRange(*_KEY, "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*_KEY, "turn", "role", "text")
    ranged = stash(ranged.withColumn("m", F.monotonically_increasing_id()).withColumn("range", F.shiftright("m", 33)))
    before = F.sum("n").over(W.partitionBy(*_KEY).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = stash(ranged.groupBy(*_KEY, "range").agg(F.min("m").alias("first"), F.count("*").alias("n")).select(*_KEY, "range", "first", F.coalesce(before, F.lit(0)).alias("before")))
    at = F.col("m") - F.col("first") + F.col("before")
    placed = ranged.join(small(starts, starts.count()), [*_KEY, "range"]).withColumn("at", at)
    return placed.select(*_KEY, F.floor(F.col("at") / part_turns).cast("long").alias("part"), "at", "role", "text")


def format_chats(turns: DataFrame, *, part_turns: int = 1024) -> DataFrame:
    """One row for each part of each conversation of ``turns(conv_id, turn, role, text)``: conv_id, part, n_turns (read),
    n_rendered, cost, relabels, merges, inserts, roles, rendered.

    Turns stand in order of turn, then role and text; a null turn comes first. Rows alike in all four columns count once. Roles
    are taken in any case, by their usual other names too; a null or unknown role is always relabelled. Null texts are empty.
    Rows without conv_id are one conversation.

    A conversation of more than ``part_turns`` rows is written in parts of so many, but repaired as a whole: the costs of a part from
    each state to each are found for itself, chained over the parts of the conversation, and each part is then repaired between
    the states where the cheapest way enters and leaves it. Numbers of parts add up to those of the conversation, and their rendered
    texts, one after the other, are its text; a turn counts in the part where it begins. No task holds more than a part, and of
    the others a row of numbers at a time.
    """
    c = F.col("conv_id").cast("long")
    rows = turns.select(c.isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("c"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = stash(rows.distinct())
    long = stash(rows.groupBy(*_KEY).count().where(F.col("count") > part_turns).select(*_KEY))
    n = long.count()
    whole = rows.join(small(long, n), _KEY, "left_anti") if n else rows
    done = whole.repartition(*_KEY).sortWithinPartitions(*_KEY, "turn", "role", "text").select(*_KEY, "role", "text").mapInArrow(_format, _OUT_SQL)
    if n:
        part = [*_KEY, "part"]
        placed = _parts(rows.join(small(long, n), _KEY, "left_semi"), part_turns)
        cells = placed.select(*part, "at", "role").repartition(*part).sortWithinPartitions(*part, "at").select(*part, "role").mapInArrow(_cells, "none boolean, c long, part long, cells array<int>")
        ways = stash(stash(cells).repartition(*_KEY).sortWithinPartitions(*part).mapInArrow(_chain, "none boolean, c long, part long, start int, end int, open boolean, last boolean"))
        led = placed.join(small(ways, ways.count()), part).repartitionByRange(*part).sortWithinPartitions(*part, "at")
        done = done.unionByName(led.select(*part, "start", "end", "open", "last", "role", "text").mapInArrow(_format_parts, _OUT_SQL))
    return done.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), *[f.name for f in _OUT][2:])
