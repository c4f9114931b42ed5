"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows read and what the last written role was; edges keep, rerole or
delete the next row, or insert a turn. A forward heap and a reverse heap meet; all crossings of the least
cost are finished, and the least concatenation of a forward and a reverse audit is the answer. Equal structures
are solved once. A conversation of many rows is cut into segments, each solved for every state at its two ends.

Conversations of ordinary size are streamed, one after the other, through sorted partitions. Very long ones
are spread: rows are sorted by range, segments of one conversation are solved in many tasks, and only
their costs and audits, then the texts for the digest, pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, placed, stored

BLANK = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# What was written last: nothing, system, user, assistant. A repaired conversation is s?(ua)+ or empty.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
INFINITE = float("inf")


@dataclass(frozen=True)
class Limits:
    """segment: rows that one lattice spans; rows, size: rows and bytes of text beyond which a conversation is spread over tasks."""

    segment: int = 256
    rows: int = 20_000
    size: int = 32 << 20


class Row(NamedTuple):
    """What the lattice sees of rows in a run; only rows that must go have a run above 1."""

    initial: str
    must_go: bool = False
    truncated: bool = False
    run: int = 1


@lru_cache(1 << 16)
def edges(state: int, row: Row) -> tuple[tuple[str, int, int], ...]:
    """``letters, next state, cost`` of what can be done with a row."""
    out = [("D" * row.run, state, DELETE * row.run)]
    if not row.must_go:
        extra = TRUNCATED if row.truncated else 0
        out.append(("R", NEXT[state], REROLE + extra))
        if (state, row.initial) in KEPT:
            out.append(("K", KEPT[state, row.initial], KEEP + extra))
    return tuple(out)


class Front:
    """One of the two searches: labels (cost, least audit), the heap, and the settled nodes.

    The heap is ordered by cost, then by rows left behind: every edge without cost passes a row, so a node is
    settled after all that can still change its label.
    """

    def __init__(self, starts: list[tuple[int, int]], sign: int):
        self.sign = sign
        self.labels = {node: (0, "") for node in starts}
        self.heap = [(0, sign * i, q) for i, q in starts]
        heapq.heapify(self.heap)
        self.settled: set[tuple[int, int]] = set()

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else INFINITE

    def pop(self) -> tuple[int, int]:
        _, at, q = heapq.heappop(self.heap)
        node = (self.sign * at, q)
        self.settled.add(node)
        return node

    def relax(self, node: tuple[int, int], cost: int, audit: str) -> None:
        known = self.labels.get(node)
        if known is None or (cost, audit) < known:
            self.labels[node] = (cost, audit)
            if known is None or cost < known[0]:
                heapq.heappush(self.heap, (cost, self.sign * node[0], node[1]))


def forward_edges(rows: tuple[Row, ...], node: tuple[int, int]) -> Iterator[tuple[str, tuple[int, int], int]]:
    i, q = node
    yield "I", (i, NEXT[q]), INSERT
    if i < len(rows):
        for letters, r, cost in edges(q, rows[i]):
            yield letters, (i + 1, r), cost


def reverse_edges(rows: tuple[Row, ...], node: tuple[int, int]) -> Iterator[tuple[str, tuple[int, int], int]]:
    j, r = node
    for q in range(4):
        if NEXT[q] == r:
            yield "I", (j, q), INSERT
        if j:
            for letters, end, cost in edges(q, rows[j - 1]):
                if end == r:
                    yield letters, (j - 1, q), cost


@lru_cache(1 << 14)
def cheapest(rows: tuple[Row, ...], entry: int = NOTHING, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and least audit of that cost from a state before the rows to one of the states after them."""
    ahead, back = Front([(0, entry)], 1), Front([(len(rows), q) for q in exits], -1)
    ends = set(back.labels)
    best = min((0 for node in ahead.labels if node in ends), default=INFINITE)
    # Beyond the least cost no crossing is left; up to it, all of them are finished.
    while ahead.top() + back.top() <= best and (ahead.heap or back.heap) and min(ahead.top(), back.top()) < INFINITE:
        own, other, out = (ahead, back, forward_edges) if ahead.top() <= back.top() else (back, ahead, reverse_edges)
        node = own.pop()
        cost, audit = own.labels[node]
        for letters, to, more in out(rows, node):
            own.relax(to, cost + more, audit + letters if own is ahead else letters + audit)
            if to in other.labels:
                best = min(best, cost + more + other.labels[to][0])
    if best == INFINITE:
        return None
    crossings = []
    for node in ahead.settled:
        cost, audit = ahead.labels[node]
        if (node in back.settled or node in ends) and cost + back.labels[node][0] == best:
            crossings.append(audit + back.labels[node][1])
        for letters, to, more in forward_edges(rows, node):
            if (to in back.settled or to in ends) and cost + more + back.labels[to][0] == best:
                crossings.append(audit + letters + back.labels[to][1])
    return int(best), min(crossings)


Chain = tuple  # (earlier chain, piece) or None


def _before(a: Chain | None, b: Chain | None) -> bool:
    """Whether the text of one chain is less than that of another of as many pieces; walks back to where they part."""
    parted = []
    while a is not b:
        parted.append((a[1], b[1]))
        a, b = a[0], b[0]
    # No cheapest audit between two states begins another one, so the first unequal pieces decide.
    one, other = ("".join(p[k] for p in reversed(parted)) for k in (0, 1))
    return one < other


class Path:
    """Cheapest way through consecutive segments, for every state after the last one."""

    def __init__(self):
        self.states: dict[int, tuple[int, Chain | None]] = {NOTHING: (0, None)}

    def add(self, pieces: Iterable[tuple[int, int, int, str]]) -> None:
        """``entry, exit, cost, audit`` of the next segment."""
        reached: dict[int, tuple[int, Chain | None]] = {}
        for entry, end, cost, audit in pieces:
            if entry not in self.states:
                continue
            total, chain = self.states[entry][0] + cost, (self.states[entry][1], audit)
            known = reached.get(end)
            if known is None or total < known[0] or (total == known[0] and _before(chain, known[1])):
                reached[end] = (total, chain)
        self.states = reached

    def result(self) -> tuple[int, str]:
        cost, chain = self.states[NOTHING]
        if ASSISTANT in self.states:
            other = self.states[ASSISTANT]
            if other[0] < cost or (other[0] == cost and _before(other[1], chain)):
                cost, chain = other
        pieces = []
        while chain is not None:
            pieces.append(chain[1])
            chain = chain[0]
        return cost, "".join(reversed(pieces))


def segment_ways(rows: tuple[Row, ...]) -> Iterator[tuple[int, int, int, str]]:
    for entry in range(4):
        for end in range(4):
            found = cheapest(rows, entry, (end,))
            if found:
                yield entry, end, *found


def cheapest_edits(rows: list[Row], segment: int) -> tuple[int, str]:
    if len(rows) <= segment:
        return cheapest(tuple(rows))
    path = Path()
    for at in range(0, len(rows), segment):
        path.add(segment_ways(tuple(rows[at : at + segment])))
    return path.result()


def seen_as(role: str, text: str, earlier: bool, copies: int = 1) -> tuple[list[Row], tuple[int, int, int]]:
    """A row and its adjacent copies as the lattice sees them, and its faults: blank, duplicate, truncated."""
    words = text.rstrip(BLANK)
    if not words:
        return [Row(role[:1], True, False, copies)], (copies, 0, 0)
    cut = words[-1] not in ".!?"
    first = Row(role[:1], True) if earlier else Row(role[:1], False, cut)
    rest = [Row(role[:1], True, False, copies - 1)] if copies > 1 else []
    return [first, *rest], (0, copies - (not earlier), int(cut and not earlier))


def illegal_pairs(last: str | None, initial: str, copies: int) -> int:
    """Illegal neighbours that a run of rows of one role adds; two rows of one role never are legal."""
    return copies - 1 + (last is not None and last + initial not in LEGAL)


def edited(rows: Iterable[tuple[str, str, int]], audit: str) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` of the repaired turns. Rows are ``role, text, copies`` in order."""
    at, state = 0, NOTHING

    def insertions():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield "I", NAMES[state], ""

    for role, text, copies in rows:
        for _ in range(copies):
            yield from insertions()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = KEPT[state, role[:1]]
                yield "K", role, text
            elif edit == "R":
                state = NEXT[state]
                yield "R", NAMES[state], text
    yield from insertions()


def digest(turns: Iterable[tuple[str, str, str]]) -> str:
    whole, first = hashlib.sha256(), True
    for _, role, text in turns:
        whole.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
        first = False
    return whole.hexdigest()


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies`` after damage by the CRC-32 of ``conv_id:turn``, modulo 20; nulls read as one space.

    0 drops the row (no copies, its conversation stays known), 1 empties the text, 2 removes its ``.!?``, 3 repeats
    the row (two copies), 4 sets the role to user.
    """
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    rows = rows.withColumn("hit", hit).withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(F.col("hit") == 0, "").when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") <= 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "position long, edit string, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("g")


def _stream(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _batched(rows: Iterable[tuple], schema: str, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    out, form = [], _arrow(schema)
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield _table(out, form)
            out = []
    if out:
        yield _table(out, form)


def _ordinary(rows: DataFrame, limits: Limits, as_turns: bool) -> DataFrame:
    schema = "g string, " + (TURNS if as_turns else SUMMARY)

    def repaired(g: str, held: list[tuple]) -> Iterator[tuple]:
        seen, lattice, faults, illegal, last, turns = set(), [], [0, 0, 0], 0, None, set()
        for _, turn, role, text, copies in held:
            found, counts = seen_as(role, text, (role, text) in seen, copies)
            seen.add((role, text))
            lattice += found
            faults = [a + b for a, b in zip(faults, counts)]
            illegal, last = illegal + illegal_pairs(last, role[:1], copies), role[:1]
            turns.add(turn)
        turns.discard(None)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest_edits(lattice, limits.segment)
        out = edited(((role, text, copies) for _, _, role, text, copies in held), audit)
        if as_turns:
            yield from ((g, i, *turn) for i, turn in enumerate(out))
        else:
            yield g, gaps, *faults, illegal, cost, audit, digest(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _stream(batches, ["g", "turn", "role", "text", "copies"])
        groups = ((g, [r for r in held if r[4]]) for g, held in groupby(rows, key=lambda r: r[0]))
        yield from _batched((row for g, held in groups for row in repaired(g, held)), schema)

    keys = ["g", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.select("g", "turn", "role", "text", "copies").repartition("g").sortWithinPartitions(*keys).mapInArrow(run, schema)


def _spread(rows: DataFrame, limits: Limits, as_turns: bool) -> DataFrame:
    """Repair of conversations of any length; equal rows are folded, no task holds a conversation."""
    rows = rows.filter("copies > 0").groupBy("g", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn")).withColumn("head", F.left("text", F.lit(64)))
    first = rows.groupBy(F.col("g").alias("_g"), F.col("same").alias("_same")).agg(F.min("when").alias("_when"))
    rows = rows.join(first, (F.col("g") == F.col("_g")) & (F.col("same") == F.col("_same")))
    rows = rows.select("g", "turn", "role", "head", "text", "copies", (~F.col("when").eqNullSafe(F.col("_when"))).alias("earlier"))
    rows = stored(placed(rows, "g", ["turn", "role", "head"], ["text"]), "turns")
    cut = f"index div {limits.segment}"

    def solve(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("index")
        lattice, faults, illegal, last, roles = [], [0, 0, 0], 0, None, part.column("role").to_pylist()
        for role, tail, earlier, copies in zip(roles, *(part.column(c).to_pylist() for c in ("tail", "earlier", "copies"))):
            found, counts = seen_as(role, tail, earlier, copies)
            lattice += found
            faults = [a + b for a, b in zip(faults, counts)]
            illegal, last = illegal + illegal_pairs(last, role[:1], copies), role[:1]
        g, seg = (k.as_py() for k in key)
        ways = list(segment_ways(tuple(lattice)))
        rest = (*faults, illegal, roles[0][:1], roles[-1][:1])
        return pa.Table.from_batches([_table([(g, seg, *way, *rest) for way in ways], _arrow(solved))])

    solved = "g string, seg long, entry long, exit long, cost long, audit string, blank long, duplicate long, truncated long, illegal long, first string, last string"
    slim = rows.select("g", "index", "role", F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1)).alias("tail"), "earlier", "copies", F.expr(cut).alias("seg"))
    ways = stored(slim.groupBy("g", "seg").applyInArrow(solve, solved), "ways")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            rows = _stream(batches, [f.split()[0] for f in solved.split(", ")])
            for g, held in groupby(rows, key=lambda r: r[0]):
                path, faults, illegal, last = Path(), [0, 0, 0], 0, None
                for _, segment in groupby(held, key=lambda r: r[1]):
                    ways = list(segment)
                    path.add(way[2:6] for way in ways)
                    faults = [a + b for a, b in zip(faults, ways[0][6:9])]
                    illegal += ways[0][9] + (last is not None and last + ways[0][10] not in LEGAL)
                    last = ways[0][11]
                yield g, *faults, illegal, *path.result()

        yield from _batched(conversations(), audited, 16)

    audited = "g string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    audits = stored(ways.repartition("g").sortWithinPartitions("g", "seg", "entry", "exit").mapInArrow(connect, audited), "audits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            rows = _stream(batches, ["g", "audit", "role", "text", "copies"])
            for g, held in groupby(rows, key=lambda r: r[0]):
                audit = next(held)[1]
                out = edited((r[2:] for r in held), audit)
                if as_turns:
                    yield from ((g, i, *turn) for i, turn in enumerate(out))
                else:
                    yield g, digest(out)

        yield from _batched(conversations(), written)

    # The audit goes before the rows of its conversation in one sorted stream.
    written = "g string, " + (TURNS if as_turns else "repaired_sha256 string")
    lead = audits.select("g", F.lit(-1).cast("long").alias("index"), "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("copies", "long"))])
    texts = rows.select("g", "index", F.lit(None).cast("string").alias("audit"), "role", "text", "copies")
    output = lead.unionByName(texts).repartition("g").sortWithinPartitions("g", "index").mapInArrow(write, written)
    if as_turns:
        return output
    distinct = rows.select("g", "turn").distinct().groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    return audits.join(output, "g").join(distinct, "g").select("g", *[f.split()[0] for f in SUMMARY.split(", ")])


def repair(rows: DataFrame, limits: Limits = Limits(), as_turns: bool = False) -> DataFrame:
    """Repair of conversations given as ``conv_id, turn, role, text, copies`` (of ``damaged`` or the like; no null role or text).

    Returns one row for every conversation: gaps among its turn numbers, rows by first fault, illegal neighbours,
    cost and audit (edits K, R, D, I in order) of the cheapest edits, the least audit among equal costs, and the
    digest of the repaired turns. With ``as_turns``: the repaired turns themselves (position, edit, role, text).

    Rows are ordered by turn, nulls first; rows of one turn by role, then text. Equal rows are copies: all but the
    first are duplicates. A conversation whose rows have no copies is known and empty. A null ``conv_id`` is
    a conversation of its own; an empty table has none. Roles are told by their first letter; an empty role has none.
    """
    rows = rows.select("*", _key())
    size = rows.groupBy("g").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.first("conv_id").alias("conv_id"))
    size = stored(size, "conversations")
    long = size.filter((F.col("n") > limits.rows) | (F.col("bytes") > limits.size)).select("g")
    if long.limit(1).count():
        found = _ordinary(rows.join(long, "g", "left_anti"), limits, as_turns).unionByName(_spread(rows.join(long, "g", "left_semi"), limits, as_turns))
    else:
        found = _ordinary(rows, limits, as_turns)
    return size.select("g", "conv_id").join(found, "g", "inner").drop("g")
