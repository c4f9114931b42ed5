"""Greedy left-to-right selection over sparse nodes, exact for groups of any size.

A node is taken when it starts at or after the ``until`` of the latest taken one, or, when that
one may be replaced, when it scores higher. The walk streams over sorted partitions with a state
of three numbers. A chunk of a long media needs the state the chunk before it ends with; a walk
forgets its start quickly, so all chunks first run from an empty state and only those whose
incoming state turned out different run again, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .order import Ordered

_STATE = ("until", "score", "fixed")
_INCOMING = ("_until", "_score", "_fixed")


class _Walk:
    """State of the walk through one group."""

    def __init__(self, until, best, locked):
        self.until, self.best, self.locked = until, best, locked

    def step(self, start, until, score, fixed) -> str | None:
        if self.until is None or start >= self.until:
            mark = "push"
        elif not self.locked and score > self.best:
            mark = "replace"
        else:
            return None
        self.until, self.best, self.locked = until, score, fixed
        return mark


def _walks(batches: Iterator[pa.RecordBatch], part: list[str]):
    """(batch, marks, ended groups): every group is a stretch of equal ``part`` values."""
    walk, key = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*part, "start", *_STATE, *_INCOMING)]
        k = len(part)
        marks, ended = [], []
        for row in zip(*columns):
            if row[:k] != key:
                if walk is not None:
                    ended.append((key, walk))
                key, walk = row[:k], _Walk(*row[k + 4 :])
            marks.append(walk.step(*row[k : k + 4]))
        yield batch, marks, ended
    if walk is not None:
        yield None, [], [(key, walk)]


def greedy_select(nodes: Ordered) -> Ordered:
    """Nodes taken, with ``mark`` push or replace. ``nodes.df`` has _pos, start, until, score, fixed."""
    part, names = nodes.part, nodes.df.columns
    ddl = lambda cols: ", ".join(f"`{c}` {nodes.df.schema[c].dataType.simpleString()}" for c in cols)

    def select(batches):
        for batch, marks, _ in _walks(batches, part):
            if batch is not None:
                arrays = [batch.column(c) for c in names] + [pa.array(marks, pa.string())]
                out = pa.RecordBatch.from_arrays(arrays, names=[*names, "mark"])
                yield out.filter(pa.array([m is not None for m in marks], pa.bool_()))

    def ends(batches):
        for batch, _, ended in _walks(batches, part):
            if ended:
                rows = [dict(zip(part, key)) | dict(zip(_STATE, (w.until, w.best, w.locked))) for key, w in ended]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([*key_fields, ("until", pa.int64()), ("score", pa.float64()), ("fixed", pa.bool_())]))

    def sorted_by_group(df: DataFrame) -> DataFrame:
        return df.repartition(*part).sortWithinPartitions(*part, "_pos")

    def taken(df: DataFrame) -> DataFrame:
        return sorted_by_group(df).mapInArrow(select, f"{ddl(names)}, mark string")

    if not nodes.split:
        return nodes.to(taken(_fresh(nodes.df)))

    from pyspark.sql.pandas.types import to_arrow_type

    key_fields = [(c, to_arrow_type(nodes.df.schema[c].dataType)) for c in part]
    rows = materialise(nodes.df)

    def outgoing(df: DataFrame) -> DataFrame:
        return sorted_by_group(df).mapInArrow(ends, f"{ddl(part)}, until bigint, score double, fixed boolean")

    state = materialise(outgoing(_fresh(rows)))
    incoming = _shift(state, nodes)
    # Chunks whose incoming state is not the one they were last run with.
    todo = materialise(incoming.where("_until is not null").select(*part))
    while not todo.isEmpty():
        again = outgoing(rows.join(todo, part, "left_semi").join(incoming, part))
        state = materialise(state.join(todo, part, "left_anti").unionByName(again))
        shifted = materialise(_shift(state, nodes))
        old = incoming.withColumnsRenamed({c: f"old{c}" for c in _INCOMING})
        todo = materialise(shifted.join(old, part).where(_changed()).select(*part))
        incoming = shifted
    return nodes.to(taken(rows.join(incoming, part)))


def _changed() -> Column:
    out = F.lit(False)
    for c in _INCOMING:
        out = out | ~F.col(c).eqNullSafe(F.col(f"old{c}"))
    return out


def _fresh(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_until": F.lit(None).cast("bigint"),
            "_score": F.lit(0.0),
            "_fixed": F.lit(True),
        }
    )


def _shift(state: DataFrame, nodes: Ordered) -> DataFrame:
    """State each chunk starts with: the one the chunk before it ended with."""
    w = nodes.chunks()
    return state.select(*nodes.part, *[F.lag(c).over(w).alias(f"_{c}") for c in _STATE])
