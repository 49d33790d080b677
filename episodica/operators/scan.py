"""Scans in order over groups of any size.

``scan`` gives what a fold over a group's rows in order would give, without walking a group in one task. Rows are dealt by
range of (keys, order), so a group is a run of ranges. Where a group goes on in the next range, its rows in each range are
summed up as a *function* of the state they are entered with (affine for smoothing, a table for automata, a piecewise one
for hysteresis); at most one group crosses each bound, so there are no more functions than ranges. Applied one after the
other they give the state each range is entered with, and every range is replayed from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.sources.shared import written

_TYPES = {"string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64()), "long": (T.LongType(), pa.int64())}


class Affine:
    """x -> a * x + b; the first value where nothing came before."""

    def __init__(self, alpha: float):
        self.alpha, self.a, self.b, self.fresh = alpha, 1.0, 0.0, None

    def absorb(self, x: float) -> None:
        self.a *= 1 - self.alpha
        self.b += self.alpha * (x - self.b)
        self.fresh = x if self.fresh is None else self.fresh + self.alpha * (x - self.fresh)

    def apply(self, state: float | None) -> float | None:
        return self.fresh if state is None else self.a * state + self.b


class Table:
    """State to state, for an automaton of few states; states that have met go on as one."""

    def __init__(self, states: list, step: Callable):
        self.slot, self.now, self.step = {s: i for i, s in enumerate(states)}, list(states), step

    def absorb(self, *inputs: Any) -> None:
        moved = [self.step(s, *inputs)[0] for s in self.now]
        distinct = list(dict.fromkeys(moved))
        if len(distinct) < len(moved):
            to = {s: i for i, s in enumerate(distinct)}
            self.slot = {s: to[moved[i]] for s, i in self.slot.items()}
        self.now = distinct

    def apply(self, state: Any) -> Any:
        return self.now[self.slot[state]]


#: States of a hysteresis: ("above", greatest value since it opened) and ("below", value it closed at).
def hysteresis_step(state: tuple[str, float], x: float, span: float) -> tuple[tuple[str, float], tuple[str | None]]:
    kind, level = state
    if kind == "above":
        peak = max(level, x)
        return (("below", x), ("close",)) if peak - x > span else (("above", peak), (None,))
    return (("above", x), ("open",)) if x > level + span else (state, (None,))


class Hysteresis:
    """Where a block leaves a hysteresis, piecewise in the level it is entered with.

    Entered above, it closes at the first value so far below the level, which is one lower than all before it, or where
    it would close whatever the level; entered below, it opens at the first value so far above the level, one higher than
    all before it. From there on the way is the same for all levels that close or open there; ways that meet go on as one.
    """

    def __init__(self) -> None:
        self.top, self.low, self.high, self.span = float("-inf"), float("inf"), float("-inf"), 0.0
        self.closed: int | None = None  # the way of all levels that are above still when it closes by itself
        self.falls: list[tuple[float, int]] = []
        self.rises: list[tuple[float, int]] = []
        self.ways: list[tuple[str, float]] = []
        self.seen = 0

    def absorb(self, x: float, span: float) -> None:
        self.span = span
        self.ways = [hysteresis_step(w, x, span)[0] for w in self.ways]
        if self.closed is None:
            self.top = max(self.top, x)
            if self.top - x > span:
                self.closed = self._way(("below", x))
            if x < self.low:
                self.low = x
                self.falls.append((x, self._way(("below", x)) if self.closed is None else self.closed))
        if x > self.high:
            self.high = x
            self.rises.append((x, self._way(("above", x))))
        self.seen += 1
        if self.seen % 32 == 0:
            self._join()

    def _way(self, state: tuple[str, float]) -> int:
        self.ways.append(state)
        return len(self.ways) - 1

    def _join(self) -> None:
        distinct = {w: i for i, w in enumerate(dict.fromkeys(self.ways))}
        to = [distinct[w] for w in self.ways]
        self.ways = list(distinct)
        self.closed = None if self.closed is None else to[self.closed]
        # of neighbours on one way the one reached by most levels decides
        self.falls = [(x, to[w]) for x, w in self.falls]
        self.rises = [(x, to[w]) for x, w in self.rises]
        for cuts in (self.falls, self.rises):
            cuts[:] = [c for i, c in enumerate(cuts) if i + 1 == len(cuts) or cuts[i + 1][1] != c[1]]

    def apply(self, state: tuple[str, float]) -> tuple[str, float]:
        kind, level = state
        if kind == "above":
            for x, way in self.falls:
                if level - x > self.span:
                    return self.ways[way]
            return self.ways[self.closed] if self.closed is not None else ("above", max(level, self.top))
        for x, way in self.rises:
            if x > level + self.span:
                return self.ways[way]
        return state


def _groups(batches: Iterator[pa.RecordBatch], keys: list[int], values: list[int]) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[tuple]]]:
    """Batches with the key and the inputs of each row."""
    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in keys], [batch.column(i).to_pylist() for i in values]
        yield batch, list(zip(*rows[0], strict=True)), list(zip(*rows[1], strict=True))


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Any, step: Callable, summary: Callable, outputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """keys, order, ``keep`` and ``outputs`` (name to string, double or long) of each row: a fold over its group in order.

    ``step(state, *inputs)`` gives the next state and the outputs of its row, and ``summary()`` an object that absorbs
    inputs in order and applies what they do to a state.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = list(dict.fromkeys([*keys, *order, *(keep or [])]))
    n = len(kept)
    rows = df.select(*kept, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    dealt = written(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    at, values = [kept.index(c) for c in keys], list(range(n, n + len(inputs)))
    ends = dealt.groupBy("_part").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last")).orderBy("_part").collect()  # a row for each range
    crossing = [(tuple(a["last"]), a["_part"], b["_part"]) for a, b in zip(ends, ends[1:], strict=False) if tuple(a["last"]) == tuple(b["first"])]
    entries: dict[tuple, Any] = {}
    if crossing:
        mine = {(p, key) for key, p, _ in crossing}
        sent = df.sparkSession.sparkContext.broadcast(mine)

        def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, block = None, None
            for batch, names, given in _groups(batches, at, values):
                for part, name, value in zip(batch.column(n + len(inputs)).to_pylist(), names, given, strict=True):
                    if (part, name) != now:
                        if block is not None:
                            yield row(now, block)
                        now, block = (part, name), summary() if (part, name) in sent.value else None
                    if block is not None:
                        block.absorb(*value)
            if block is not None:
                yield row(now, block)

        def row(now: tuple, block: Any) -> pa.RecordBatch:
            held = {name: value for name, value in vars(block).items() if not callable(value)}
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([pickle.dumps((now[1], held))])], ["part", "block"])

        hot = dealt.where(F.col("_part").isin(sorted({p for p, _ in mine})))
        found = hot.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", *keys, *order).mapInArrow(sum_up, "part int, block binary")
        blocks = {}
        for r in found.collect():  # one for each bound at most
            key, held = pickle.loads(r["block"])
            blocks[r["part"], key] = summary()
            vars(blocks[r["part"], key]).update(held)
        for key, part, after in crossing:
            entries[(after, key)] = blocks[(part, key)].apply(entries.get((part, key), start))
    state_of = df.sparkSession.sparkContext.broadcast(entries)
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, _TYPES[t][0]) for c, t in outputs.items()]])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch, names, given in _groups(batches, at, values):
            out = []
            for part, name, value in zip(batch.column(n + len(inputs)).to_pylist(), names, given, strict=True):
                if (part, name) != now:
                    now, state = (part, name), state_of.value.get((part, name), start)
                state, made = step(state, *value)
                out.append(made)
            columns = list(zip(*out, strict=True)) if out else [()] * len(outputs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(list(c), _TYPES[t][1]) for c, t in zip(columns, outputs.values(), strict=True)]], [*kept, *outputs])

    return dealt.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", *keys, *order).mapInArrow(replay, schema)
