"""Workflow state and spending, as folds of append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.scan import Table, scan


def latest_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each record and how many steps it took."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("steps"))


def insert_or_conflict(stored: DataFrame, offered: DataFrame, key: str, content: str) -> DataFrame:
    """What an immutable insert does with each offered record: insert, existing (equal content) or conflict."""
    s = stored.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    out = offered.join(s, F.col(key) == F.col("_k"), "left")
    return out.withColumn("outcome", F.when(F.col("_k").isNull(), "insert").when(F.col(content).eqNullSafe(F.col("_c")), "existing").otherwise("conflict")).drop("_k", "_c")


def next_step(done: Column, blocked: Column, waiting: Column, attempts: Column, limit: int = 2) -> Column:
    """What to do with an episode: done, blocked, wait, first, retry or exhausted."""
    return F.when(done, "done").when(blocked, "blocked").when(waiting, "wait").when(attempts == 0, "first").when(attempts < limit, "retry").otherwise("exhausted")


def reservation_price(price: Column) -> Column:
    """Up to whole cents, with a guard against a cent too many."""
    return F.ceil(price * 100 - 1e-9) / 100


def recovered(status: Column) -> Column:
    """Status after a crash: what was reserved is released, what was being sent is uncertain."""
    return F.when(status == "reserved", "released").when(status == "submitting", "uncertain").otherwise(status)


def transitions(log: DataFrame, key: str, order: str, expected: str, new: str, edges: list[tuple[str, str]], start: str) -> DataFrame:
    """What each entry of a record's log does: key, order, outcome and the state after it.

    An entry names the state it expects. It is replayed if it repeats the last edge taken, mismatched if the record is in
    another state, applied if the edge is legal, else illegal.
    """
    legal, names = set(edges), sorted({start, *[s for edge in edges for s in edge]})

    def step(state: tuple[str, str], want: str, to: str) -> tuple[tuple[str, str], tuple[str, str]]:
        now, old = state
        if to == now and want == old:
            return state, ("replayed", now)
        if want != now:
            return state, ("mismatch", now)
        if (now, to) in legal:
            return (to, now), ("applied", to)
        return state, ("illegal", now)

    pairs = [(now, old) for now in names for old in names]
    return scan(log, [key], [order], [expected, new], (start, start), step, lambda: Table(pairs, step), {"outcome": "string", "state": "string"})
