"""Validation: rules that emit rows (record, path, message), and checks over histories and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.graphs import strong_components
from episodica.operators.scan import Table, scan


def violations(df: DataFrame, record: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """A row for each rule that a record breaks, in one pass; a rule is (path, holds, message), null counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, ok, m in rules]))
    return df.select(F.col(record).alias("record"), F.explode(found).alias("v")).select("record", "v.path", "v.message")


def staged(df: DataFrame, record: str, stages: list[list[tuple[str, Column, str]]]) -> DataFrame:
    """As ``violations``, but a record shows only those of its first stage that has any."""
    parts = []
    for rules in stages:
        parts.append(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, ok, m in rules])))
    first = parts[-1]
    for p in reversed(parts[:-1]):
        first = F.when(F.size(p) > 0, p).otherwise(first)
    return df.select(F.col(record).alias("record"), F.explode(first).alias("v")).select("record", "v.path", "v.message")


def legal_history(events: DataFrame, key: str, order: list[str], old: str, new: str, edges: list[tuple[str, str]], start: str) -> DataFrame:
    """Steps of a history that do not continue the last state, or are no legal edge."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = events.withColumn("_last", F.lag(new, 1, start).over(w))
    legal = F.lit(False)
    for a, b in edges:
        legal = legal | ((F.col(old) == a) & (F.col(new) == b))
    problem = F.when(F.col("_last") != F.col(old), "broken").when(~legal, "illegal")
    return seen.withColumn("problem", problem).where("problem is not null").drop("_last")


def tri_state(any_fail: Column, any_unknown: Column) -> Column:
    """Fail beats unknown beats pass: false, null, true."""
    return F.when(any_fail, F.lit(False)).when(any_unknown, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of (graph, a, b) on a cycle of any length."""
    return strong_components(edges).select("graph", F.col("node").alias("a"))


def in_order(df: DataFrame, keys: list[str], order: str, step: str) -> DataFrame:
    """keys, order, ok: whether no step up to a row repeats the one before it; the first that does spoils all that follow.

    Steps are few, and so are the states (last step, spoilt).
    """
    kinds = [r[0] for r in df.select(step).distinct().collect()]
    states = [(k, broken) for k in (*kinds, "") for broken in (False, True)]

    def move(state: tuple[str, bool], kind: str) -> tuple[tuple[str, bool], tuple[int]]:
        broken = state[1] or state[0] == kind
        return (kind, broken), (int(not broken),)

    return scan(df, keys, [order], [step], ("", False), move, lambda: Table(states, move), {"ok": "long"})
