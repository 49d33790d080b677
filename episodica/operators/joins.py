"""Joins that the engine lacks by name, all with an equality to deal rows by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with ``status`` missing (from the right) or extra; and keys that repeat on the right."""
    l, r = left.select(*keys), right.select(*keys)
    missing = l.distinct().join(r, keys, "left_anti").withColumn("status", F.lit("missing"))
    extra = r.distinct().join(l, keys, "left_anti").withColumn("status", F.lit("extra"))
    twice = r.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("status"))
    return missing.unionByName(extra).unionByName(twice)


def with_precedence(base: DataFrame, over: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of keys; the value of ``over`` where it has one."""
    return base.withColumnRenamed(value, "_base").join(over.withColumnRenamed(value, "_over"), keys, "full").select(*keys, F.coalesce("_over", "_base").alias(value))


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points in half-open intervals of the same key: an equality join with a range left over, never a nested loop."""
    p = points.alias("p")
    i = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    same = [F.col(f"p.{k}") == F.col(f"_{k}") for k in keys]
    hit = (F.col(f"p.{at}") >= F.col(start)) & (F.col(f"p.{at}") < F.col(end))
    cond: Column = hit
    for s in same:
        cond = s & cond
    return p.join(i, cond, how).drop(*[f"_{k}" for k in keys])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """To each left row the right row of its key that is nearest in ``at``; the earlier one on a tie.

    Both sides go through one sorted window (a merge, not a product): the last right row before and the first behind.
    ``right`` has keys, ``at`` and ``value``.
    """
    both = left.withColumn("_r", F.lit(None).cast(right.schema[value].dataType)).withColumn("_ra", F.lit(None).cast(right.schema[at].dataType)).withColumn("_left", F.lit(1))
    other = right.select(*keys, at, F.col(value).alias("_r"), F.col(at).alias("_ra"), F.lit(0).alias("_left"))
    whole = both.unionByName(other, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(at, F.desc("_left")).rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("_left") == 0, F.struct("_ra", "_r"))
    whole = whole.withColumn("_b", F.last(mark, ignorenulls=True).over(before)).withColumn("_n", F.first(mark, ignorenulls=True).over(behind)).where("_left = 1")
    gap_b, gap_n = F.col(at) - F.col("_b._ra"), F.col("_n._ra") - F.col(at)
    pick = F.when(F.col("_b").isNull(), F.col("_n")).when(F.col("_n").isNull() | (gap_b <= gap_n), F.col("_b")).otherwise(F.col("_n"))
    return whole.withColumn("_p", pick).withColumn(value, F.col("_p._r")).withColumn("gap", F.abs(F.col(at) - F.col("_p._ra"))).drop("_r", "_ra", "_left", "_b", "_n", "_p")


def divides(have: DataFrame, need: DataFrame, key: str, item: str) -> DataFrame:
    """Keys of ``have`` that hold every item of ``need`` (key, item): relational division per key."""
    met = need.join(have.select(key, item).distinct().withColumn("_met", F.lit(True)), [key, item], "left")
    return met.groupBy(key).agg(F.bool_and(F.coalesce("_met", F.lit(False))).alias("all_met"))
