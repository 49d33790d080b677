"""Summaries, robust statistics and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators import sequence as seq
from episodica.sources.shared import written


def distribution(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, sample standard deviation, q05, median, q95, least and greatest of each group."""
    parts = {"mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
    plain = df.groupBy(*keys).agg(*[F.round(c, digits).alias(n) for n, c in parts.items()])
    q = seq.quantiles(df, keys, value, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    return plain.join(q.select(*keys, *[F.round(c, digits).alias(c) for c in ("q05", "median", "q95")]), keys, "left")


def feature_stats(df: DataFrame, vector: str) -> DataFrame:
    """Count, mean, population standard deviation, extremes and quantiles of each dimension of a vector column."""
    long = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    parts = {"mean": F.avg("x"), "std": F.stddev_pop("x"), "min": F.min("x"), "max": F.max("x")}
    plain = long.groupBy("dim").agg(F.count("x").alias("count"), *[F.round(c, 6).alias(n) for n, c in parts.items()])
    wanted = {f"q{int(p * 100):02d}": p for p in (0.01, 0.1, 0.5, 0.9, 0.99)}
    q = seq.quantiles(long, ["dim"], "x", wanted)
    return plain.join(q.select("dim", *[F.round(c, 6).alias(c) for c in wanted]), "dim", "left")


def tukey_fences(df: DataFrame, keys: list[str], value: str, least: int = 8) -> DataFrame:
    """Fences 1.5 interquartile ranges outside the exclusive quartiles, of groups of at least ``least`` values.

    The j-th quartile by the exclusive method lies at place j * (n + 1) / 4.
    """
    low_place = lambda n, j: F.greatest(F.lit(1), F.least(F.floor(F.lit(j) * (n + 1) / 4), n - 1))
    places = {}
    for j in (1, 3):
        places[f"a{j}"] = lambda n, j=j: low_place(n, j)
        places[f"b{j}"] = lambda n, j=j: low_place(n, j) + 1
    found = seq.values_at(df, keys, value, places, least)
    n = F.col("n")
    delta = lambda j: F.lit(j) * (n + 1) - 4 * low_place(n, j)
    cut = lambda j: (F.col(f"a{j}") * (4 - delta(j)) + F.col(f"b{j}") * delta(j)) / 4
    fences = found.withColumns({"q1": cut(1), "q3": cut(3)})
    spread = F.col("q3") - F.col("q1")
    low = F.greatest(F.lit(0.0), F.col("q1") - 1.5 * spread - 0.01)
    return fences.select(*keys, "q1", "q3", low.alias("low"), (F.col("q3") + 1.5 * spread + 0.02).alias("high"))


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Deviation from the group's median in scaled median absolute deviations (0 counts as 1e-6)."""
    mid = seq.quantiles(df, keys, value, {"_mid": 0.5}).drop("n")
    off = written(df.join(mid, keys).withColumn("_off", F.abs(F.col(value) - F.col("_mid"))), "off")
    mad = seq.quantiles(off, keys, "_off", {"_mad": 0.5}).drop("n")
    scale = 1.4826 * F.when(F.col("_mad") == 0, 1e-6).otherwise(F.col("_mad"))
    return off.join(mad, keys).withColumn("z", (F.col(value) - F.col("_mid")) / scale).drop("_mid", "_off", "_mad")


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The element at place n // 2 of each group's sorted values."""
    return seq.values_at(df, keys, value, {name: lambda n: F.floor(n / 2) + 1}).drop("n")


def mode_vote(df: DataFrame, keys: list[str], signature: str, ordinal: str) -> DataFrame:
    """The most frequent signature of each group; the one seen first wins a tie."""
    counts = df.groupBy(*keys, signature).agg(F.count(F.lit(1)).alias("votes"), F.min(ordinal).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(signature, "votes"), F.struct("votes", -F.col("first"))).alias("w")).select(*keys, f"w.{signature}", "w.votes")


def latest_then_best(df: DataFrame, item: list[str], version: Column, group: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """Of each item the row of the greatest version, and of these for each group the row of the greatest rank."""
    newest = df.groupBy(*group, *item).agg(F.max_by(F.struct(*columns, rank.alias("_rank")), version).alias("r"))
    return newest.groupBy(*group).agg(F.max_by("r", F.struct("r._rank", *[f"r.{c}" for c in columns])).alias("b")).select(*group, *[f"b.{c}" for c in columns])


def cell_counts(df: DataFrame, keys: list[str], mask: str, width: int) -> DataFrame:
    """keys, rows, cells: for each of ``width`` cells the number of a group's masks that hold it.

    One partial sum for each cell, merged element by element; no row is made for a cell.
    """
    cells = F.array(*[F.sum(F.coalesce(F.try_element_at(mask, F.lit(i + 1)), F.lit(False)).cast("long")) for i in range(width)])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), cells.alias("cells"))


def prior_iou(df: DataFrame, keys: list[str], mask: str, width: int, least: float = 0.003) -> DataFrame:
    """Rows with ``prior`` (cells that more than half of the group's masks hold) and ``iou``, the overlap of a mask with it.

    Groups whose prior covers no more than ``least`` of the cells are left out.
    """
    priors = cell_counts(df, keys, mask, width).select(*keys, F.transform("cells", lambda c: c * 2 > F.col("rows")).alias("prior"))
    share = F.size(F.filter("prior", lambda c: c)) / F.lit(float(width))
    both = df.join(priors.where(share > least), keys)
    pairs = F.zip_with(mask, "prior", lambda a, b: F.struct((a & b).alias("i"), (a | b).alias("u")))
    common, joint = F.size(F.filter(pairs, lambda p: p["i"])), F.size(F.filter(pairs, lambda p: p["u"]))
    return both.withColumn("iou", common / joint)
