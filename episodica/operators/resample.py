"""Bootstraps of paired differences by weights that follow from names, not from where a row lies.

The weight of an episode in a resample is a Poisson draw from (a * c) mod p, where a is hashed from the episode's name
and c from the resample's number. Tasks hold sums by resample only; episodes are never repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.sources.shared import dealt, written

PRIME = 2_147_483_647
#: Places of a draw from which on an episode weighs 1, 2, 3 and 4: the Poisson distribution of mean 1.
STEPS = tuple(int(x * PRIME) for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184))
#: Episodes and resamples of one block of weights, which stays in a core's cache.
BLOCK, WIDTH = 64, 1_024
#: Episodes of one task.
EPISODES = 16_384


def factor(name: Column) -> Column:
    """A factor from 1 to p - 1 by the first 32 bits of a name's md5."""
    return F.conv(F.substring(F.md5(name.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(PRIME - 1) + 1


def _factors(resamples: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"b|{b}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for b in range(resamples)], dtype=np.int64)


def _weights(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The weight of each episode (rows) in each resample (columns), from (a * c) mod p."""
    x = a[:, None] * c[None, :]
    high = x >> 31  # 2^31 is 1 mod p, so the upper bits add to the lower ones
    x &= PRIME
    x += high
    place = x.astype(np.uint32)
    np.minimum(place, place - np.uint32(PRIME), out=place)  # less than p: a difference below 0 wraps round to the top
    w = (place >= STEPS[0]).view(np.uint8)
    for s in STEPS[1:]:
        w += (place >= s).view(np.uint8)
    return w.astype(np.float64)


def paired_differences(df: DataFrame, episode: str, condition: Column, other: Column, value: str) -> DataFrame:
    """episode, difference: the mean value under a condition less that under another, of episodes that have both."""
    both = df.groupBy(episode).agg(F.avg(F.when(condition, F.col(value))).alias("a"), F.avg(F.when(other, F.col(value))).alias("b"))
    return both.where("a is not null and b is not null").select(episode, (F.col("a") - F.col("b")).alias("difference"))


def bootstrap_sums(df: DataFrame, name: str, value: str, resamples: int) -> DataFrame:
    """b, weighted, weight: the sums of each resample. A task gives one row a resample, whatever the episodes it holds."""

    def run(batches):
        c = _factors(resamples)
        sums = np.zeros((2, resamples))
        for batch in batches:
            a, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            both = np.stack([x, np.ones_like(x)])
            for i in range(0, len(a), BLOCK):
                for j in range(0, resamples, WIDTH):
                    sums[:, j : j + WIDTH] += both[:, i : i + BLOCK] @ _weights(a[i : i + BLOCK], c[j : j + WIDTH])
        weighted, weight = sums
        held = np.flatnonzero(weight)
        yield pa.RecordBatch.from_pydict({"b": held.astype(np.int32), "weighted": weighted[held], "weight": weight[held]})

    rows = df.where(F.col(value).isNotNull()).select(factor(F.col(name)).alias("a"), F.col(value).cast("double").alias("x"))
    return dealt(written(rows, "episodes"), "a", rows=EPISODES).mapInArrow(run, "b int, weighted double, weight double").groupBy("b").agg(F.sum("weighted").alias("weighted"), F.sum("weight").alias("weight"))


def paired_bootstrap(df: DataFrame, name: str, value: str, resamples: int = 100_000, share: float = 0.95) -> DataFrame:
    """low, mid, high: the interval that holds ``share`` of the resampled means, and their mean; above: the share of them over 0."""
    means = bootstrap_sums(df, name, value, resamples).select((F.col("weighted") / F.col("weight")).alias("m"))
    side = (1 - share) / 2  # the percentiles are of as many values as there are resamples
    return means.agg(
        F.percentile("m", F.lit(side)).alias("low"), F.avg("m").alias("mid"), F.percentile("m", F.lit(1 - side)).alias("high"), F.avg((F.col("m") > 0).cast("int")).alias("above")
    )
