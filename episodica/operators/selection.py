"""Top-k, sampling, sharding and budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.sequence import fold_in_order


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each task's rows to k before the shuffle where k is a number."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_k") <= k).drop("_k")


def bisection_level(place: Column, n: Column) -> Column:
    """The first of the strides n, n // 2, n // 4, ..., 1 that divides ``place``, as its index."""
    strides = F.transform(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")), lambda i: F.greatest(F.floor(n / F.pow(F.lit(2.0), i)).cast("long"), F.lit(1)))
    return F.array_position(F.transform(strides, lambda s: (place % s == 0).cast("int")), 1) - 1


def spread(df: DataFrame, keys: list[str], order: list[Column], name: str = "spread_rank") -> DataFrame:
    """Rows of a group in an order that covers the whole range early."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("_p", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    level = placed.withColumn("_l", bisection_level(F.col("_p"), F.col("_n")))
    return level.withColumn(name, (F.row_number().over(w.orderBy("_l", "_p")) - 1).cast("long")).drop("_p", "_n", "_l")


def round_robin(df: DataFrame, key: str, within: list[Column], name: str = "turn") -> DataFrame:
    """A turn for each row: the first of every group, then the second of every group, ..."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*within)).cast("long"))


def greedy_admit(df: DataFrame, keys: list[str], order: list[str], cost: str, caps: dict[str, float], classes: dict[str, Column]) -> DataFrame:
    """Rows of a group one by one: admitted if no cap would be passed by what was admitted before.

    ``caps`` limits the admitted cost of the rows for which ``classes`` of the same name holds; the first cap that is
    passed is the reason.
    """
    names = list(caps)
    flags = [f"_of{i}" for i in range(len(names))]
    rows = df.withColumns({f: classes[n] for f, n in zip(flags, names, strict=True)})

    def step(sums: tuple[float, ...], price: float, *of: bool) -> tuple[tuple[float, ...], tuple[str]]:
        over = next((n for n, s, on in zip(names, sums, of, strict=True) if on and s + price > caps[n]), None)
        if over:
            return sums, (over,)
        return tuple(s + price if on else s for s, on in zip(sums, of, strict=True)), ("admitted",)

    return fold_in_order(rows, keys, order, [cost, *flags], (0.0,) * len(names), step, {"verdict": "string"})


def hash_order(*cols: str, seed: str = "") -> Column:
    """A fixed order that looks random: SHA-256 of the seed and the columns."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *cols), 256)


def weighted_key(weight: Column, *cols: str, seed: str = "") -> Column:
    """Key of weighted sampling without replacement: u^(1/w), u from a hash."""
    u = (F.conv(F.substring(hash_order(*cols, seed=seed), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52) + 1)
    return F.pow(u, 1.0 / weight)


def placed(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, clearance: float, k: int, keep: list[str] | None = None) -> DataFrame:
    """Rows of a group in order, each with ``place`` (from 1) if it is taken: ``k`` at most, none nearer than ``clearance``
    to one taken before it. A row without a point is not taken.

    The state is what was taken, by cells as wide as the clearance, so a row meets those of nine cells only.
    """

    def step(state: tuple[int, dict], a: float | None, b: float | None) -> tuple[tuple[int, dict], tuple[float | None]]:
        n, cells = state
        if n == k or a is None or b is None:
            return state, (None,)
        i, j = int(a // clearance), int(b // clearance)
        near = (p for u in (i - 1, i, i + 1) for v in (j - 1, j, j + 1) for p in cells.get((u, v), ()))
        if any((a - c) * (a - c) + (b - d) * (b - d) < clearance * clearance for c, d in near):
            return state, (None,)
        return (n + 1, {**cells, (i, j): (*cells.get((i, j), ()), (a, b))}), (float(n + 1),)

    return fold_in_order(df, keys, order, [x, y], (0, {}), step, {"place": "double"}, keep)
