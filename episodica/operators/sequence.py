"""Analytics over the ordered frames of an episode.

All of them partition by the episode key, so episodes are spread over the cluster and one sort by (key, order) serves
every window of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators.scan import Affine, Hysteresis, hysteresis_step, scan
from episodica.sources.shared import written


#: Cells that a bracket of values is counted in, brackets that are sent to every task, rows that brackets may hold to be
#: sorted at once, and rounds before they are sorted however many.
CELLS = 2_048
BROADCAST_BRACKETS = 50_000
SORTED = 1 << 20
ROUNDS = 8
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def with_frame_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "frame_index") -> DataFrame:
    """A frame index from 0 in the order given."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def by(keys: list[str], order: str = "frame_index") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def difference(value: str, keys: list[str], order: str = "frame_index") -> Column:
    """The step from the frame before, null on an episode's first frame."""
    return F.col(value) - F.lag(value).over(by(keys, order))


def with_islands(df: DataFrame, flag: Column, keys: list[str], order: str = "frame_index") -> DataFrame:
    """The frames where ``flag`` holds, numbered by run of consecutive ones in ``island``."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    starts = F.when(F.col("_flag") & ~F.coalesce(F.lag("_flag").over(by(keys, order)), F.lit(False)), 1).otherwise(0)
    return marked.withColumn("_start", starts).withColumn("island", F.sum("_start").over(by(keys, order))).where("_flag").drop("_flag", "_start")


def runs(df: DataFrame, flag: Column, keys: list[str], order: str = "frame_index") -> DataFrame:
    """One row a run: keys, start (inclusive), end (exclusive)."""
    found = with_islands(df, flag, keys, order)
    return found.groupBy(*keys, "island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("island")


def merge_runs(found: DataFrame, keys: list[str], gap: int | Column) -> DataFrame:
    """Runs with fewer than ``gap`` frames between them become one; runs are ordered and disjoint."""
    w = Window.partitionBy(*keys).orderBy("start")
    far = F.coalesce(F.col("start") - F.lag("end").over(w) >= gap, F.lit(True))
    groups = found.withColumn("_new", far.cast("int")).withColumn("_group", F.sum("_new").over(w))
    return groups.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def segment_midpoints(found: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary between a run's end and the next run's start: the floor of their mean."""
    w = Window.partitionBy(*keys).orderBy("start")
    nxt = F.lead("start").over(w)
    return found.withColumn("boundary", F.floor((F.col("end") - 1 + nxt) / 2)).where("boundary is not null")


def trailing_suffix(df: DataFrame, ok: Column, keys: list[str], order: str = "frame_index") -> DataFrame:
    """The number of frames at an episode's end on which ``ok`` holds without a break."""
    bad = F.max(F.when(~F.coalesce(ok, F.lit(False)), F.col(order)))
    return df.groupBy(*keys).agg((F.max(order) - F.coalesce(bad, F.lit(-1))).cast("long").alias("suffix"), F.count(F.lit(1)).alias("frames"))


def state_changes(df: DataFrame, flag: Column, keys: list[str], order: str = "frame_index") -> DataFrame:
    """Frames on which ``flag`` changes (false before the first), with ``event`` grasp or release."""
    marked = df.withColumn("_now", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_was", F.lag("_now", 1, False).over(by(keys, order)))
    return marked.where("_now <> _was").withColumn("event", F.when(F.col("_now"), "grasp").otherwise("release")).drop("_now", "_was")


def motion(df: DataFrame, value: str, keys: list[str], order: str = "frame_index") -> DataFrame:
    """Velocity, acceleration and their root mean squares, and the share of sign reversals, of each episode."""
    w = by(keys, order)
    steps = df.withColumn("_v", F.col(value) - F.lag(value).over(w))
    steps = steps.withColumn("_a", F.col("_v") - F.lag("_v").over(w))
    steps = steps.withColumn("_r", (F.signum("_v") * F.signum(F.lag("_v").over(w)) < 0).cast("int"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return steps.groupBy(*keys).agg(
        rms("_v").alias("velocity_rms"), rms("_a").alias("acceleration_rms"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("long").alias("reversals"), F.avg("_r").alias("reversal_fraction"),
    )


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start, step: Callable, outputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """keys, order, ``keep`` and ``outputs`` (name to string or double): a fold over each group's rows in order.

    ``step(state, *inputs)`` gives the next state and the outputs of its row. Groups are dealt by key and sorted, and rows
    are read as they come, so a task holds the state of one group and one batch, however long the group is.
    """
    kept = list(dict.fromkeys([*keys, *order, *(keep or [])]))
    rows = df.select(*kept, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    types = {"string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64())}
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(n, types[t][0]) for n, t in outputs.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            names = zip(*(batch.column(kept.index(c)).to_pylist() for c in keys), strict=True)
            values = zip(*(batch.column(len(kept) + i).to_pylist() for i in range(len(inputs))), strict=True)
            out = []
            for name, value in zip(names, values, strict=True):
                if name != last:
                    last, state = name, start
                state, given = step(state, *value)
                out.append(given)
            columns = list(zip(*out, strict=True)) if out else [()] * len(outputs)
            made = [pa.array(list(c), types[t][1]) for c, t in zip(columns, outputs.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, *outputs])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ema(df: DataFrame, value: str, keys: list[str], alpha: float, order: str = "frame_index") -> DataFrame:
    """Exponential smoothing from the first value on."""

    def step(last: float | None, x: float) -> tuple[float, tuple[float]]:
        now = x if last is None else last + alpha * (x - last)
        return now, (now,)

    return scan(df, keys, [order], [value], None, step, lambda: Affine(alpha), {"ema": "double"}, [value])


def hysteresis_cycles(df: DataFrame, value: str, keys: list[str], share: float = 0.25, order: str = "frame_index") -> DataFrame:
    """Cycles that close when the smoothed value falls ``share`` of its span below the last peak and open when it rises so much.

    The value is smoothed by five taps with zeros outside the episode. Rows: keys, start, end (null if never opened).
    """
    taps = df.withColumn("_s", F.sum(value).over(by(keys, order).rowsBetween(-2, 2)) / 5)
    span = df.select(*keys, order, value)  # the taps' extremes by episode, in their own shuffle
    span = span.withColumn("_s", F.sum(value).over(by(keys, order).rowsBetween(-2, 2)) / 5).groupBy(*keys).agg(((F.max("_s") - F.min("_s")) * share).alias("_span"))
    begin = ("above", float("-inf"))
    seen = scan(taps.join(span, keys), keys, [order], ["_s", "_span"], begin, hysteresis_step, Hysteresis, {"event": "string"}).where("event is not null")
    closes = seen.withColumn("end", F.lead(order).over(by(keys, order))).where("event = 'close'")
    return closes.select(*keys, F.col(order).alias("start"), "end")


def _by_range(df: DataFrame, order: list[str], within: list[str], value: Column, tag: str) -> DataFrame:
    """Rows dealt by range of ``order`` and written once, with ``_sum``, the running sum of ``value`` from the first row on.

    Sums restart for each value of ``within``, the first columns of ``order``. A task sums its own range; only one row for
    each range (and value of ``within``) meets in the window that shifts them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", *within).orderBy(*[c for c in order if c not in within])
    summed = written(dealt.withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))), tag)
    totals = summed.groupBy("_part", *within).agg(F.max("_sum").alias("_total"))  # values are not negative
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    match = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        match = match & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    joined = summed.join(shifts, match).withColumn("_sum", F.col("_before") + F.col("_sum"))
    return joined.drop("_part", "_p", "_before", *[f"_w{i}" for i in range(len(within))])


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A running number from 1 over all rows in order, without bringing them to one task."""
    return _by_range(df, order, [], F.lit(1).cast("long"), "rank").withColumnRenamed("_sum", name)


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` (not negative) over all rows up to each one in order, without bringing them to one task."""
    return _by_range(df, order, [], F.col(value), "sums").withColumnRenamed("_sum", name)


def _values_by_sort(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _v, _c, _sum of the values of each group: its distinct values with their counts and running counts.

    Equal values collapse before anything is dealt; the distinct ones are numbered by range.
    """
    counts = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return _by_range(counts, [*keys, "_v"], keys, F.col("_c"), "values")


def _same(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], least: int = 1) -> DataFrame:
    """For each group (of ``least`` values or more) its size ``n`` and the values at ``places``: functions of n, from 1.

    By brackets: the values between two bounds are counted in at most ``CELLS`` cells of equal width, by task first, with
    the least and greatest of each; the cell that a place falls in is its next bracket, with the place less what lies
    below. A cell of one value ends it. The last bracket's values are sorted, after ``ROUNDS`` rounds or as soon as
    brackets hold few, so no more than these is ever sorted, and a group may be as large as the table. Nulls are left out.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    values = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(keys, named, strict=True)], F.col(value).alias("_v"))
    whole = values.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_n") >= least)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("place")) for name, place in places.items()]))
    whole, done = written(whole, "groups"), []
    open_ = whole.withColumn("_w", wanted).select(*named, "_n", "_lo", "_hi", F.col("_w.name").alias("_name"), F.col("_w.place").alias("_t"), F.col("_n").alias("_in"))
    open_ = open_.where(F.col("_t").between(1, F.col("_n")))
    kind = dict(values.dtypes)["_v"]
    small = (whole.agg(F.sum("_n")).first()[0] or 0) <= SORTED
    if small or kind not in _NUMBERS:
        ends = _values_by_sort(values, named)
        ends = ends.select(*[F.col(k).alias(f"{k}r") for k in named], "_v", "_c", "_sum")
        match = _same([(k, f"{k}r") for k in named]) & (F.col("_t") <= F.col("_sum")) & (F.col("_t") > F.col("_sum") - F.col("_c"))
        return _by_name(open_.join(ends, match).select(*named, "_n", "_name", "_v"), keys, named, places)
    for _ in range(ROUNDS):
        done.append(open_.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*named, "_n", "_name", F.col("_lo").alias("_v")))
        left = open_.where(~F.col("_lo").eqNullSafe(F.col("_hi")))
        if (left.agg(F.sum("_in")).first()[0] or 0) <= SORTED:
            open_ = left
            break
        brackets = left.select(*named, "_lo", "_hi").distinct()
        inside = _within(values, brackets, named)
        at, span = F.col("_v").cast("double") - F.col("_lo").cast("double"), F.col("_hi").cast("double") - F.col("_lo").cast("double")
        cell = F.when(F.isnan(at) | F.isnan(span) | (span == float("inf")), 0).otherwise(F.least(F.floor(at / span * CELLS), F.lit(CELLS - 1))).cast("int")
        cells = inside.groupBy(*named, "_lo", "_hi", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*named, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows at most
        cells = cells.withColumn("_sum", F.sum("_c").over(w))
        right = cells.select(*[F.col(k).alias(f"{k}r") for k in named], F.col("_lo").alias("_lor"), F.col("_hi").alias("_hir"), "_c", "_a", "_b", "_sum")
        match = _same([*[(k, f"{k}r") for k in named], ("_lo", "_lor"), ("_hi", "_hir")])
        hit = left.join(right, match & (F.col("_t") <= F.col("_sum")) & (F.col("_t") > F.col("_sum") - F.col("_c")))
        hit = hit.select(*named, "_n", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_name", (F.col("_t") - F.col("_sum") + F.col("_c")).alias("_t"), F.col("_c").alias("_in"))
        open_ = written(hit, "brackets")
    rest = open_.where(~F.col("_lo").eqNullSafe(F.col("_hi")))
    done.append(open_.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*named, "_n", "_name", F.col("_lo").alias("_v")))
    if rest.head(1):
        inside = _within(values, rest.select(*named, "_lo", "_hi").distinct(), named)
        ends = _values_by_sort(inside, [*named, "_lo", "_hi"]).select(*[F.col(k).alias(f"{k}r") for k in named], F.col("_lo").alias("_lor"), F.col("_hi").alias("_hir"), "_v", "_c", "_sum")
        match = _same([*[(k, f"{k}r") for k in named], ("_lo", "_lor"), ("_hi", "_hir")])
        picked = rest.join(ends, match & (F.col("_t") <= F.col("_sum")) & (F.col("_t") > F.col("_sum") - F.col("_c")))
        done.append(picked.select(*named, "_n", "_name", "_v"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return _by_name(found, keys, named, places)


def _by_name(found: DataFrame, keys: list[str], named: list[str], places: dict) -> DataFrame:
    picks = [F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places]
    return found.groupBy(*[F.col(k).alias(c) for c, k in zip(keys, named, strict=True)]).agg(F.max("_n").alias("n"), *picks)


def _within(values: DataFrame, brackets: DataFrame, named: list[str]) -> DataFrame:
    """Rows of ``values`` with each bracket of their group that holds them; few brackets go to every task."""
    right = brackets.select(*[F.col(k).alias(f"{k}r") for k in named], "_lo", "_hi")
    few = right.limit(BROADCAST_BRACKETS + 1).count() <= BROADCAST_BRACKETS
    match = _same([(k, f"{k}r") for k in named]) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return values.join(F.broadcast(right) if few else right, match).drop(*[f"{k}r" for k in named])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group between the two nearest values, as ``percentile`` gives them, for groups of any size."""
    places = {}
    for name, q in wanted.items():
        places[f"{name}_low"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + 1
        places[f"{name}_high"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q)) + 1
    found = values_at(df, keys, value, places)
    between = lambda name, q: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * ((F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)))
    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in wanted.items()])
