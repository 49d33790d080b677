"""Windows, sessions, deduplication, progress and state over a stream of events.

Each function takes a streaming DataFrame and returns one; ``upsert`` drives such a query over what its source has now.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from episodica.sources.shared import shared_dir

LATE = "10 minutes"


def span(spark: SparkSession, sf_dir: str) -> str:
    """A lateness by which no event of the table comes late, in whatever order its files are read."""
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(F.col("ts").cast("timestamp").cast("double")), F.max(F.col("ts").cast("timestamp").cast("double"))).first()
    return f"{int((last or 0) - (first or 0)) + 1} seconds"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = 4) -> DataFrame:
    """Events as a stream of files, with an event time; without ``files_per_batch`` all files are one trigger."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # a pattern, since a stream's path may else only be a folder, and a table may be one file
    return source.parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def replay(spark: SparkSession, sf_dir: str, triggers: int = 1) -> DataFrame:
    """The events that are there now, over at most ``triggers`` triggers, however many their files: what a trigger costs
    besides its rows is not paid for every few files. With one trigger no event is late, in whatever order its file comes."""
    if triggers == 1:
        return event_stream(spark, sf_dir, None)
    files = len(spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles())
    return event_stream(spark, sf_dir, max(4, -(-files // triggers)))


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and sums by event type in windows of ``width`` (sliding by ``slide``)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    found = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Each key once, however often it is replayed within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot that grows with the stream: events and the greatest value of each key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


#: Users next to each other whose state is one value, as a power of 2.
NEAR = 4

#: An event for the fold, without nulls but for its kind: its user's place among the neighbours (the last: no user).
_EVENT = {"place": "int", "at": "long", "event_id": "long", "event_type": "string", "value": "double"}

#: Events that a task packs at once, and the time of one without, which comes last and never passes.
_PACK, _NEVER = 500_000, 2**63 - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by key: one row of arrays for all of a key's that a task has at hand, as each row costs the fold a call."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["near"].to_numpy(), kind="stable")))
        near = rows["near"].to_numpy()
        first = np.flatnonzero(np.diff(near, prepend=near[0] - 1))
        offsets = pa.array(np.append(first, len(near)).astype("int32"))
        lists = [pa.ListArray.from_arrays(offsets, rows[c].combine_chunks()) for c in _EVENT]
        return pa.RecordBatch.from_arrays([pa.array(near[first]), *lists], ["near", *_EVENT])

    held = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= _PACK:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _to_bytes(events: dict[str, np.ndarray]) -> bytes:
    batch, out = pa.RecordBatch.from_pydict(events), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> dict[str, np.ndarray]:
    rows = pa.ipc.open_stream(data).read_all()
    return {c: rows[c].to_numpy() for c in _EVENT}


class _InOrder(StatefulProcessor):
    """A fold of each user's events by (ts, event_id): a state of what the watermark has passed, and what waits.

    An event waits until a timer fires at the last time that its neighbours wait for, so no more waits than the lateness
    of some users' events. One that comes behind the watermark is counted and not folded. The states of up to
    2 ** ``NEAR`` users are one value, and their waiting events an Arrow table in it: every call to the store is a message
    from the Python worker, every key a batch of its own, and every element of an array goes through it by itself.
    """

    def __init__(self, start: tuple, step: Callable[[tuple, str, float], tuple], columns: list[str]):
        self.start, self.step = start, step
        settled = [c.split() for c in ["user_id long", *columns, "late long"]]
        self.width, self.names = len(settled), [*[name for name, _ in settled], "pending"]
        self.schema = ", ".join([*[f"{name} array<{kind}>" for name, kind in settled], "_waiting binary"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def _fold(self, near: int, parts: Iterator[pd.DataFrame], upto: int) -> tuple[list[tuple], int | None]:
        """Fold and forget what lies before ``upto``. Rows of users with news: the fold of that and of all that waits.
        And the last time that one waits for."""
        users, sets, come = {}, [], set()
        if held := self.held.get():
            users = {user: [tuple(state), late] for user, *state, late in zip(*held[: self.width], strict=True)}
            sets.append(_from_bytes(held[self.width]))
        name = lambda place: (near << NEAR) + place if place < 1 << NEAR else None
        for part in parts:
            new = {c: np.concatenate(part[c].tolist()) for c in _EVENT}
            behind = new["at"] < upto
            for place, late in enumerate(np.bincount(new["place"][behind]).tolist()):
                if late:
                    users.setdefault(name(place), [self.start, 0])[1] += late
            come.update(map(name, np.unique(new["place"]).tolist()))
            sets.append({c: v[~behind] for c, v in new.items()} if behind.any() else new)
        events = {c: np.concatenate([s[c] for s in sets]) for c in _EVENT}
        order = np.lexsort((events["event_id"], events["at"], events["place"]))
        events = {c: v[order] for c, v in events.items()}
        kinds, values, passed = events["event_type"].tolist(), events["value"].tolist(), events["at"] < upto
        places, first, count = np.unique(events["place"], return_index=True, return_counts=True)
        spans = {name(place): (lo, lo + n) for place, lo, n in zip(places.tolist(), first.tolist(), count.tolist(), strict=True)}
        rows = []
        for user in {*spans, *come}:
            own, (lo, hi) = users.setdefault(user, [self.start, 0]), spans.get(user, (0, 0))
            middle = lo + int(passed[lo:hi].sum())
            if middle == lo and user not in come:
                continue
            for at in range(lo, middle):
                own[0] = self.step(own[0], kinds[at], values[at])
            state = own[0]
            for at in range(middle, hi):
                state = self.step(state, kinds[at], values[at])
            rows.append((user, *state, own[1], hi - middle))
        waiting = {c: v[~passed] for c, v in events.items()}
        settled = [(user, *state, late) for user, (state, late) in users.items()]
        self.held.update((*([r[i] for r in settled] for i in range(self.width)), _to_bytes(waiting)))
        times = waiting["at"][waiting["at"] < _NEVER]
        return rows, int(times.max()) if len(times) else None

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)  # ids beside a null would else be doubles

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, last = self._fold(int(key[0]), rows, timerValues.getCurrentWatermarkInMs() * 1000)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, _ = self._fold(int(key[0]), iter(()), timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def in_event_order(events: DataFrame, start: tuple, step: Callable[[tuple, str, float], tuple], columns: list[str], late: str) -> DataFrame:
    """A fold over each user's events in the order of (ts, event_id), nulls last, whatever trigger they come in within
    ``late``.

    Rows: user_id, ``columns`` of all events so far, late (events that came behind the watermark and are not in the fold)
    and pending (events that wait for others of their time).
    """
    # users without an id are one beside those of key 0
    near = F.coalesce(F.shiftright("user_id", NEAR), F.lit(0)).cast("long").alias("near")
    place = F.coalesce(F.col("user_id").bitwiseAND((1 << NEAR) - 1), F.lit(1 << NEAR)).cast("int").alias("place")
    at, event_id = (F.coalesce(c, F.lit(_NEVER)).alias(name) for c, name in ((F.unix_micros("ts"), "at"), (F.col("event_id"), "event_id")))
    # without the event time itself among the columns, so that late rows reach the fold to be counted
    rows = events.withWatermark("ts", late).select(near, place, at, event_id, "event_type", "value")
    packed = rows.mapInArrow(_packed, "near long, " + ", ".join(f"{name} array<{kind}>" for name, kind in _EVENT.items()))
    schema = "user_id long, " + ", ".join([*columns, "late long", "pending long"])
    fold = _InOrder(start, step, columns)
    return packed.groupBy("near").transformWithStateInPandas(statefulProcessor=fold, outputStructType=schema, outputMode="Update", timeMode="EventTime")


def terminal(events: DataFrame, done: list[str], late: str = LATE) -> DataFrame:
    """Requests that are polled until they end: per user the first terminal event, and the polls before it."""

    def step(state: tuple, kind: str, _: float) -> tuple:
        polls, ended = state
        return state if ended else (polls, kind) if kind in done else (polls + 1, "")

    return in_event_order(events, (0, ""), step, ["polls long", "ended string"], late)


def transitions(events: DataFrame, start: str = "start", late: str = LATE) -> DataFrame:
    """Per user, in event order: the last state, steps so far and repeated states."""

    def step(state: tuple, kind: str, _: float) -> tuple:
        last, steps, repeats = state
        return kind, steps + 1, repeats + (kind == last)

    return in_event_order(events, (start, 0, 0), step, ["last string", "steps long", "repeats long"], late)


def controls(events: DataFrame, alpha: float = 0.3, rate: float = 20.0, late: str = LATE) -> DataFrame:
    """Per user: the smoothed value, and the control that follows it by no more than ``rate`` a step."""

    def step(state: tuple, _: str, value: float) -> tuple:
        smooth, control, steps = state
        smooth = smooth + alpha * (value - smooth) if steps else value
        control = min(max(smooth, control - rate), control + rate) if steps else smooth
        return smooth, control, steps + 1

    return in_event_order(events, (0.0, 0.0, 0), step, ["smooth double", "control double", "steps long"], late)


def publications(events: DataFrame, done: str, late: str = LATE) -> DataFrame:
    """Per user, clips that are complete are published in order: how many are, and how many wait since the last."""

    def step(state: tuple, kind: str, _: float) -> tuple:
        published, waiting = state
        return (published + waiting + 1, 0) if kind == done else (published, waiting + 1)

    return in_event_order(events, (0, 0), step, ["published long", "waiting long"], late)


def upsert(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what its source has now and return the last value of each key.

    Every trigger appends its rows under its batch id, so a replayed trigger is the same rows again.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema.add("_batch", "long")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{batch_id}")

    spark.createDataFrame([], schema).write.parquet(f"{base}/out/none")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state by name, timers
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    newest = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch"))))
    return newest.where("_k = 1").drop("_k", "_batch")
