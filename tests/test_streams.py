import datetime as dt

import pytest

from episodica.plans import streams


@pytest.mark.parametrize("query", [streams.stream_tumbling, streams.stream_dedup])
def test_no_event_is_late_in_a_table_of_many_files(spark, tmp_path, query):
    """Files written newest first, more than three triggers take: lateness counts from the third on."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, "view", start + dt.timedelta(days=i), 1.0) for i in range(14)]
    for row in reversed(rows):
        spark.createDataFrame([row], "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert query(spark, str(tmp_path)).count() == 14


def test_state_follows_the_order_of_events(spark, tmp_path):
    """Events of a few users over many files in no order, some triggers: the folds see them by time."""
    import random

    draw, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, draw.choice(["view", "click", "purchase"]), start + dt.timedelta(minutes=draw.randrange(50)), 1.0) for i in range(60)]
    mixed = draw.sample(rows, len(rows))
    for k in range(0, 60, 6):
        spark.createDataFrame(mixed[k : k + 6], "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for late in ("1 hour", "10 days"):
        stream = streams.ev.event_stream(spark, str(tmp_path))
        state = {r["user_id"]: r for r in streams.ev.upsert(streams.ev.transitions(stream, late=late), ["user_id"]).collect()}
        polls = {r["user_id"]: r for r in streams.ev.upsert(streams.ev.terminal(stream, ["purchase"], late), ["user_id"]).collect()}
        for user in range(3):
            kinds = [k for _, _, k in sorted((t, i, k) for i, u, k, t, _ in rows if u == user)]
            assert (state[user]["last"], state[user]["steps"]) == (kinds[-1], 20)
            assert state[user]["repeats"] == sum(a == b for a, b in zip(kinds, kinds[1:], strict=False))
            first = kinds.index("purchase") if "purchase" in kinds else len(kinds)
            assert polls[user]["polls"] == first and polls[user]["ended"] == ("purchase" if "purchase" in kinds else "")


def test_late_events_are_counted_and_little_waits(spark, tmp_path):
    """Many triggers, a lateness of minutes: what comes behind the watermark is not folded but counted, and of a long
    stream no more waits than the lateness holds."""
    import os
    import random

    draw, start = random.Random(7), dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, draw.choice(["view", "click", "purchase"]), start + dt.timedelta(minutes=i), float(i)) for i in range(240)]
    early = [rows[i] for i in (3, 50, 91)]  # these come with the last files
    rest = [r for r in rows if r not in early]
    files = [sorted(rest[i : i + 12], key=lambda r: draw.random()) for i in range(0, len(rest), 12)]
    files[-1] += early
    path = f"{tmp_path}/events.parquet"
    for n, part in enumerate(files):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        spark.createDataFrame(part, "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)
        for name in set(os.listdir(path)) - before:
            os.utime(f"{path}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = streams.ev.event_stream(spark, str(tmp_path))
    got = {r["user_id"]: r for r in streams.ev.upsert(streams.ev.transitions(stream, late="10 minutes"), ["user_id"]).collect()}
    for user in (0, 1):
        kinds = [r[2] for r in sorted(rest, key=lambda r: r[3]) if r[1] == user]
        assert got[user]["late"] == sum(r[1] == user for r in early)
        assert (got[user]["last"], got[user]["steps"]) == (kinds[-1], len(kinds))
        assert got[user]["repeats"] == sum(a == b for a, b in zip(kinds, kinds[1:], strict=False))
        assert got[user]["pending"] <= 11  # of 120 events a user has in four hours


def test_users_near_each_other_share_a_key(spark, tmp_path):
    """A call for some users, not for each: what is folded stays theirs, and a user without an id is one too."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 41 == 40 else i % 41 - 20, "purchase" if i % 7 == 0 else "view", start + dt.timedelta(minutes=i), float(i)) for i in range(410)]
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    calls = spark.sparkContext.accumulator(0)

    class Counted(streams.ev._InOrder):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            calls.add(int(key[0] == key[0]))  # each row without an id is a call, as nulls are NaN here
            yield from super().handleInputRows(key, rows, timerValues)

    kept, streams.ev._InOrder = streams.ev._InOrder, Counted
    try:
        got = {r["user_id"]: r for r in streams.ev.upsert(streams.ev.publications(streams.ev.event_stream(spark, str(tmp_path)), "purchase"), ["user_id"]).collect()}
    finally:
        streams.ev._InOrder = kept
    assert set(got) == {r[1] for r in rows} and len(got) == 41
    for user, row in got.items():
        kinds = [r[2] for r in rows if r[1] == user]
        done = max((k + 1 for k, kind in enumerate(kinds) if kind == "purchase"), default=0)
        assert (row["published"], row["waiting"], row["late"]) == (done, len(kinds) - done, 0)
    assert calls.value == 4  # -20 to 19 by sixteens


def test_controls_of_neighbours_stay_apart(spark, tmp_path):
    """Smoothed values and controls of forty users that share keys, as plain loops have them."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 40, "view", start + dt.timedelta(minutes=i), float(i * 37 % 101)) for i in range(400)]
    spark.createDataFrame(rows[::-1], "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = streams.ev.controls(streams.ev.event_stream(spark, str(tmp_path)))
    got = {r["user_id"]: r for r in streams.ev.upsert(stream, ["user_id"]).collect()}
    for user in range(40):
        smooth = control = rows[user][4]
        for row in rows[user + 40 :: 40]:
            smooth += 0.3 * (row[4] - smooth)
            control = min(max(smooth, control - 20.0), control + 20.0)
        assert (got[user]["smooth"], got[user]["control"], got[user]["steps"]) == (pytest.approx(smooth), pytest.approx(control), 10)
    processor = streams.ev._InOrder((0.0,), lambda s, k, v: s, ["smooth double"])
    assert "user_id array<long>" in processor.schema  # a value for some users


@pytest.mark.parametrize("query", ["stream_controls", "stream_publish", "stream_state", "stream_poll"])
def test_a_table_of_many_files_is_one_trigger(spark, tmp_path, query):
    """Files in no order of time, more than four: every event is in the fold, and the store commits as often as for one
    file."""
    import random
    from pathlib import Path

    import duckdb

    from episodica import catalog

    draw, start = random.Random(9), dt.datetime(2024, 1, 1)
    rows = [(i, i % 20, draw.choice(["view", "click", "purchase"]), start + dt.timedelta(hours=draw.randrange(900)), float(draw.randrange(200))) for i in range(400)]
    for k in range(0, 400, 40):
        spark.createDataFrame(rows[k : k + 40], "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("stream-*/state/commits/[0-9]*"))
    got = catalog.QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.SQL[query]).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
    commits = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("stream-*/state/commits/[0-9]*")) - before
    assert len(commits) <= 2  # the files, and the release of what waits


def test_events_without_a_user_or_a_time(spark, tmp_path):
    """No user is one user, whose events do not cost a call each; ids stay whole beside a null; no time comes last."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, (None, 2**60 + 1, 5)[i % 3], "purchase" if i % 6 else "view", None if i in (3, 4) else start + dt.timedelta(minutes=i), float(i)) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r for r in streams.ev.upsert(streams.ev.transitions(streams.ev.replay(spark, str(tmp_path))), ["user_id"]).collect()}
    assert set(got) == {None, 2**60 + 1, 5}
    for user, row in got.items():
        kinds = [r[2] for r in sorted(rows, key=lambda r: (r[3] or dt.datetime.max, r[0])) if r[1] == user]
        assert (row["last"], row["steps"], row["late"]) == (kinds[-1], 10, 0)
        assert row["repeats"] == sum(a == b for a, b in zip(kinds, kinds[1:], strict=False))


def test_events_of_a_key_come_as_one_row(spark):
    """Rows to the fold are keys that a task holds, not events."""
    import pyarrow as pa

    columns = {"near": [3, 1, 3, -2], "place": [0, 1, 2, 3], "at": [4, 3, 2, 1], "event_id": [1, 2, 3, 4], "event_type": ["a", None, "c", "d"], "value": [1.0, 2.0, 3.0, 4.0]}
    types = {"place": pa.int32()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types.get(c)) for c, v in columns.items()], list(columns))
    (packed,) = streams.ev._packed(iter([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2)]))
    assert packed.to_pydict()["near"] == [-2, 1, 3] and packed.to_pydict()["event_type"] == [["d"], [None], ["a", "c"]]
    assert not list(streams.ev._packed(iter([])))
