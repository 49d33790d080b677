"""Streaming queries, held to their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.plans.registry import FRAMES_SQL, query
from episodica.streaming import events as ev

#: Triggers of streams whose state takes events in any order.
TRIGGERS = 4


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    out = ev.upsert(ev.tumbling(ev.replay(spark, sf_dir, TRIGGERS), "1 day", late=ev.span(spark, sf_dir)), ["window_start", "event_type"])
    return out.select(_stamp("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS window_start, event_type, value FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    out = ev.upsert(ev.tumbling(ev.replay(spark, sf_dir, TRIGGERS), "1 day", "12 hours", ev.span(spark, sf_dir)), ["window_start", "event_type"])
    return out.select(_stamp("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', TRUE) THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    out = ev.upsert(ev.sessions(ev.replay(spark, sf_dir), "6 hours"), ["user_id", "session_start"], mode="complete")
    return out.select("user_id", _stamp("session_start"), _stamp("session_end"), "n")


@query("""SELECT DISTINCT event_id, user_id, event_type FROM events""")
def stream_dedup(spark, sf_dir):
    """The stream joined with a replay of itself: each event once."""
    stream = ev.replay(spark, sf_dir, TRIGGERS)
    out = ev.upsert(ev.once(stream.unionByName(ev.replay(spark, sf_dir, TRIGGERS)), ["event_id"], ev.span(spark, sf_dir)), ["event_id"], mode="append")
    return out.select("event_id", "user_id", "event_type")


@query("""WITH t AS (SELECT user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, arg_max(event_type, k) AS last, count(*) AS steps, count(*) FILTER (event_type = p) AS repeats FROM t GROUP BY 1""")
def stream_state(spark, sf_dir):
    """Per-user state kept across triggers, in the order of the events whatever the order of their files."""
    return ev.upsert(ev.transitions(ev.replay(spark, sf_dir)), ["user_id"]).drop("late", "pending")


@query("""SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1""")
def stream_progress(spark, sf_dir):
    """A running snapshot by kind."""
    out = ev.upsert(ev.progress(ev.replay(spark, sf_dir, TRIGGERS), ["event_type"]), ["event_type"])
    return out.select("event_type", "n", F.round("top", 6).alias("top"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), e AS (SELECT user_id, min(k) AS k FROM o WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT u.user_id, coalesce(e.k - 1, u.n) AS polls, coalesce(o.event_type, '') AS ended FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u LEFT JOIN e USING (user_id) LEFT JOIN o ON o.user_id = e.user_id AND o.k = e.k""")
def stream_poll(spark, sf_dir):
    """Polls of each request until it ends, in the order of the events whatever the order of their files."""
    return ev.upsert(ev.terminal(ev.replay(spark, sf_dir), ["purchase", "error"]), ["user_id"]).drop("late", "pending")


@query(f"""WITH RECURSIVE {FRAMES_SQL}, e AS (SELECT user_id, frame_index, value AS smooth, value AS control FROM frames WHERE frame_index = 0
  UNION ALL SELECT f.user_id, f.frame_index, e.smooth + 0.3 * (f.value - e.smooth), least(greatest(e.smooth + 0.3 * (f.value - e.smooth), e.control - 20), e.control + 20) FROM e JOIN frames f ON f.user_id = e.user_id AND f.frame_index = e.frame_index + 1)
SELECT user_id, round(arg_max(smooth, frame_index), 4) AS smooth, round(arg_max(control, frame_index), 4) AS control, count(*) AS steps FROM e GROUP BY 1""")
def stream_controls(spark, sf_dir):
    """Controls that follow a smoothed value at a limited rate, kept for each user over the triggers."""
    out = ev.upsert(ev.controls(ev.replay(spark, sf_dir)), ["user_id"])
    return out.select("user_id", F.round("smooth", 4).alias("smooth"), F.round("control", 4).alias("control"), "steps")


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT user_id, max(frame_index) AS last, max(frame_index) FILTER (event_type = 'purchase') AS done FROM frames GROUP BY 1)
SELECT user_id, coalesce(done + 1, 0) AS published, last - coalesce(done, -1) AS waiting FROM l""")
def stream_publish(spark, sf_dir):
    """Complete clips published in order from what arrives, with those that wait."""
    return ev.upsert(ev.publications(ev.replay(spark, sf_dir), "purchase"), ["user_id"]).drop("late", "pending")


@query("""SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type = 'error'""")
def stream_retry_log(spark, sf_dir):
    """An append-only log of the events that ask for a retry."""
    stream = ev.replay(spark, sf_dir, TRIGGERS).where("event_type = 'error'").select("event_id", "user_id", "value")
    return ev.upsert(stream, ["event_id"], mode="append").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""SELECT event_id AS step, round(value, 6) AS value FROM events""")
def stream_metrics(spark, sf_dir):
    """An append-only log of scalar metrics as JSON lines; a step that is sent again is not logged twice."""
    both = ev.replay(spark, sf_dir, TRIGGERS).unionByName(ev.replay(spark, sf_dir, TRIGGERS))
    line = F.to_json(F.struct(F.col("event_id").alias("step"), "value"))
    log = ev.upsert(ev.once(both, ["event_id"], ev.span(spark, sf_dir)).select("event_id", line.alias("line")), ["event_id"], mode="append")
    return log.select(F.from_json("line", "step long, value double").alias("r")).select("r.step", F.round("r.value", 6).alias("value"))
