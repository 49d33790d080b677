"""Sequence queries: events of a user are the frames of an episode."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.shared import written
from episodica.sources.tables import frames, table

USER = ["user_id"]
_RUNS = """marked AS (SELECT *, value > {level} AS flag FROM frames),
starts AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM marked WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY frame_index) AS island FROM starts),
runs AS (SELECT user_id, island, min(frame_index) AS start, max(frame_index) + 1 AS "end" FROM islands WHERE flag GROUP BY ALL)"""


@query(f"""WITH {FRAMES_SQL}, {_RUNS.format(level=60)}
SELECT user_id, start::BIGINT AS onset, ("end" - start)::BIGINT AS length FROM runs WHERE "end" - start >= 2""")
def grasp_onsets(spark, sf_dir):
    """Onsets of runs of at least two frames above a level."""
    found = seq.runs(frames(spark, sf_dir), F.col("value") > 60, USER)
    return found.where(F.col("end") - F.col("start") >= 2).select("user_id", F.col("start").alias("onset"), (F.col("end") - F.col("start")).alias("length"))


@query(f"""WITH {FRAMES_SQL}, span AS (SELECT user_id, quantile_cont(value, 0.02) + greatest(1.5, 0.08 * (quantile_cont(value, 0.98) - quantile_cont(value, 0.02))) AS level FROM frames GROUP BY 1),
f2 AS (SELECT f.*, value > level AS flag FROM frames f JOIN span USING (user_id)),
starts AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM f2 WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY frame_index) AS island FROM starts),
runs AS (SELECT user_id, island, min(frame_index) AS start, max(frame_index) + 1 AS "end" FROM islands WHERE flag GROUP BY ALL),
far AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY user_id ORDER BY start) >= 3, TRUE) THEN 1 ELSE 0 END AS n FROM runs),
grp AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start) AS g FROM far)
SELECT user_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM grp GROUP BY user_id, g HAVING max("end") - min(start) >= 3""")
def holds_merged(spark, sf_dir):
    """Runs above a level that adapts to the episode's span; near runs merge, short ones go last."""
    f = frames(spark, sf_dir)
    ends = seq.quantiles(table(spark, sf_dir, "events"), USER, "value", {"low": 0.02, "high": 0.98})
    level = ends.select("user_id", (F.col("low") + F.greatest(F.lit(1.5), 0.08 * (F.col("high") - F.col("low")))).alias("level"))
    found = seq.runs(f.join(level, "user_id"), F.col("value") > F.col("level"), USER)
    return seq.merge_runs(found, USER, 3).where(F.col("end") - F.col("start") >= 3)


@query(f"""WITH {FRAMES_SQL}, {_RUNS.format(level=60)},
m AS (SELECT user_id, start, "end", floor(("end" - 1 + lead(start) OVER (PARTITION BY user_id ORDER BY start)) / 2) AS b FROM runs)
SELECT user_id, start::BIGINT AS start, b::BIGINT AS boundary FROM m WHERE b IS NOT NULL""")
def segment_midpoints(spark, sf_dir):
    found = seq.runs(frames(spark, sf_dir), F.col("value") > 60, USER)
    return seq.segment_midpoints(found, USER).select("user_id", "start", "boundary")


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS step FROM frames)
SELECT user_id, count(*) AS frames, round(max(abs(step)), 6) AS max_jump, round(max(value) - min(value), 6) AS peak_to_peak,
       round(quantile_cont(abs(step), 0.99), 6) AS jump_p99 FROM d GROUP BY 1""")
def first_difference_jump(spark, sf_dir):
    d = written(frames(spark, sf_dir).select("user_id", "value", F.abs(seq.difference("value", USER)).alias("step")), "steps")
    plain = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("step"), 6).alias("max_jump"), F.round(F.max("value") - F.min("value"), 6).alias("peak_to_peak"))
    return plain.join(seq.quantiles(d, USER, "step", {"p": 0.99}).select("user_id", F.round("p", 6).alias("jump_p99")), "user_id", "left")


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS step FROM frames),
a AS (SELECT user_id, count(*) AS n, max(value) - min(value) AS ptp, max(abs(step)) AS jump FROM d GROUP BY 1)
SELECT user_id, n AS frames, CASE WHEN n < 60 THEN 'short' WHEN ptp < 50 THEN 'still' WHEN jump > 250 THEN 'jump' END AS reason FROM a""")
def bad_episode_ladder(spark, sf_dir):
    """Why an episode is bad: short before still before jump."""
    a = frames(spark, sf_dir).withColumn("step", seq.difference("value", USER)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frames"), (F.max("value") - F.min("value")).alias("ptp"), F.max(F.abs("step")).alias("jump")
    )
    reason = F.when(F.col("frames") < 60, "short").when(F.col("ptp") < 50, "still").when(F.col("jump") > 250, "jump")
    return a.select("user_id", "frames", reason.alias("reason"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM frames GROUP BY 1),
k AS (SELECT user_id, n, unnest(range(5)) AS i FROM n)
SELECT user_id, i::INT AS sample, round_even((n - 1) * i / 4, 0)::BIGINT AS frame_index FROM k""")
def uniform_frames(spark, sf_dir):
    """Five frames at even steps of each episode, halves rounded to even."""
    n = frames(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = n.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return k.select("user_id", "sample", F.bround((F.col("n") - 1) * F.col("sample") / 4, 0).cast("long").alias("frame_index"))


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT *, value - lag(value) OVER w AS v FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
a AS (SELECT *, v - lag(v) OVER w AS a, CASE WHEN v IS NULL OR lag(v) OVER w IS NULL THEN NULL WHEN sign(v) * sign(lag(v) OVER w) < 0 THEN 1 ELSE 0 END AS r FROM v WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))
SELECT user_id, round(sqrt(avg(v * v)), 4) AS velocity_rms, round(sqrt(avg(a * a)), 4) AS acceleration_rms, coalesce(sum(r), 0)::BIGINT AS reversals,
       round(avg(r), 6) AS reversal_fraction FROM a GROUP BY 1""")
def motion_diagnostics(spark, sf_dir):
    m = seq.motion(frames(spark, sf_dir), "value", USER)
    return m.select("user_id", F.round("velocity_rms", 4).alias("velocity_rms"), F.round("acceleration_rms", 4).alias("acceleration_rms"), "reversals", F.round("reversal_fraction", 6).alias("reversal_fraction"))


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS v FROM frames)
SELECT user_id, round(sqrt(avg(v * v) FILTER (frame_index % 8 = 0)), 4) AS boundary_rms, round(sqrt(avg(v * v) FILTER (frame_index % 8 <> 0)), 4) AS within_rms,
       round(sum(abs(v)), 4) AS path_length, round(var_pop(value), 4) AS variance FROM d GROUP BY 1""")
def boundary_steps(spark, sf_dir):
    """Root mean square of steps on and between block boundaries, path length and population variance."""
    d = frames(spark, sf_dir).withColumn("v", seq.difference("value", USER))
    at = F.col("frame_index") % 8 == 0
    square = F.col("v") * F.col("v")
    return d.groupBy("user_id").agg(
        F.round(F.sqrt(F.avg(F.when(at, square))), 4).alias("boundary_rms"), F.round(F.sqrt(F.avg(F.when(~at, square))), 4).alias("within_rms"),
        F.round(F.sum(F.abs("v")), 4).alias("path_length"), F.round(F.var_pop("value"), 4).alias("variance"),
    )


@query(f"""WITH {FRAMES_SQL} SELECT user_id, arg_min(frame_index + 1, value * 1e6 + frame_index)::BIGINT AS argmin_position, round(min(value), 6) AS min_value,
       arg_max(frame_index + 1, value * 1e6 - frame_index)::BIGINT AS argmax_position, round(max(value), 6) AS max_value FROM frames GROUP BY 1""")
def argmin_argmax_position(spark, sf_dir):
    """Position from 1 of the first least and the first greatest value."""
    f = frames(spark, sf_dir).where("value is not null")
    return f.groupBy("user_id").agg(
        (F.min_by("frame_index", F.struct("value", "frame_index")) + 1).alias("argmin_position"), F.round(F.min("value"), 6).alias("min_value"),
        (F.max_by("frame_index", F.struct("value", -F.col("frame_index"))) + 1).alias("argmax_position"), F.round(F.max("value"), 6).alias("max_value"),
    )


@query(f"""WITH {FRAMES_SQL}, {_RUNS.format(level=30)},
h AS (SELECT user_id, min(start) AS first_start, count(*) AS n FROM runs GROUP BY 1),
l AS (SELECT f.user_id, min(frame_index) AS loss FROM frames f JOIN h USING (user_id) WHERE frame_index > first_start AND NOT value > 30 GROUP BY 1)
SELECT h.user_id, h.n AS intervals, (h.first_start + 1)::BIGINT AS first_held, (l.loss + 1)::BIGINT AS first_loss FROM h LEFT JOIN l USING (user_id)""")
def held_intervals(spark, sf_dir):
    """Number of held intervals, the first held frame and the first loss after it, from 1."""
    f = frames(spark, sf_dir)
    h = seq.runs(f, F.col("value") > 30, USER).groupBy("user_id").agg(F.min("start").alias("first_start"), F.count(F.lit(1)).alias("intervals"))
    loss = f.join(h, "user_id").where((F.col("frame_index") > F.col("first_start")) & ~(F.col("value") > 30)).groupBy("user_id").agg(F.min("frame_index").alias("loss"))
    return h.join(loss, "user_id", "left").select("user_id", "intervals", (F.col("first_start") + 1).alias("first_held"), (F.col("loss") + 1).alias("first_loss"))


@query(f"""WITH RECURSIVE {FRAMES_SQL}, e AS (
  SELECT user_id, frame_index, value, value AS ema FROM frames WHERE frame_index = 0
  UNION ALL SELECT f.user_id, f.frame_index, f.value, e.ema + 0.3 * (f.value - e.ema) FROM e JOIN frames f ON f.user_id = e.user_id AND f.frame_index = e.frame_index + 1)
SELECT user_id, frame_index, round(ema, 9) AS ema FROM e""")
def ema_smoothing(spark, sf_dir):
    """Smoothed values; the state a range of frames is entered with is a sum of another order, so the last bits may differ."""
    return seq.ema(frames(spark, sf_dir), "value", USER, 0.3).select("user_id", "frame_index", F.round("ema", 9).alias("ema"))


@query(f"""WITH {FRAMES_SQL}, b AS (SELECT user_id, max(CASE WHEN NOT value > 10 THEN frame_index END) AS bad, max(frame_index) AS last FROM frames GROUP BY 1)
SELECT user_id, (last - coalesce(bad, -1))::BIGINT AS suffix, (last + 1)::BIGINT AS frames FROM b""")
def trailing_suffix(spark, sf_dir):
    return seq.trailing_suffix(frames(spark, sf_dir), F.col("value") > 10, USER)


@query(f"""WITH {FRAMES_SQL}, {_RUNS.format(level=30)}
SELECT user_id, round(max("end" - start) * 0.02, 6) AS longest_s, coalesce(bool_or(("end" - start) * 0.02 > 0.1), FALSE) AS too_long FROM runs GROUP BY 1""")
def contact_duration_runs(spark, sf_dir):
    """The longest continuous contact of an episode at 50 frames a second, against a limit of 0.1 s."""
    seconds = (F.col("end") - F.col("start")) * 0.02
    return seq.runs(frames(spark, sf_dir), F.col("value") > 30, USER).groupBy("user_id").agg(F.round(F.max(F.col("end") - F.col("start")) * 0.02, 6).alias("longest_s"), F.bool_or(seconds > 0.1).alias("too_long"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT user_id, event_type, frame_index, value > 30 AS f, lag(value > 30, 1, FALSE) OVER (PARTITION BY user_id, event_type ORDER BY frame_index) AS p FROM frames)
SELECT user_id, event_type, frame_index, CASE WHEN f THEN 'grasp' ELSE 'release' END AS event FROM s WHERE f <> p""")
def edge_events(spark, sf_dir):
    """Changes of each object's flag, false before the first frame."""
    return seq.state_changes(frames(spark, sf_dir), F.col("value") > 30, ["user_id", "event_type"]).select("user_id", "event_type", "frame_index", "event")


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT user_id, max(frame_index) AS last FROM frames GROUP BY 1),
e AS (SELECT user_id, frame_index FROM frames WHERE event_type = 'purchase'),
c AS (SELECT user_id, least(greatest(frame_index + o, 0), last) AS frame_index, 'event' AS reason, 0 AS k FROM e JOIN n USING (user_id), (VALUES (-6), (-3), (0), (3), (6)) t(o)
  UNION ALL SELECT user_id, i, 'filler', 1 FROM (SELECT user_id, unnest(range(0, last + 1, 20)) AS i FROM n)
  UNION ALL SELECT user_id, i, 'end', 2 FROM (SELECT user_id, unnest(range(greatest(last - 20, 0), last + 1, 5)) AS i FROM n)),
d AS (SELECT user_id, frame_index, reason, min(k) AS k FROM c GROUP BY ALL),
o AS (SELECT *, count(*) OVER (PARTITION BY user_id, frame_index) AS m FROM d)
SELECT user_id, frame_index::BIGINT AS frame_index, string_agg(reason, '+' ORDER BY k) AS reasons FROM o WHERE m = 1 OR reason <> 'filler' GROUP BY 1, 2""")
def frame_selection(spark, sf_dir):
    """Frames around events, at even steps, and near the end, with their reasons; a filler counts only alone."""
    i, last = F.col("frame_index"), F.col("last")
    f = frames(spark, sf_dir).withColumn("last", F.max("frame_index").over(Window.partitionBy("user_id")))
    named = lambda frame, k, reason: F.struct(frame.cast("long").alias("frame_index"), F.lit(k).alias("k"), F.lit(reason).alias("reason"))
    around = F.transform(F.array(*[F.lit(o) for o in (-6, -3, 0, 3, 6)]), lambda o: named(F.least(F.greatest(i + o, F.lit(0)), last), 0, "event"))
    near_end = (i >= last - 20) & ((i - F.greatest(last - 20, F.lit(0))) % 5 == 0)
    none = F.array().cast("array<struct<frame_index:bigint,k:int,reason:string>>")
    found = F.concat(F.when(F.col("event_type") == "purchase", around).otherwise(none), F.when(i % 20 == 0, F.array(named(i, 1, "filler"))).otherwise(none), F.when(near_end, F.array(named(i, 2, "end"))).otherwise(none))
    rows = f.select("user_id", F.explode(found).alias("x")).select("user_id", "x.*")
    whole = rows.groupBy("user_id", "frame_index").agg(F.array_sort(F.collect_set(F.struct("k", "reason"))).alias("s"))
    kept = F.when(F.size("s") > 1, F.filter("s", lambda x: x["reason"] != "filler")).otherwise(F.col("s"))
    return whole.select("user_id", "frame_index", F.array_join(F.transform(kept, lambda x: x["reason"]), "+").alias("reasons"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM frames GROUP BY 1),
b AS (SELECT user_id, n, k AS fraction_index, least(greatest(8 + 16 * round_even((n * f - 8) / 16, 0), 8), 8 + 16 * greatest(floor((n - 16) / 16), 0)) AS boundary
  FROM n, (VALUES (0, 0.1), (1, 0.3), (2, 0.5), (3, 0.7), (4, 0.9)) t(k, f))
SELECT user_id, boundary::BIGINT AS boundary, min(fraction_index)::INT AS fraction_index FROM b GROUP BY 1, 2""")
def phase_boundaries(spark, sf_dir):
    """Boundaries of a grid nearest to fractions of an episode; the first fraction keeps a shared one."""
    n = frames(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    f = F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])
    x = n.select("user_id", "n", F.posexplode(f).alias("fraction_index", "f"))
    near = 8 + 16 * F.bround((F.col("n") * F.col("f") - 8) / 16, 0)
    top = 8 + 16 * F.greatest(F.floor((F.col("n") - 16) / 16), F.lit(0))
    b = F.least(F.greatest(near, F.lit(8.0)), top.cast("double")).cast("long")
    return x.withColumn("boundary", b).groupBy("user_id", "boundary").agg(F.min("fraction_index").alias("fraction_index"))


@query(f"""WITH {FRAMES_SQL}, a AS (SELECT user_id, frame_index, sum(value) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM frames)
SELECT user_id, frame_index, round(s, 6) AS smooth FROM a""")
def five_tap_mean(spark, sf_dir):
    """Mean of five taps with zeros outside the episode."""
    w = seq.by(USER).rowsBetween(-2, 2)
    return frames(spark, sf_dir).select("user_id", "frame_index", F.round(F.sum("value").over(w) / 5, 6).alias("smooth"))


@query(f"""WITH RECURSIVE {FRAMES_SQL}, t AS (SELECT user_id, frame_index AS i, sum(value) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS x FROM frames),
p AS (SELECT user_id, (max(x) - min(x)) * 0.25 AS span, max(i) AS last FROM t GROUP BY 1),
f AS (SELECT user_id, -1::BIGINT AS i, '-inf'::DOUBLE AS peak, NULL::BIGINT AS start, NULL::DOUBLE AS low, NULL::BIGINT AS cycle, span, last FROM p
  UNION ALL SELECT f.user_id, t.i, CASE WHEN f.start IS NOT NULL AND x > low + span THEN x ELSE greatest(peak, x) END, CASE WHEN f.start IS NULL AND greatest(peak, x) - x > span THEN t.i WHEN f.start IS NOT NULL AND x > low + span THEN NULL ELSE f.start END,
    CASE WHEN f.start IS NULL AND greatest(peak, x) - x > span THEN x ELSE low END, CASE WHEN f.start IS NOT NULL AND x > low + span THEN f.start END, span, last FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)
SELECT user_id, cycle AS start, i AS "end" FROM f WHERE cycle IS NOT NULL UNION ALL SELECT user_id, start, -1 FROM f WHERE i = last AND start IS NOT NULL""")
def hysteresis_cycles(spark, sf_dir):
    """Cycles of a hysteresis; one that never opens again ends at -1."""
    return seq.hysteresis_cycles(frames(spark, sf_dir), "value", USER).select("user_id", "start", F.coalesce("end", F.lit(-1)).alias("end"))


@query("""SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::BIGINT AS new_index, p_brand FROM part""")
def episode_renumber(spark, sf_dir):
    """New numbers from 0 within a dataset, in the old order."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(w) - 1).cast("long").alias("new_index"), "p_brand")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT d.doc_id, d.source, (o.base + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1)::BIGINT AS global_index FROM documents d JOIN o USING (source)""")
def global_reindex(spark, sf_dir):
    """One running index over datasets in order: an offset for each, and a place within."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # a row for each dataset; the window below runs over these
    offsets = sizes.select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.join(offsets, "source").select("doc_id", "source", (F.col("base") + F.row_number().over(w) - 1).cast("long").alias("global_index"))


@query("""WITH old AS (SELECT l_orderkey, min(l_linenumber) AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1),
numbered AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS number FROM old),
m AS (SELECT coalesce(max(number), 0) AS m FROM numbered),
fresh AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM old)),
added AS (SELECT l_orderkey, m + row_number() OVER (ORDER BY l_orderkey) AS number FROM fresh, m)
SELECT l_orderkey, number::BIGINT AS number, FALSE AS added FROM numbered UNION ALL SELECT l_orderkey, number::BIGINT, TRUE FROM added""")
def append_only_numbering(spark, sf_dir):
    """Numbers already given stay; new keys follow the greatest one in key order.

    Ranks are global, so keys are ranked inside ranges of the key and shifted by the sizes of the ranges before.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    old = line.where("l_shipdate < TIMESTAMP_NTZ '1996-01-01'").select("l_orderkey").distinct()
    fresh = line.select("l_orderkey").distinct().join(old, "l_orderkey", "left_anti")
    tagged = old.withColumn("added", F.lit(False)).union(fresh.withColumn("added", F.lit(True)))
    return seq.global_rank(tagged, ["added", "l_orderkey"], "number").select("l_orderkey", "number", "added")
