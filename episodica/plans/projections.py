"""Projection, predicate and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import control, geometry
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.tables import frames, table


@query("""SELECT l_orderkey, round(avg(-110 + 110 + l_discount * 1000 / 100 * 110), 6) AS mean_deg, round(avg(90 - l_quantity), 6) AS mean_old FROM lineitem GROUP BY 1""")
def unit_conversion(spark, sf_dir):
    """Normalised and old degrees to degrees."""
    deg, old = control.from_norm(F.col("l_discount") * 1000, -110.0, 110.0), 90 - F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(deg), 6).alias("mean_deg"), F.round(F.avg(old), 6).alias("mean_old"))


@query("""WITH q AS (SELECT user_id, 5 - quantile_cont(value, 0.005) AS a, 95 - quantile_cont(value, 0.995) AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN greatest(abs(a), abs(b)) <= 40 THEN round(a, 6) END AS off_low, CASE WHEN greatest(abs(a), abs(b)) <= 40 THEN round(b, 6) END AS off_high FROM q""")
def calibration_anchor(spark, sf_dir):
    """Offsets that bring the extremes to their anchors; none if they would be large."""
    q = table(spark, sf_dir, "events").select("user_id", "value")
    q = seq.quantiles(q, ["user_id"], "value", {"low": 0.005, "high": 0.995}).select("user_id", (5 - F.col("low")).alias("a"), (95 - F.col("high")).alias("b"))
    near = F.greatest(F.abs("a"), F.abs("b")) <= 40
    return q.select("user_id", F.when(near, F.round("a", 6)).alias("off_low"), F.when(near, F.round("b", 6)).alias("off_high"))


@query("""SELECT l_returnflag, round(avg((NOT l_quantity BETWEEN 0 AND 50 OR NOT l_discount * 100 BETWEEN -3 AND 8 OR NOT l_tax * 100 BETWEEN -4 AND 7)::INT), 6) AS violation_fraction FROM lineitem GROUP BY 1""")
def joint_limit_fraction(spark, sf_dir):
    """The share of frames with any joint outside its range and slack."""
    values = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    bad = control.joint_violation(values, [(5.0, 45.0), (2.0, 3.0), (1.0, 2.0)])
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(bad.cast("int")), 6).alias("violation_fraction"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.01) - 0.02 AS lo, quantile_cont(value, 0.99) + 0.02 AS hi FROM events GROUP BY 1)
SELECT e.event_id, CASE WHEN value < lo THEN 'low' ELSE 'high' END AS side FROM events e JOIN q USING (event_type) WHERE value < lo OR value > hi""")
def range_gate(spark, sf_dir):
    """Rows outside their channel's quantiles by more than a tolerance."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    q = seq.quantiles(e, ["event_type"], "value", {"a": 0.01, "b": 0.99}).select("event_type", (F.col("a") - 0.02).alias("lo"), (F.col("b") + 0.02).alias("hi"))
    low = F.col("value") < F.col("lo")
    return e.join(q, "event_type").where(low | (F.col("value") > F.col("hi"))).select("event_id", F.when(low, "low").otherwise("high").alias("side"))


@query("""WITH s AS (SELECT p_brand, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part WHERE p_size > 5 GROUP BY 1), g AS (SELECT quantile_cont(p_retailprice, 0.01) AS q1, quantile_cont(p_retailprice, 0.99) AS q9 FROM part),
k AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, round((a - q1) / (q9 - q1), 6) AS low, round((b - q1) / (q9 - q1), 6) AS high FROM k LEFT JOIN s USING (p_brand), g""")
def channel_utilisation(spark, sf_dir):
    """How far each channel uses the range of the quantiles; null if never seen."""
    part = table(spark, sf_dir, "part")
    s = part.where("p_size > 5").groupBy("p_brand").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    g = seq.quantiles(part, [], "p_retailprice", {"q1": 0.01, "q9": 0.99}).first()
    q1, span = F.lit(g["q1"]), F.lit(g["q9"]) - F.lit(g["q1"])  # two numbers
    k = part.select("p_brand").distinct().join(s, "p_brand", "left")
    return k.select("p_brand", F.round((F.col("a") - q1) / span, 6).alias("low"), F.round((F.col("b") - q1) / span, 6).alias("high"))


@query("""SELECT doc_id, (n_chars >= 100 AND lang IN ('en', 'de') AND coalesce(quality, 1) = 1) AS passed FROM documents LEFT JOIN labels USING (doc_id)""")
def frame_check_pass(spark, sf_dir):
    """All flags of a map but the informational ones; no verdict passes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.create_map(F.lit("long"), F.col("n_chars") >= 100, F.lit("lang"), F.col("lang").isin("en", "de"), F.lit("quality"), F.coalesce(F.col("quality") == 1, F.lit(True)), F.lit("issues"), F.lit(False))
    return d.select("doc_id", F.forall(F.map_values(F.map_filter(flags, lambda k, v: k != "issues")), lambda v: v).alias("passed"))


@query("""SELECT conv_id, turn, len([x FOR x IN string_split(lower(text), '. ') IF NOT regexp_matches(x, '(thank|please|sorry|hello)')])::BIGINT AS issues FROM conversations""")
def issue_filter(spark, sf_dir):
    """Issues without those that mention a harmless phrase."""
    issues = F.filter(F.split(F.lower("text"), r"\. "), lambda x: ~x.rlike("(thank|please|sorry|hello)"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(issues).cast("long").alias("issues"))


@query("""WITH s AS (SELECT p_partkey, greatest(640.0 / (p_size * 10), 480.0 / (p_retailprice / 4)) AS k, p_size * 10 AS w, p_retailprice / 4 AS h FROM part)
SELECT p_partkey, ceil(w * k)::BIGINT AS w, ceil(h * k)::BIGINT AS h, floor((ceil(w * k) - 640) / 2)::BIGINT AS x, floor((ceil(h * k) - 480) / 2)::BIGINT AS y FROM s""")
def cover_crop(spark, sf_dir):
    c = control.cover_crop(F.col("p_size") * 10, F.col("p_retailprice") / 4, 640, 480)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


_BOX = "[l_quantity * 8, l_discount * 3000, l_quantity * 8 + 40, l_discount * 3000 + 100 + l_tax * 1000]"


@query(f"""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, {_BOX} AS b FROM lineitem),
g AS (SELECT *, [b[1], 480 - b[3], b[2], 640 - b[4]] AS gaps, (b[1] + b[3]) / 2 AS y, (b[2] + b[4]) / 2 AS x FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice, 2) AS price, ['far', 'near', 'left', 'right'][list_position(gaps, list_min(gaps))] AS edge,
       (CASE WHEN y < 160 THEN 'far' WHEN y < 320 THEN 'middle' ELSE 'near' END) || ' ' || (CASE WHEN x < 640 / 3 THEN 'left' WHEN x < 1280 / 3 THEN 'centre' ELSE 'right' END) || ' ' || round((b[3] - b[1]) * (b[4] - b[2]) / 307200 * 100, 0)::INT || '%' AS region FROM g""")
def box_regions(spark, sf_dir):
    """The edge a box is nearest to, and the third of the frame that holds it."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    b = F.array(q * 8, d * 3000, q * 8 + 40, d * 3000 + 100 + t * 1000)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), b.alias("b"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price", geometry.nearest_edge(F.col("b"), 480, 640).alias("edge"), control.region(F.col("b"), 480, 640).alias("region"))


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'small' END IS NOT NULL AS small, concat_ws(',', CASE WHEN n_chars = 0 THEN 'empty' END, CASE WHEN n_chars < 200 THEN 'small' END, CASE WHEN n_chars > 9000 THEN 'large' END) AS flags FROM documents""")
def coverage_flags(spark, sf_dir):
    n = F.col("n_chars")
    flags = F.array_compact(F.array(F.when(n == 0, "empty"), F.when(n < 200, "small"), F.when(n > 9000, "large")))
    return table(spark, sf_dir, "documents").select("doc_id", (n < 200).alias("small"), F.array_join(flags, ",").alias("flags"))


@query("""WITH done AS (SELECT doc_id, md5(text) AS sha, CASE WHEN doc_id % 7 = 0 THEN 'v1' ELSE 'v2' END AS version FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id, CASE WHEN done.doc_id IS NULL THEN 'run' WHEN done.sha <> md5(d.text) OR done.version <> 'v2' THEN 'again' ELSE 'skip' END AS action FROM documents d LEFT JOIN done USING (doc_id)""")
def resume_predicate(spark, sf_dir):
    """What to run: not done yet, or done from another input or version; a third stands for what was done."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"))
    done = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.col("sha").alias("old"), F.when(F.col("doc_id") % 7 == 0, "v1").otherwise("v2").alias("version"))
    same = F.col("old").eqNullSafe(F.col("sha")) & (F.col("version") == "v2")
    return d.join(done, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.when(F.col("k").isNull(), "run").when(~same, "again").otherwise("skip").alias("action"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM frames GROUP BY 1)
SELECT user_id, round(least(greatest(n / 4.0, 5.0), 15.084), 6) AS seconds, least(15, 5 + 2.5 * greatest(0, n - 2)) AS by_steps, (ceil(n / 2.0) - (ceil(n / 2.0) - 1) % 4)::BIGINT AS latent FROM n""")
def duration_clamps(spark, sf_dir):
    n = F.col("n")
    return frames(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.round(control.clip_seconds(n, 4.0), 6).alias("seconds"), F.least(F.lit(15.0), 5 + 2.5 * F.greatest(F.lit(0), n - 2)).alias("by_steps"), control.latent_frames(n).alias("latent")
    )


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT user_id, count(*) AS n FROM frames GROUP BY 1), i AS (SELECT user_id, n, unnest(range(0, floor(n * 15 / 50)::BIGINT)) AS i FROM n)
SELECT user_id, count(DISTINCT least(floor(i * 50 / 15)::BIGINT, n - 1)) AS kept, sum(DISTINCT least(floor(i * 50 / 15)::BIGINT, n - 1))::BIGINT AS total FROM i GROUP BY 1""")
def rate_resample(spark, sf_dir):
    """Frame indices of a change from 50 to 15 frames a second."""
    n = frames(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    i = n.select("user_id", F.explode(control.resampled(F.col("n"), 50, 15)).alias("i"))
    return i.groupBy("user_id").agg(F.count("i").alias("kept"), F.sum("i").alias("total"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'close' WHEN 'purchase' THEN 'hold' WHEN 'signup' THEN 'open' ELSE 'none' END AS mode FROM events""")
def policy_map(spark, sf_dir):
    modes = F.create_map(*[F.lit(x) for x in ("view", "open", "click", "close", "purchase", "hold", "signup", "open")])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(modes, F.col("event_type")), F.lit("none")).alias("mode"))


@query("""SELECT o_orderkey, o_orderkey > 0 AND (o_orderkey % 500 = 0 OR o_orderkey IN (7, 33)) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS due FROM orders""")
def cadence_predicate(spark, sf_dir):
    """Steps due for validation: on the interval or listed, and not validated yet."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    due = (F.col("o_orderkey") > 0) & ((F.col("o_orderkey") % 500 == 0) | F.col("o_orderkey").isin(7, 33)) & F.col("k").isNull()
    return o.join(done, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", due.alias("due"))


@query("""SELECT event_id, len(list_filter(json_keys(props), lambda k: k IN ('target', 'k', 'secret')))::INT AS leaks FROM events WHERE props IS NOT NULL""")
def leakage_guard(spark, sf_dir):
    """Forbidden keys in a payload."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.size(F.array_intersect(keys, F.array(F.lit("target"), F.lit("k"), F.lit("secret")))).alias("leaks"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN quality = 0 THEN 'reject' WHEN n_chars % 5 = 0 THEN 'pending' WHEN toxic = 0 THEN 'accept' ELSE 'reject' END AS final FROM documents d LEFT JOIN labels l USING (doc_id)""")
def final_verdict_ladder(spark, sf_dir):
    """No judge pends, a failed gate rejects, no verifier pends, then the verifier decides."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    final = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "reject").when(F.col("n_chars") % 5 == 0, "pending").when(F.col("toxic") == 0, "accept").otherwise("reject")
    return d.select("doc_id", final.alias("final"))


@query("""SELECT p_brand, count(*) AS n, round(count(*) FILTER (p_size > 8)::DOUBLE / count(*), 6) AS rate, count(*) >= 30 AND count(*) FILTER (p_size > 8)::DOUBLE / count(*) >= 0.86 AS admitted FROM part GROUP BY 1""")
def admission_gate(spark, sf_dir):
    """Enough runs and a success rate of 43 in 50."""
    rate = F.count_if(F.col("p_size") > 8) / F.count(F.lit(1))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(rate, 6).alias("rate"), ((F.count(F.lit(1)) >= 30) & (rate >= 0.86)).alias("admitted"))


@query("""WITH d AS (SELECT text, count(*) AS c FROM documents GROUP BY 1)
SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 150 THEN 'too_small' END, CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.08 * length(text) THEN 'exposure' END, CASE WHEN c > 1 THEN 'duplicate' END) AS reasons FROM documents JOIN d USING (text)""")
def visual_screen(spark, sf_dir):
    """Reasons to draw a configuration again; duplicates are found by the hash of the content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) > 0.08 * F.length("text")).alias("exposed"))
    twice = d.groupBy("sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    j = d.join(twice, "sha", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 150, "too_small"), F.when(F.col("exposed"), "exposure"), F.when(F.col("c").isNotNull(), "duplicate")))
    return j.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query("""WITH v AS (SELECT event_id, event_type AS verb FROM events) SELECT event_id, CASE WHEN regexp_matches(verb, '(s|x|z|ch|sh|o)$') THEN verb || 'es' WHEN regexp_matches(verb, '[^aeiou]y$') THEN regexp_replace(verb, 'y$', 'ies') ELSE verb || 's' END AS third FROM v""")
def verb_forms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", control.verb_form(F.col("event_type")).alias("third"))


@query("""WITH k AS (SELECT p_partkey, (2000 + p_size * 100) / 100.0 AS t FROM part)
SELECT p_partkey, round(least(greatest((CASE WHEN t <= 66 THEN 255.0 ELSE 329.698727446 * power(t - 60, -0.1332047592) END) / 255, 0), 1), 6) AS r,
       round(least(greatest((CASE WHEN t <= 66 THEN 99.4708025861 * ln(t) - 161.1195681661 ELSE 288.1221695283 * power(t - 60, -0.0755148492) END) / 255, 0), 1), 6) AS g,
       round(least(greatest((CASE WHEN t >= 66 THEN 255.0 WHEN t <= 19 THEN 0.0 ELSE 138.5177312231 * ln(t - 10) - 305.0447927307 END) / 255, 0), 1), 6) AS b FROM k""")
def kelvin_colour(spark, sf_dir):
    c = control.kelvin_rgb((2000 + F.col("p_size") * 100).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", *[F.round(F.col("c")[i], 6).alias(n) for i, n in enumerate("rgb")])


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT *, value - lag(value) OVER w AS v, first_value(value) OVER w AS f FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
a AS (SELECT *, (v - lag(v) OVER (PARTITION BY user_id ORDER BY frame_index)) / 0.02 AS acc FROM s)
SELECT user_id, round(max(abs(value - f)), 6) AS displacement, round(max(abs(acc)), 4) AS acceleration, round(10 * power(0.5, 3) - 15 * power(0.5, 4) + 6 * power(0.5, 5), 6) AS half_way FROM a GROUP BY 1""")
def displacement_from_first(spark, sf_dir):
    """Displacement from an episode's first frame and the greatest acceleration."""
    w = seq.by(["user_id"])
    s = frames(spark, sf_dir).withColumn("v", F.col("value") - F.lag("value").over(w)).withColumn("f", F.first("value").over(w))
    a = s.withColumn("acc", (F.col("v") - F.lag("v").over(w)) / 0.02)
    return a.groupBy("user_id").agg(F.round(F.max(F.abs(F.col("value") - F.col("f"))), 6).alias("displacement"), F.round(F.max(F.abs("acc")), 4).alias("acceleration"), F.round(geometry.min_jerk(F.lit(0.5)), 6).alias("half_way"))
