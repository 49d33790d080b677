"""Acceptance gates, structural checks, quarantines and their summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import sequence as seq
from episodica.plans import verification
from episodica.plans.registry import FRAMES_SQL, SQL, query
from episodica.sources.tables import frames, table

_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS names, quantile_cont(abs(value), 0.999) AS p FROM events GROUP BY 1)
SELECT user_id, CASE WHEN names = {[k for k in _KINDS if k != "signup"]} THEN 'old_deg' WHEN names <> {_KINDS} THEN 'none' WHEN p > 101 THEN 'deg' ELSE 'norm' END AS unit FROM u""")
def unit_by_names(spark, sf_dir):
    """The unit of a record by the names of its channels, then by the tail of its values; an unknown set of names has none."""
    e = table(spark, sf_dir, "events")
    p = seq.quantiles(e.select("user_id", F.abs("value").alias("v")), ["user_id"], "v", {"p": 0.999}).select(F.col("user_id").alias("u"), "p")
    names = e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names")).join(p, F.col("user_id") == F.col("u"), "left")
    same = lambda kinds: F.col("names") == F.array(*[F.lit(k) for k in kinds])
    unit = F.when(same([k for k in _KINDS if k != "signup"]), "old_deg").when(~same(_KINDS), "none").when(F.col("p") > 101, "deg").otherwise("norm")
    return names.select("user_id", unit.alias("unit"))


@query("""WITH j AS (SELECT d.doc_id, l.quality AS judged, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE l.toxic END AS confirmed, d.doc_id % 3 AS judge, d.doc_id % 5 AS verifier, d.n_chars % 7 = 0 AS detail, d.n_chars > 150 AS evidence, [d.n_chars % 6, d.doc_id % 6, 4] AS scores, d.doc_id % 10 = 9 AS loose FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT *, CASE WHEN judged IS NULL THEN 'no judge' END AS a, CASE WHEN NOT evidence THEN 'no evidence' END AS b, CASE WHEN detail THEN 'needs detail' END AS c, CASE WHEN judged = 1 AND confirmed IS NULL THEN 'no verifier' END AS d, CASE WHEN judged = 1 AND judge = verifier THEN 'not independent' END AS e, CASE WHEN loose THEN 'scores are no integers' END AS f FROM j)
SELECT doc_id, CASE WHEN judged IS NULL OR NOT evidence OR detail OR loose THEN 'pending' WHEN judged = 0 THEN 'rejected' WHEN confirmed IS NULL OR judge = verifier THEN 'pending' WHEN confirmed = 1 OR list_min(scores) < 2 THEN 'rejected' ELSE 'accepted' END AS verdict, concat_ws(', ', a, b, c, d, e, f) AS problems FROM p""")
def verdict_gates(spark, sf_dir):
    """A judge's verdict through its gates: evidence, detail, an independent verifier who confirms, integer scores above a floor."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k, n = F.col("doc_id"), F.col("n_chars")
    judged, confirmed = F.col("quality"), F.when(k % 4 != 0, F.col("toxic"))
    no_judge, no_evidence, detail, loose = judged.isNull(), ~(n > 150), n % 7 == 0, k % 10 == 9
    dependent = k % 3 == k % 5
    low = F.array_min(F.array(n % 6, k % 6, F.lit(4).cast("long"))) < 2
    verdict = F.when(no_judge | no_evidence | detail | loose, "pending").when(judged == 0, "rejected").when(confirmed.isNull() | dependent, "pending").when((confirmed == 1) | low, "rejected").otherwise("accepted")
    said = [(no_judge, "no judge"), (no_evidence, "no evidence"), (detail, "needs detail"), ((judged == 1) & confirmed.isNull(), "no verifier"), ((judged == 1) & dependent, "not independent"), (loose, "scores are no integers")]
    problems = F.array_join(F.array_compact(F.array(*[F.when(bad, message) for bad, message in said])), ", ")
    return d.select("doc_id", verdict.alias("verdict"), problems.alias("problems"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT user_id, frame_index // 7 AS frame, bool_and(value > 5 AND event_type <> 'error') AS ok, count(*) AS substeps FROM frames GROUP BY 1, 2)
SELECT user_id, count(*) AS frames, count(*) FILTER (ok) AS good, (max(frame) - coalesce(max(frame) FILTER (NOT ok), -1))::BIGINT AS suffix, count(*) FILTER (substeps < 7) AS incomplete FROM s GROUP BY 1""")
def substep_frames(spark, sf_dir):
    """A frame holds if all its substeps do; the frames at the end that hold without a break."""
    s = frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame_index") / 7).alias("frame")).agg(F.bool_and((F.col("value") > 5) & (F.col("event_type") != "error")).alias("ok"), F.count(F.lit(1)).alias("substeps"))
    last_bad = F.coalesce(F.max(F.when(~F.col("ok"), F.col("frame"))), F.lit(-1))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ok").alias("good"), (F.max("frame") - last_bad).alias("suffix"), F.count_if(F.col("substeps") < 7).alias("incomplete"))


@query("""WITH c AS (SELECT l_orderkey AS episode, l_linenumber AS step, row_number() OVER w AS place, max(l_linenumber) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
v AS (SELECT episode, min(place) FILTER (step < before) AS broken, count(*) AS n FROM c GROUP BY 1) SELECT episode, coalesce(broken - 1, n) AS in_order, broken IS NOT NULL AS violated FROM v""")
def required_order(spark, sf_dir):
    """Steps completed before the first that its order forbids; a violation absorbs all that follows."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    before = F.max("l_linenumber").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), F.row_number().over(w).alias("place"), (F.col("l_linenumber") < before).alias("late"))
    v = c.groupBy("episode").agg(F.min(F.when(F.col("late"), F.col("place"))).alias("broken"), F.count(F.lit(1)).alias("n"))
    return v.select("episode", F.coalesce(F.col("broken") - 1, F.col("n")).alias("in_order"), F.col("broken").isNotNull().alias("violated"))


_RECORD = "CASE WHEN o_orderkey % 13 = 0 THEN '{\"id\": ' WHEN o_orderkey % 17 = 0 THEN '[1]' ELSE '{\"id\": ' || o_orderkey || ', \"status\": \"' || CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '\", \"name\": \"' || CASE WHEN o_orderkey % 5 = 0 THEN 'order ' ELSE 'order_' END || o_custkey || '\", \"price\": ' || CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE ', \"parts\": [1, 2]' END || '}' END"


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'no object' ELSE concat_ws('; ', CASE WHEN o_orderkey % 7 = 0 THEN 'status is none of F, O, P' END, CASE WHEN o_orderkey % 5 = 0 THEN 'name does not match' END, CASE WHEN o_orderkey % 11 = 0 THEN 'price is less than 0' END, CASE WHEN o_orderkey % 19 = 0 THEN 'parts lacks' END) END AS errors FROM orders""")
def structural_check(spark, sf_dir):
    """Records held to a schema: an object, with fields of a type, a list of values, a pattern, a range and a least size."""
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RECORD).alias("json"))
    kind = "id long, status string, name string, price double, parts array<long>, _broken string"
    r = r.withColumn("r", F.from_json("json", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    x = lambda name: F.col(f"r.{name}")
    whole = x("_broken").isNull() & F.ltrim("json").startswith("{")
    rules = [
        (x("id").isNull(), "id lacks"), (~x("status").isin("F", "O", "P"), "status is none of F, O, P"), (~x("name").rlike("^order_[0-9]+$"), "name does not match"),
        (x("price") < 0, "price is less than 0"), (F.coalesce(F.size("r.parts"), F.lit(0)) < 1, "parts lacks"),
    ]
    errors = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), message) for bad, message in rules])), "; ")
    return r.select("o_orderkey", F.when(~F.coalesce(whole, F.lit(False)), "no object").otherwise(errors).alias("errors"))


@query("""SELECT s_suppkey AS policy, concat_ws('; ', CASE WHEN NOT (isfinite(s_acctbal) AND s_acctbal >= 0) THEN 'threshold' END, CASE WHEN s_suppkey % 60 < 30 THEN 'settled frames' END, CASE WHEN s_nationkey % 5 = s_suppkey % 5 THEN 'sets overlap' END) AS problems FROM supplier""")
def policy_validation(spark, sf_dir):
    """Policies with thresholds that are finite and not negative, frames enough to settle, and sets apart."""
    bal = F.col("s_acctbal")
    task, other = F.array(F.col("s_nationkey") % 5, F.lit(7)), F.array((F.col("s_suppkey") % 5).cast("int"), F.lit(8))
    rules = [(F.isnan(bal) | (F.abs(bal) == float("inf")) | (bal < 0), "threshold"), (F.col("s_suppkey") % 60 < 30, "settled frames"), (F.arrays_overlap(task, other), "sets overlap")]
    problems = F.array_join(F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules])), "; ")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("policy"), problems.alias("problems"))


@query("""WITH g AS (SELECT c_nationkey AS host, c_custkey % 8 AS index, c_mktsegment AS name, c_acctbal AS memory FROM customer)
SELECT host, count(*) AS gpus, count(DISTINCT index) AS indices, concat_ws('; ', CASE WHEN count(*) <> 8 THEN 'count' END, CASE WHEN count(DISTINCT index) < count(*) THEN 'indices' END, CASE WHEN count(DISTINCT name) > 1 THEN 'names' END, CASE WHEN min(memory) < 0 THEN 'memory' END) AS problems FROM g GROUP BY 1""")
def gpu_contract(spark, sf_dir):
    """Devices of each host: their number, indices, names and memory."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("host")).agg(F.count(F.lit(1)).alias("gpus"), F.count_distinct(F.col("c_custkey") % 8).alias("indices"), F.min("c_mktsegment").alias("a"), F.max("c_mktsegment").alias("z"), F.min("c_acctbal").alias("memory"))
    rules = [(F.col("gpus") != 8, "count"), (F.col("indices") < F.col("gpus"), "indices"), (F.col("a") != F.col("z"), "names"), (F.col("memory") < 0, "memory")]
    problems = F.array_join(F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules])), "; ")
    return g.select("host", "gpus", "indices", problems.alias("problems"))


@query("""WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS seen, arg_max(o_orderstatus, o_orderkey) AS state, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)
SELECT state, count(*) AS records, count(*) FILTER (list_contains(seen, 'P')) AS reviewed, count(*) FILTER (list_contains(seen, 'F') AND NOT urgent) AS human, count(*) FILTER (list_contains(seen, 'O') AND urgent) AS robot FROM s GROUP BY 1""")
def store_counts(spark, sf_dir):
    """Records by their last state, and how many have ever been in others."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("seen"), F.max_by("o_orderstatus", "o_orderkey").alias("state"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    has = lambda k: F.array_contains("seen", k)
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("records"), F.count_if(has("P")).alias("reviewed"), F.count_if(has("F") & ~F.col("urgent")).alias("human"), F.count_if(has("O") & F.col("urgent")).alias("robot"))


@query(f"""WITH a AS ({SQL["physics_audit_full"]}) SELECT "check", count(*) FILTER (NOT ok) AS failed, round(max(measured), 3) AS worst FROM a GROUP BY 1""")
def physics_summary(spark, sf_dir):
    """Episodes that fail each check, and the worst that was measured."""
    a = verification.physics_audit_full(spark, sf_dir)
    return a.groupBy("check").agg(F.count_if(~F.col("ok")).alias("failed"), F.round(F.max("measured"), 3).alias("worst"))


@query(f"""WITH a AS ({SQL["physics_audit_full"]}) SELECT user_id, bool_and(ok) FILTER ("check" NOT IN ('goal', 'settled_success')) AS physics, bool_and(ok) FILTER ("check" = 'goal') AS success, bool_and(ok) AS passed, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT ok), '') AS failed FROM a GROUP BY 1""")
def quality_gate(spark, sf_dir):
    """An episode passes if its physics, its success and all else hold; the checks that fail, sorted."""
    a = verification.physics_audit_full(spark, sf_dir)
    of = lambda test: F.bool_and(F.when(test, F.col("ok")))
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))), ",")
    return a.groupBy("user_id").agg(of(~F.col("check").isin("goal", "settled_success")).alias("physics"), of(F.col("check") == "goal").alias("success"), F.bool_and("ok").alias("passed"), failed.alias("failed"))


@query("""WITH f AS (SELECT doc_id, 1 AS k, 'short' AS tag FROM documents WHERE n_chars < 120 UNION ALL SELECT doc_id, 2, 'poor' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 3, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 4, 'copy' FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1))
SELECT d.doc_id, coalesce(string_agg(tag, ',' ORDER BY k), '') AS tags, CASE WHEN count(tag) = 0 THEN 'clean' WHEN count(tag) FILTER (k IN (2, 3)) > 0 THEN 'quarantine' ELSE 'review' END AS part FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""")
def quarantine_split(spark, sf_dir):
    """Tags of each record in the order of their rules, and the part it goes to."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("sha"))
    twice = d.groupBy("sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(twice, "sha", "left")
    poor, toxic = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    tags = F.array_compact(F.array(F.when(F.col("n_chars") < 120, "short"), F.when(poor, "poor"), F.when(toxic, "toxic"), F.when(F.col("c").isNotNull(), "copy")))
    part = F.when(F.size(tags) == 0, "clean").when(poor | toxic, "quarantine").otherwise("review")
    return j.select("doc_id", F.array_join(tags, ",").alias("tags"), part.alias("part"))


@query("""SELECT source, count(*) AS rows, count(*) FILTER (coalesce(n_chars > 9000, FALSE) OR coalesce(quality = 0, FALSE) OR coalesce(toxic = 1, FALSE)) AS flagged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def audit_flag_count(spark, sf_dir):
    """Rows of which any threshold is passed; a value that lacks passes none."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = [F.coalesce(c, F.lit(False)) for c in (F.col("n_chars") > 9000, F.col("quality") == 0, F.col("toxic") == 1)]
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(flags[0] | flags[1] | flags[2]).alias("flagged"))


@query("""WITH a AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P') AS review, bool_or(o_totalprice > 380000) AS failed, bool_or(o_orderstatus = 'F') AS complete FROM orders GROUP BY 1), l AS (SELECT c_custkey AS k, lower(c_mktsegment) AS status FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(a.k, l.k) AS k, CASE WHEN review THEN 'review' WHEN failed THEN 'failed' WHEN complete THEN 'complete' ELSE coalesce(status, 'unknown') END AS status FROM a FULL JOIN l ON a.k = l.k""")
def ledger_union(spark, sf_dir):
    """All keys of a ledger and of the attempts, with the status that takes precedence."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("review"), F.bool_or(F.col("o_totalprice") > 380000).alias("failed"), F.bool_or(F.col("o_orderstatus") == "F").alias("complete"))
    l = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("status"))
    status = F.when(F.col("review"), "review").when(F.col("failed"), "failed").when(F.col("complete"), "complete").otherwise(F.coalesce("status", F.lit("unknown")))
    return a.join(l, "k", "full").select("k", status.alias("status"))


@query("""WITH a AS (SELECT user_id, event_type AS item, count(*) AS tries, bool_or(value > 150) AS done FROM events GROUP BY 1, 2) SELECT user_id, item, CASE WHEN done THEN 'done' WHEN tries >= 2 THEN 'failed' ELSE 'pending' END AS state, tries FROM a""")
def batch_partition(spark, sf_dir):
    """Items of a batch of two passes: done, failed after both, or still pending."""
    a = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("tries"), F.bool_or(F.col("value") > 150).alias("done"))
    return a.select("user_id", "item", F.when(F.col("done"), "done").when(F.col("tries") >= 2, "failed").otherwise("pending").alias("state"), "tries")


@query("""WITH g AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS i FROM documents) SELECT source, min(i) AS first_row, max(i) AS last_row, count(*) AS rows FROM g GROUP BY 1""")
def episode_bounds(spark, sf_dir):
    """The first and the last global row of each data set."""
    g = seq.global_rank(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], "i")
    return g.groupBy("source").agg((F.min("i") - 1).alias("first_row"), (F.max("i") - 1).alias("last_row"), F.count(F.lit(1)).alias("rows"))
