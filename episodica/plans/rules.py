"""Projection, validation and workflow queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import geometry
from episodica.operators import graphs, ledger, rules
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.shared import dealt
from episodica.sources.tables import frames, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_quantity < 10 AND l_shipdate >= TIMESTAMP '1995-01-01'""")
def scan_pruned_frames(spark, sf_dir):
    """A scan that reads five columns and pushes both filters down."""
    return table(spark, sf_dir, "lineitem").where("l_quantity < 10 AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01'").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("""WITH u AS (SELECT user_id, quantile_cont(abs(value), 0.999) AS p, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n < 20 THEN NULL WHEN p > 101 THEN 'deg' ELSE 'norm' END AS unit FROM u""")
def unit_classifier(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id", F.abs("value").alias("size"))
    sizes = u.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))  # users without a value too
    u = sizes.join(seq.quantiles(u, ["user_id"], "size", {"p": 0.999}).select("user_id", "p"), "user_id", "left")
    return u.select("user_id", F.when(F.col("n") < 20, F.lit(None)).when(F.col("p") > 101, "deg").otherwise("norm").alias("unit"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.01) AS lo, quantile_cont(l_quantity, 0.99) AS hi FROM lineitem GROUP BY 1),
n AS (SELECT l.l_returnflag, (l_quantity - lo) / (hi - lo + 1e-6) * 2 - 1 AS x FROM lineitem l JOIN q USING (l_returnflag))
SELECT l_returnflag, count(*) FILTER (abs(x) > 1) AS over_one, count(*) FILTER (abs(x) > 2) AS over_two, round(min(x), 6) AS low, round(max(x), 6) AS high FROM n GROUP BY 1""")
def minmax_normalise_clip(spark, sf_dir):
    """Values scaled between quantiles, and how many leave the range."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    q = seq.quantiles(line, ["l_returnflag"], "l_quantity", {"lo": 0.01, "hi": 0.99})
    x = geometry.normalise(F.array("l_quantity"), F.array("lo"), F.array("hi"))[0]
    n = line.join(q, "l_returnflag").withColumn("x", x)
    return n.groupBy("l_returnflag").agg(F.count_if(F.abs("x") > 1).alias("over_one"), F.count_if(F.abs("x") > 2).alias("over_two"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F' AND o_totalprice < 20000) THEN 'false' WHEN bool_or(o_orderstatus = 'P') THEN 'unknown' ELSE 'true' END AS accepted FROM orders GROUP BY 1""")
def tri_state_accept(spark, sf_dir):
    """Fail beats unknown beats pass."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 20000)).alias("fail"), F.bool_or(F.col("o_orderstatus") == "P").alias("unknown"))
    return o.select("o_custkey", F.coalesce(rules.tri_state(F.col("fail"), F.col("unknown")).cast("string"), F.lit("unknown")).alias("accepted"))


@query("""WITH j AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT *, CASE WHEN quality IS NULL THEN 'no judge' END AS p1, CASE WHEN n_chars < 200 THEN 'no evidence' END AS p2 FROM j)
SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 0 THEN 'rejected' WHEN n_chars < 200 THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'accepted' END AS verdict, concat_ws(',', p1, p2) AS problems FROM v""")
def verdict_decision(spark, sf_dir):
    """Judge and verifier records to one verdict, with the list of problems."""
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    short = F.col("n_chars") < 200
    verdict = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 0, "rejected").when(short, "pending").when(F.col("toxic") == 1, "rejected").otherwise("accepted")
    problems = F.array_compact(F.array(F.when(F.col("quality").isNull(), "no judge"), F.when(short, "no evidence")))
    return j.select("doc_id", verdict.alias("verdict"), F.array_join(problems, ",").alias("problems"))


_RULES = [("c_acctbal", "c_acctbal >= 0", "negative balance"), ("c_name", "regexp_matches(c_name, '^Customer#[0-9]+$')", "malformed name"), ("c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "unknown segment")]


@query(" UNION ALL ".join(f"SELECT c_custkey AS record, '{p}' AS path, '{m}' AS message FROM customer WHERE NOT ({c})" for p, c, m in _RULES))
def rule_violations(spark, sf_dir):
    """A row for each rule that a record breaks."""
    checks = [(p, F.expr(c.replace("regexp_matches", "rlike")), m) for p, c, m in _RULES]
    return rules.violations(table(spark, sf_dir, "customer"), "c_custkey", checks)


@query("""WITH a AS (SELECT l_orderkey AS record, l_quantity > 0 AND l_discount >= 0.01 AS s1, l_tax < 0.08 AS s2, l_quantity < 49 AS s3, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT record, count(*) FILTER (NOT s1) AS structure, count(*) FILTER (s1 AND NOT (s2 AND s3)) AS content FROM a WHERE NOT (s1 AND s2 AND s3) GROUP BY 1""")
def staged_validation(spark, sf_dir):
    """Rows that break the structure are not held to the rest."""
    line = table(spark, sf_dir, "lineitem").withColumn("line", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"))
    first = [("structure", (F.col("l_quantity") > 0) & (F.col("l_discount") >= 0.01), "structure")]
    second = [("content", (F.col("l_tax") < 0.08) & (F.col("l_quantity") < 49), "content")]
    v = rules.staged(line, "line", [first, second])
    return v.groupBy(F.col("record.l_orderkey").alias("record")).agg(F.count_if(F.col("path") == "structure").alias("structure"), F.count_if(F.col("path") == "content").alias("content"))


_STEPS_SQL = """s AS (SELECT user_id, event_type || strftime(ts, '%H') AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
e AS (SELECT DISTINCT x.user_id AS graph, x.node AS a, y.node AS b FROM s x JOIN s y ON x.user_id = y.user_id AND y.k = x.k + 1),
r AS (SELECT graph, a, b FROM e UNION SELECT r.graph, r.a, e.b FROM r JOIN e ON e.graph = r.graph AND e.a = r.b)"""


def _steps(spark, sf_dir):
    """Of each user, an edge from every event's kind and hour to those of the next one."""
    e = table(spark, sf_dir, "events").withColumn("a", F.concat("event_type", F.date_format("ts", "HH")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("b", F.lead("a").over(w)).where("b is not null").select(F.col("user_id").alias("graph"), "a", "b")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem),
e AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND y.k = x.k + 1),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT 'suppliers' AS graph, a FROM r WHERE a = b""")
def graph_cycle(spark, sf_dir):
    """Suppliers on a cycle of one precedence graph: each line of an order comes before the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey")
    line = line.select(F.lit("suppliers").alias("graph"), F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(w).alias("b"))
    return rules.cyclic_nodes(line.where("b is not null"))


@query(f"""WITH RECURSIVE {_STEPS_SQL}
SELECT x.graph, x.a AS node, min(y.a) AS component FROM r x JOIN r y ON y.graph = x.graph AND y.a = x.b AND y.b = x.a GROUP BY 1, 2""")
def strong_components(spark, sf_dir):
    """Those that can be reached from each other, named by the least of them."""
    return graphs.strong_components(_steps(spark, sf_dir))


@query("""WITH d AS (SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN n_chars < 100 THEN 'drop:error' WHEN quality = 0 THEN 'drop:review' WHEN toxic = 1 AND n_chars > 2000 THEN 'swap' WHEN toxic = 1 THEN 'drop:ambiguous' ELSE 'keep' END AS decision FROM d""")
def drop_swap_decision(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    decision = F.when(F.col("n_chars") < 100, "drop:error").when(F.col("quality") == 0, "drop:review").when((F.col("toxic") == 1) & (F.col("n_chars") > 2000), "swap").when(F.col("toxic") == 1, "drop:ambiguous").otherwise("keep")
    return d.select("doc_id", decision.alias("decision"))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, count(*) AS turns, bool_and(turn = i) AS in_sequence, max(abs(turn - i))::BIGINT AS worst FROM c GROUP BY 1""")
def index_sequence_check(spark, sf_dir):
    """Whether indices run from 0 without a gap."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("i"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("turn") == F.col("i")).alias("in_sequence"), F.max(F.abs(F.col("turn") - F.col("i"))).alias("worst"))


@query("""WITH h AS (SELECT conv_id, turn, role AS new, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations)
SELECT conv_id, turn, old, new, 'illegal' AS problem FROM h WHERE NOT ((old = 'start' AND new = 'system') OR (old = 'system' AND new = 'user') OR (old = 'user' AND new = 'assistant') OR (old = 'assistant' AND new = 'user'))""")
def state_history_legality(spark, sf_dir):
    """Steps of a history that no legal edge allows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role", 1, "start").over(w).alias("old"), F.col("role").alias("new"))
    edges = [("start", "system"), ("system", "user"), ("user", "assistant"), ("assistant", "user")]
    return rules.legal_history(h, "conv_id", ["turn"], "old", "new", edges, "start").select("conv_id", "turn", "old", "new", "problem")


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
b AS (SELECT conv_id, min(turn) FILTER (role = p) AS broken FROM t GROUP BY 1)
SELECT c.conv_id, count(*) FILTER (broken IS NULL OR c.turn < broken) AS in_order, broken IS NOT NULL AS violated FROM conversations c JOIN b USING (conv_id) GROUP BY c.conv_id, broken""")
def ordered_completion(spark, sf_dir):
    """Steps in order until the first violation, which absorbs all that follows: a scan with an automaton."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ok = rules.in_order(c, ["conv_id"], "turn", "role")
    return ok.groupBy("conv_id").agg(F.sum("ok").alias("in_order"), (F.min("ok") == 0).alias("violated"))


@query("""SELECT o_orderkey, ceil(CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN o_totalprice * 0.011 ELSE o_totalprice * 0.013 END * 100 - 1e-9) / 100 AS reserve FROM orders""")
def price_reservation(spark, sf_dir):
    """A price by date, up to whole cents."""
    price = F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"), F.col("o_totalprice") * 0.011).otherwise(F.col("o_totalprice") * 0.013)
    return table(spark, sf_dir, "orders").select("o_orderkey", ledger.reservation_price(price).alias("reserve"))


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) AS tries FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(good, 0) > 5 THEN 'done' WHEN c_acctbal < 0 THEN 'blocked' WHEN coalesce(open, 0) > 8 THEN 'wait' WHEN coalesce(tries, 0) = 0 THEN 'first' WHEN tries < 12 THEN 'retry' ELSE 'exhausted' END AS step FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def next_step_planner(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count(F.lit(1)).alias("tries"))
    c = table(spark, sf_dir, "customer").join(a, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["good", "open", "tries"])
    return c.select("c_custkey", ledger.next_step(F.col("good") > 5, F.col("c_acctbal") < 0, F.col("open") > 8, F.col("tries"), 12).alias("step"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def status_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT o_custkey AS k, arg_max(o_orderstatus, epoch_us(o_orderdate) * 1000000.0 + o_orderkey) AS state, count(*) AS steps FROM orders GROUP BY 1""")
def event_fold_state(spark, sf_dir):
    """The last state of each record's event log."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("state"))
    return ledger.latest_state(o, "k", ["o_orderdate", "o_orderkey"], "state")


@query("""WITH s AS (SELECT doc_id, n_chars AS c FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS c FROM documents WHERE doc_id % 3 <> 0)
SELECT o.doc_id, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN s.c = o.c THEN 'existing' ELSE 'conflict' END AS outcome FROM o LEFT JOIN s USING (doc_id)""")
def immutable_insert(spark, sf_dir):
    """Offered records against those stored, with a fixed half of the ids stored and a tenth changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("c"))
    offered = d.where("doc_id % 3 <> 0").withColumn("c", F.when(F.col("doc_id") % 10 == 0, F.col("c") + 1).otherwise(F.col("c")))
    return ledger.insert_or_conflict(d.where("doc_id % 2 = 0"), offered, "doc_id", "c").select("doc_id", "outcome")


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_index)) / 0.02 AS speed FROM frames),
c AS (SELECT user_id, unnest(['finite', 'joint_ranges', 'joint_speed', 'settled']) AS "check", unnest([bool_and(isfinite(value)), bool_and(value BETWEEN 0 AND 250), coalesce(bool_and(speed <= 10000), TRUE), max(CASE WHEN NOT value > 5 THEN frame_index ELSE -1 END) < max(frame_index) - 1]) AS ok, unnest([max(abs(value)), max(value), max(speed), (max(frame_index) - max(CASE WHEN NOT value > 5 THEN frame_index ELSE -1 END))::DOUBLE]) AS measured FROM v GROUP BY 1)
SELECT user_id, "check", ok, round(measured, 4) AS measured FROM c""")
def physics_audit(spark, sf_dir):
    """Named checks with their extremes for each episode, from one pass over its frames."""
    f = frames(spark, sf_dir).withColumn("speed", F.abs(seq.difference("value", ["user_id"])) / 0.02)
    real = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    last_bad = F.max(F.when(~(F.col("value") > 5), F.col("frame_index")).otherwise(-1))
    a = f.groupBy("user_id").agg(
        F.bool_and(real).alias("finite"), F.bool_and(F.col("value").between(0, 250)).alias("ranges"), F.coalesce(F.bool_and(F.col("speed") <= 10000), F.lit(True)).alias("slow"),
        (last_bad < F.max("frame_index") - 1).alias("settled"), F.max(F.abs("value")).alias("m0"), F.max("value").alias("m1"), F.max("speed").alias("m2"), (F.max("frame_index") - last_bad).cast("double").alias("m3"),
    )
    checks = [("finite", "finite", "m0"), ("joint_ranges", "ranges", "m1"), ("joint_speed", "slow", "m2"), ("settled", "settled", "m3")]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(o).alias("ok"), F.round(m, 4).alias("measured")) for n, o, m in checks])
    return a.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.*")


@query("""WITH q AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS q FROM embeddings), n AS (SELECT vec_id, q, sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3] + q[4] * q[4]) AS l FROM q)
SELECT vec_id, round(1 - 2 * ((q[2] / l) * (q[2] / l) + (q[3] / l) * (q[3] / l)), 6) AS upright, round(2 * acos(least(1.0, abs(q[1] / l))), 6) AS angle FROM n""")
def quaternion_pose(spark, sf_dir):
    """Uprightness and angle of rotation of unit quaternions."""
    q = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q")).withColumn("l", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)))
    u = e.select("vec_id", F.transform("q", lambda v: v / F.col("l")).alias("u"))
    one = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return u.select("vec_id", F.round(geometry.uprightness(F.col("u")), 6).alias("upright"), F.round(geometry.rotation_angle(F.col("u"), one), 6).alias("angle"))
