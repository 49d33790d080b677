"""Reports: screening rows, workflow counts, comparisons of runs and overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.shared import dealt, written
from episodica.sources.tables import frames, table


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_index)) AS step FROM frames),
e AS (SELECT user_id, count(*) / 4.0 AS s, max(step) AS jump, max(value) - min(value) AS ptp FROM d GROUP BY 1)
SELECT user_id % 3 AS dataset, count(*) AS episodes, round(min(s), 1) AS shortest, round(median(s), 1) AS middle, round(max(s), 1) AS longest, round(quantile_cont(jump, 0.99), 4) AS jump, count(*) FILTER (ptp < 100) AS still FROM e GROUP BY 1""")
def screening_row(spark, sf_dir):
    """One row of measures for each dataset."""
    d = frames(spark, sf_dir).withColumn("step", F.abs(seq.difference("value", ["user_id"])))
    e = d.groupBy("user_id").agg((F.count(F.lit(1)) / 4).alias("s"), F.max("step").alias("jump"), (F.max("value") - F.min("value")).alias("ptp"))
    e = written(e.withColumn("dataset", F.col("user_id") % 3), "episodes")
    plain = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("episodes"), F.round(F.min("s"), 1).alias("shortest"), F.round(F.max("s"), 1).alias("longest"), F.count_if(F.col("ptp") < 100).alias("still"))
    middle = seq.quantiles(e.withColumn("s", F.col("s").cast("double")), ["dataset"], "s", {"q": 0.5}).select("dataset", F.round("q", 1).alias("middle"))
    jump = seq.quantiles(e, ["dataset"], "jump", {"q": 0.99}).select("dataset", F.round("q", 4).alias("jump"))
    return plain.join(middle, "dataset", "left").join(jump, "dataset", "left")


@query("""WITH k AS (SELECT o_orderpriority || '/' || o_orderstatus AS key FROM orders) SELECT key, count(*) AS n FROM k GROUP BY 1""")
def frequency_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT conv_id, list_distinct(list(role)) AS seen, arg_max(role, turn) AS last, count(*) AS n FROM conversations GROUP BY 1)
SELECT last AS state, count(*) AS records, count(*) FILTER (list_contains(seen, 'assistant')) AS answered, count(*) FILTER (n > 4) AS long FROM s GROUP BY 1""")
def workflow_counts(spark, sf_dir):
    """Histogram of last states with conditional counters."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("seen"), F.max_by("role", "turn").alias("last"), F.count(F.lit(1)).alias("n"))
    return s.groupBy(F.col("last").alias("state")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.array_contains("seen", "assistant")).alias("answered"), F.count_if(F.col("n") > 4).alias("long"))


@query("""WITH r AS (SELECT p_brand, p_size % 50 AS seed, p_retailprice > 1200 AS ok, CASE WHEN p_retailprice <= 1000 THEN 'grasp' WHEN p_retailprice <= 1200 THEN 'settle' END AS reason FROM part)
SELECT p_brand, count(DISTINCT seed) = 50 AS complete, round(avg(ok::INT), 6) AS rate, count(*) FILTER (reason = 'grasp') AS grasp, count(*) FILTER (reason = 'settle') AS settle FROM r GROUP BY 1""")
def qualification_summary(spark, sf_dir):
    price = F.col("p_retailprice")
    reason = F.when(price <= 1000, "grasp").when(price <= 1200, "settle")
    r = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 50).alias("seed"), (price > 1200).alias("ok"), reason.alias("reason"))
    return r.groupBy("p_brand").agg((F.count_distinct("seed") == 50).alias("complete"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"), F.count_if(F.col("reason") == "grasp").alias("grasp"), F.count_if(F.col("reason") == "settle").alias("settle"))


@query("""WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) AS reviewed FROM orders GROUP BY 1)
SELECT n.n_name AS task, coalesce(sum(reviewed), 0)::BIGINT AS reviewed, coalesce(sum(accepted), 0)::BIGINT AS accepted, count(c_custkey) AS available FROM nation n LEFT JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN a ON o_custkey = c_custkey GROUP BY 1""")
def curation_index(spark, sf_dir):
    """Reviewed, accepted and available for every task, empty ones included."""
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("accepted"), F.count(F.lit(1)).alias("reviewed"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(a, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.groupBy("c_nationkey").agg(F.sum("reviewed").alias("r"), F.sum("accepted").alias("a"), F.count("c_custkey").alias("v"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("task"), zero(F.col("r")).alias("reviewed"), zero(F.col("a")).alias("accepted"), zero(F.col("v")).alias("available"))


@query("""WITH d AS (SELECT l_orderkey AS k, l_partkey AS id, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.k, a.id, sum(1 / (1 + abs(a.v - b.v))) AS s FROM d a JOIN d b ON a.k = b.k AND a.id <> b.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(s, 9) DESC, id) AS j FROM p)
SELECT k, id FROM r WHERE j = 1""")
def medoid(spark, sf_dir):
    """The draft that agrees most with the others; a record has few drafts."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("v"))
    d = dealt(line, "k").groupBy("k", "id").agg(F.min("v").alias("v"))  # all that follows is by record, where it lies
    a, b = d.alias("a"), d.alias("b")
    p = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") != F.col("b.id"))).groupBy("a.k", "a.id").agg(F.round(F.sum(1 / (1 + F.abs(F.col("a.v") - F.col("b.v")))), 9).alias("s"))
    return p.groupBy("k").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("id"))


@query("""SELECT conv_id, bool_and(length(text) > 20) AS all_long, string_agg(role || ':' || turn, ';' ORDER BY turn) FILTER (length(text) <= 60) AS issues FROM conversations GROUP BY 1""")
def check_merge(spark, sf_dir):
    """Checks merged by AND, issues joined with their tag."""
    issues = F.array_sort(F.collect_list(F.when(F.length("text") <= 60, F.struct("turn", "role"))))
    joined = F.array_join(F.transform(issues, lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ";")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 20).alias("all_long"), F.nullif(joined, F.lit("")).alias("issues"))


@query("""WITH i AS (SELECT doc_id, n_chars AS size FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 17 <> 0), l AS (SELECT doc_id FROM labels)
SELECT i.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN r.size <> 0 AND r.size <> i.size THEN 'size' WHEN l.doc_id IS NULL THEN 'remote only' ELSE 'ok' END AS state FROM i LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)""")
def three_way_inventory(spark, sf_dir):
    """An inventory against a remote and a local listing; a size of 0 is unknown."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"))
    remote = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("r"), F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("rs"))
    local = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"))
    j = d.join(remote, F.col("doc_id") == F.col("r"), "left").join(local, F.col("doc_id") == F.col("l"), "left")
    return j.select("doc_id", F.when(F.col("r").isNull(), "missing").when((F.col("rs") != 0) & (F.col("rs") != F.col("size")), "size").when(F.col("l").isNull(), "remote only").otherwise("ok").alias("state"))


@query("""WITH o AS (SELECT o_orderkey, sum(o_orderkey % 3) OVER (ORDER BY o_orderkey) - o_orderkey % 3 AS off, o_orderkey % 3 AS n FROM orders)
SELECT unnest(range(off::BIGINT, (off + n)::BIGINT)) AS contact, o_orderkey FROM o""")
def ragged_offsets(spark, sf_dir):
    """Contacts of each row from offsets: the row is repeated as often as its offsets differ, no range join needed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("n"))
    ends = seq.running_sum(o, ["o_orderkey"], "n", "end").where("n > 0")
    return ends.select(F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("contact"), "o_orderkey")


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_quantity) * (CASE WHEN l_orderkey % 50 = 0 THEN 1.1 ELSE 1.0 END) AS x FROM lineitem GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (abs(a.x - b.x) > 1e-6) AS off, round(max(abs(a.x - b.x)), 6) AS worst, round(sqrt(sum((a.x - b.x) * (a.x - b.x)) / sum(a.x * a.x)), 6) AS relative, max(abs(a.x - b.x)) <= 0.02 AS ok FROM a JOIN b USING (k)""")
def run_comparison(spark, sf_dir):
    """Two runs joined by key against tolerances."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("x"))
    b = a.select("k", (F.col("x") * F.when(F.col("k") % 50 == 0, 1.1).otherwise(1.0)).alias("y"))
    d = F.abs(F.col("x") - F.col("y"))
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 1e-6).alias("off"), F.round(F.max(d), 6).alias("worst"), F.round(F.sqrt(F.sum(d * d) / F.sum(F.col("x") * F.col("x"))), 6).alias("relative"), (F.max(d) <= 0.02).alias("ok"))


@query("""WITH v AS (SELECT doc_id, quality AS one FROM labels), a AS (SELECT doc_id, 1 - quality AS two FROM labels WHERE doc_id % 5 = 0), x AS (SELECT doc_id, 2 AS fix FROM documents WHERE doc_id % 9 = 0)
SELECT d.doc_id, coalesce(fix, two, one, -1)::INT AS value, CASE WHEN fix IS NOT NULL THEN 'fix' WHEN two IS NOT NULL THEN 'second' WHEN one IS NOT NULL THEN 'first' ELSE 'none' END AS source FROM documents d LEFT JOIN v USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)""")
def overlay_precedence(spark, sf_dir):
    """A fix over a second verdict over a first."""
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id")
    j = d.join(l.select("doc_id", F.col("quality").alias("one")), "doc_id", "left").join(l.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("two")), "doc_id", "left")
    j = j.join(d.where("doc_id % 9 = 0").select("doc_id", F.lit(2).alias("fix")), "doc_id", "left")
    source = F.when(F.col("fix").isNotNull(), "fix").when(F.col("two").isNotNull(), "second").when(F.col("one").isNotNull(), "first").otherwise("none")
    return j.select("doc_id", F.coalesce("fix", "two", "one", F.lit(-1)).alias("value"), source.alias("source"))


@query("""WITH i AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), j AS (SELECT conv_id, turn - 1 AS turn, length(text) AS judge FROM conversations WHERE role = 'assistant')
SELECT i.conv_id, i.turn, CASE WHEN judge IS NULL THEN 'missing' WHEN judge > 200 THEN 'accept' ELSE 'reject' END AS verdict FROM i LEFT JOIN j USING (conv_id, turn)""")
def two_hop_verdicts(spark, sf_dir):
    """Items with their judgement, those without one listed as missing."""
    c = table(spark, sf_dir, "conversations")
    j = c.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max(F.length("text")).alias("judge"))
    i = c.where("role = 'user'").select("conv_id", "turn")
    return i.join(j, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("judge").isNull(), "missing").when(F.col("judge") > 200, "accept").otherwise("reject").alias("verdict"))


@query("""WITH g AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS good FROM orders)
SELECT o_custkey, o_orderkey FROM g WHERE k > 4 AND k <= 7 AND good < 6""")
def round_slice(spark, sf_dir):
    """The next round of each group that is short of its target."""
    w = Window.partitionBy("o_custkey")
    g = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("k"), F.count_if(F.col("o_orderstatus") == "F").over(w).alias("good"))
    return g.where("k > 4 and k <= 7 and good < 6").select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('floor|' || doc_id)) AS k, greatest(1, floor(count(*) OVER () * 0.03)) AS n FROM documents) SELECT doc_id FROM d WHERE k <= n""")
def sample_with_floor(spark, sf_dir):
    """Three in a hundred by hash order, one at least: ranks by range, not in one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("floor|"), F.col("doc_id").cast("string")), 256).alias("h"))
    n = max(1, int(d.count() * 0.03))
    return seq.global_rank(d, ["h"], "k").where(F.col("k") <= n).select("doc_id")


@query("""SELECT o_orderstatus AS outcome, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 UNION ALL SELECT 'replaced', count(*), round(avg(o_totalprice), 4) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000""")
def import_outcomes(spark, sf_dir):
    """Imported verdicts by outcome, and those that are replaced."""
    o = table(spark, sf_dir, "orders")
    part = lambda df, k: df.groupBy(k.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    again = o.where("o_orderstatus = 'P' AND o_totalprice > 100000").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return part(o, F.col("o_orderstatus")).unionByName(again.select(F.lit("replaced").alias("outcome"), "n", "mean"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS arm, o_orderstatus FROM orders) SELECT o_orderstatus, count(DISTINCT arm) AS arms, count(DISTINCT o_orderkey % 2) = 1 AS invariant FROM a GROUP BY 1""")
def cross_run_invariants(spark, sf_dir):
    """Whether a key has one value over all arms."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_orderpriority").alias("arms"), (F.count_distinct(F.col("o_orderkey") % 2) == 1).alias("invariant"))


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END AS want FROM conversations)
SELECT conv_id, bool_and(role = want) AS ok, coalesce(min(turn) FILTER (role <> want), -1) AS first_off FROM t GROUP BY 1""")
def provenance_order(spark, sf_dir):
    """Whether every step comes from the source its place asks for."""
    t = F.col("turn")
    want = F.when(t == 0, "system").when(t % 2 == 1, "user").otherwise("assistant")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(F.col("role") == want).alias("ok"), F.coalesce(F.min(F.when(F.col("role") != want, t)), F.lit(-1)).alias("first_off"))


@query("""WITH m AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN sha256(url) ELSE sha256(html) END AS sha FROM pages WHERE page_id % 13 <> 0)
SELECT p.page_id, length(html) > 0 AS present, CASE WHEN m.page_id IS NULL THEN 'unrecorded' WHEN sha256(html) = m.sha THEN 'ok' ELSE 'changed' END AS state FROM pages p LEFT JOIN m USING (page_id)""")
def manifest_check(spark, sf_dir):
    """Text present and of the hash a manifest records for it; some records are stale and some are lacking."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    recorded = F.when(F.col("page_id") % 9 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    m = p.where("page_id % 13 <> 0").select(F.col("page_id").alias("id"), recorded.alias("sha"))
    state = F.when(F.col("id").isNull(), "unrecorded").when(F.sha2("html", 256) == F.col("sha"), "ok").otherwise("changed")
    return p.join(m, F.col("page_id") == F.col("id"), "left").select("page_id", (F.length("html") > 0).alias("present"), state.alias("state"))
