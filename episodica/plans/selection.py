"""Selection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.operators import selection as sel
from episodica.operators import sequence as seq
from episodica.plans.registry import query
from episodica.sources.shared import written
from episodica.sources.tables import table


@query("""SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, source, doc_id LIMIT 64""")
def topk_multi_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "source", "doc_id").limit(64)


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 2 ELSE 1 END), o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, k AS place FROM r WHERE k <= 3""")
def topk_per_group_priority(spark, sf_dir):
    """Accepted first, deprioritised last, three of each group."""
    klass = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    w = Window.partitionBy("o_custkey").orderBy(klass, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
s AS (SELECT *, unnest(range(0, floor(log2(n))::BIGINT + 1)) AS lv FROM p),
l AS (SELECT p_partkey, p_brand, i, min(lv) AS lv FROM s WHERE i % greatest(floor(n / power(2, lv))::BIGINT, 1) = 0 GROUP BY 1, 2, 3)
SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY lv, i) - 1)::BIGINT AS spread_rank FROM l""")
def spread_bisection(spark, sf_dir):
    return sel.spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"], [F.col("p_partkey")])


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) AS done FROM orders GROUP BY 1)
SELECT o_custkey, least(greatest(ceil((12 - good) / (good::DOUBLE / done) * 1.3), 6), 24)::BIGINT AS need FROM c WHERE good > 0 AND good < 12""")
def adaptive_sample_size(spark, sf_dir):
    """How many more to draw for twelve good ones at the rate so far, with a reserve, within bounds."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count(F.lit(1)).alias("done")).where("good > 0 and good < 12")
    need = F.ceil((12 - F.col("good")) / (F.col("good").cast("double") / F.col("done")) * 1.3)
    return c.select("o_custkey", F.least(F.greatest(need, F.lit(6)), F.lit(24)).cast("long").alias("need"))


@query("""WITH g AS (SELECT o_orderpriority AS task, count(*) FILTER (o_orderstatus = 'F') AS progress FROM orders GROUP BY 1),
q AS (SELECT o_orderkey, o_orderpriority AS task, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderstatus = 'P')::INT DESC, o_orderkey) AS turn FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, task, turn FROM q JOIN g USING (task) ORDER BY turn, progress, task LIMIT 100""")
def round_robin_plan(spark, sf_dir):
    """Turns over tasks, those with the least progress first; retries before new ones."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "task")
    progress = o.groupBy("task").agg(F.count_if(F.col("o_orderstatus") == "F").alias("progress"))
    turns = sel.round_robin(o.where("o_orderstatus <> 'F'"), "task", [F.desc(F.col("o_orderstatus") == "P"), F.col("o_orderkey")])
    return turns.join(progress, "task").orderBy("turn", "progress", "task").limit(100).select("o_orderkey", "task", "turn")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, round(o_totalprice / 1000, 3) AS cost, o_orderstatus = 'P' AS retry, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT k, id, i, CASE WHEN cost > 500 THEN 'hard' WHEN retry AND cost > 150 THEN 'retry' ELSE 'admitted' END AS verdict,
    CASE WHEN cost > 500 OR (retry AND cost > 150) THEN 0 ELSE cost END AS hard, CASE WHEN cost > 500 OR NOT retry OR cost > 150 THEN 0 ELSE cost END AS spent_retry FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.id, o.i, CASE WHEN f.hard + cost > 500 THEN 'hard' WHEN retry AND f.spent_retry + cost > 150 THEN 'retry' ELSE 'admitted' END,
    CASE WHEN f.hard + cost > 500 OR (retry AND f.spent_retry + cost > 150) THEN f.hard ELSE f.hard + cost END, CASE WHEN f.hard + cost > 500 OR NOT retry OR f.spent_retry + cost > 150 THEN f.spent_retry ELSE f.spent_retry + cost END
  FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k, id, verdict FROM f""")
def greedy_budget(spark, sf_dir):
    """Requests admitted in order under a cap on all and a cap on retries."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000, 3).alias("cost"), (F.col("o_orderstatus") == "P").alias("is_retry"))
    return sel.greedy_admit(o, ["k"], ["id"], "cost", {"hard": 500.0, "retry": 150.0}, {"hard": F.lit(True), "retry": F.col("is_retry")})


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k = 1 OR k = n // 2 + 1 OR k = n""")
def first_mid_last(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where((F.col("k") == 1) | (F.col("k") == F.floor(F.col("n") / 2) + 1) | (F.col("k") == F.col("n"))).select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey, ((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 7)::INT AS shard FROM part""")
def shard_round_robin(spark, sf_dir):
    """Sorted names dealt to seven shards in turn."""
    ranked = seq.global_rank(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "place")
    return ranked.select("p_partkey", F.pmod(F.col("place") - 1, F.lit(7)).cast("int").alias("shard"))


@query("""WITH n AS (SELECT count(*) AS n FROM nation), r AS (SELECT unnest(range(0, ceil(n / 8.0)::BIGINT * 8)) AS i, n FROM n)
SELECT (i // 8)::INT AS round, (i % 8)::INT AS rank, (i % n)::BIGINT AS item, i >= n AS padded FROM r""")
def padded_schedule(spark, sf_dir):
    """Equal rounds for eight ranks; the last one is filled from the start and marked."""
    n = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n"))
    i = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 8) * 8 - 1)).alias("i"))
    return i.select(F.floor(F.col("i") / 8).cast("int").alias("round"), (F.col("i") % 8).cast("int").alias("rank"), (F.col("i") % F.col("n")).alias("item"), (F.col("i") >= F.col("n")).alias("padded"))


@query("""SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5)::BIGINT AS chunk, source FROM documents""")
def fixed_chunks(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.floor((F.row_number().over(w) - 1) / 5).alias("chunk"), "source")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('pilot|' || doc_id)) AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 4""")
def stratified_sample(spark, sf_dir):
    """Four of each source in an order by hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sel.top_per_group(d, ["source"], [sel.hash_order("doc_id", seed="pilot")], 4)


@query("""WITH w AS (SELECT doc_id, lang, power((('0x' || substr(sha256('w|' || doc_id), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE, 1.0 / CASE WHEN n_chars > 3000 THEN 3.0 ELSE 1.0 END) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key DESC, doc_id) AS k FROM w) SELECT doc_id, lang FROM r WHERE k <= 10""")
def weighted_sample(spark, sf_dir):
    """Ten of each language without replacement, long texts at three times the weight."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    key = sel.weighted_key(F.when(F.col("n_chars") > 3000, 3.0).otherwise(1.0), "doc_id", seed="w")
    return sel.top_per_group(d.withColumn("key", key), ["lang"], [F.desc("key"), F.col("doc_id")], 10).select("doc_id", "lang")


@query("""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, n FROM c ORDER BY n DESC, l_returnflag LIMIT 6""")
def count_then_name(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_returnflag").limit(6)


@query("""WITH t AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT unnest(range(200)) AS draw), nb AS (SELECT count(*) AS m FROM t), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM t),
d AS (SELECT draw, ('0x' || substr(sha256('task|0|' || draw), 1, 8))::BIGINT % m AS i, ('0x' || substr(sha256('episode|0|' || draw), 1, 8))::BIGINT AS h FROM s, nb),
e AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS j, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT d.draw::BIGINT AS draw, e.p_brand, e.p_partkey FROM d JOIN b USING (i) JOIN e ON e.p_brand = b.p_brand AND e.j = d.h % e.n""")
def task_balanced_draw(spark, sf_dir):
    """A uniform task, then a uniform episode of it, for each draw, by hash."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    number = lambda tag: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{tag}|0|"), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("long")
    brands = part.select("p_brand").distinct()
    ordered = written(seq.global_rank(brands, ["p_brand"], "i").withColumn("i", F.col("i") - 1), "tasks")
    w = Window.partitionBy("p_brand")
    e = part.withColumn("j", (F.row_number().over(w.orderBy("p_partkey")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w)).withColumnRenamed("p_brand", "brand")
    m = ordered.agg(F.count(F.lit(1)).alias("m"))
    draws = m.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("draw")).select("draw", F.pmod(number("task"), F.col("m")).alias("i"), number("episode").alias("h"))
    d = draws.join(ordered, "i")
    return d.join(e, (d["p_brand"] == e["brand"]) & (e["j"] == F.pmod(d["h"], e["n"]))).select("draw", "p_brand", "p_partkey")


@query("""WITH RECURSIVE w AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
    -power((('0x' || substr(sha256('p|' || vec_id), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE, 1.0 / CASE WHEN vec_id % 4 = 0 THEN 3.0 ELSE 1.0 END) AS key FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, vec_id) AS k FROM w),
f AS (SELECT label, 0::BIGINT AS k, NULL::BIGINT AS vec_id, []::STRUCT(x DOUBLE, y DOUBLE)[] AS taken, FALSE AS now FROM (SELECT DISTINCT label FROM w)
  UNION ALL SELECT o.label, o.k, o.vec_id, CASE WHEN t.now THEN list_append(f.taken, {'x': o.x, 'y': o.y}) ELSE f.taken END, t.now
  FROM f JOIN o ON o.label = f.label AND o.k = f.k + 1, LATERAL (SELECT len(f.taken) < 12 AND len(list_filter(f.taken, lambda p: (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) < 0.08 * 0.08)) = 0 AS now) t)
SELECT label, vec_id, len(taken)::BIGINT AS place FROM f WHERE now""")
def placed_sample(spark, sf_dir):
    """Twelve of each label drawn without replacement, some at three times the weight, with a clearance between their points."""
    e = table(spark, sf_dir, "embeddings")
    point = lambda i: F.try_element_at("embedding", F.lit(i)).cast("double")
    key = -sel.weighted_key(F.when(F.col("vec_id") % 4 == 0, 3.0).otherwise(1.0), "vec_id", seed="p")
    rows = e.select("label", "vec_id", key.alias("key"), point(1).alias("x"), point(2).alias("y"))
    drawn = sel.placed(rows, ["label"], ["key", "vec_id"], "x", "y", 0.08, 12)
    return drawn.where("place is not null").select("label", "vec_id", F.col("place").cast("long").alias("place"))
