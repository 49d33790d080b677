"""Workflow records, reconciliation, acceptance and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import control, geometry
from episodica.operators import ledger
from episodica.operators import selection as sel
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.tables import frames, table

_EDGES = [("new", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("view", "signup"), ("signup", "view")]


@query(f"""WITH RECURSIVE {FRAMES_SQL}, q AS (SELECT user_id AS k, frame_index AS i, event_type AS new, lag(event_type, 1, 'new') OVER (PARTITION BY user_id ORDER BY frame_index) AS expected FROM frames),
f AS (SELECT k, -1 AS i, 'new' AS state, '' AS outcome, 'new' AS old FROM q WHERE i = 0
  UNION ALL SELECT q.k, q.i, CASE WHEN o.outcome = 'applied' THEN q.new ELSE f.state END, o.outcome, CASE WHEN o.outcome = 'applied' THEN f.state ELSE f.old END
  FROM f JOIN q ON q.k = f.k AND q.i = f.i + 1, LATERAL (SELECT CASE WHEN q.new = f.state AND q.expected = f.old THEN 'replayed' WHEN q.expected <> f.state THEN 'mismatch' WHEN (f.state, q.new) IN ({", ".join(f"('{a}', '{b}')" for a, b in _EDGES)}) THEN 'applied' ELSE 'illegal' END AS outcome) o)
SELECT k, i::BIGINT AS i, outcome, state FROM f WHERE i >= 0""")
def state_transitions(spark, sf_dir):
    """Transitions that name the state they expect: applied, replayed, mismatched or illegal; a fold over each record's log."""
    f = frames(spark, sf_dir)
    q = f.select(F.col("user_id").alias("k"), F.col("frame_index").alias("i"), F.lag("event_type", 1, "new").over(seq.by(["user_id"])).alias("expected"), F.col("event_type").alias("new"))
    return ledger.transitions(q, "k", "i", "expected", "new", _EDGES, "new")


@query("""WITH a AS (SELECT o_custkey AS episode, o_orderkey // 3 AS attempt, o_orderkey AS seq, o_orderstatus AS state FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY episode, attempt ORDER BY seq) AS k FROM a)
SELECT episode, attempt, seq, CASE WHEN k > 1 THEN 'existing' WHEN state = 'F' THEN 'refused' ELSE 'logged' END AS outcome FROM n""")
def attempt_log(spark, sf_dir):
    """Attempts logged once for each id, and only in the states that allow it."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode"), F.floor(F.col("o_orderkey") / 3).alias("attempt"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    k = F.row_number().over(Window.partitionBy("episode", "attempt").orderBy("seq"))
    return a.withColumn("k", k).select("episode", "attempt", "seq", F.when(F.col("k") > 1, "existing").when(F.col("o_orderstatus") == "F", "refused").otherwise("logged").alias("outcome"))


_ALLOWED = {"submitting": ["reserved"], "submitted": ["submitting", "uncertain"], "uncertain": ["submitting"], "completed": ["submitted"], "failed": ["submitted", "uncertain"], "released": ["reserved"]}
_STATUS = ["reserved", "submitting", "submitted", "uncertain", "completed", "failed", "released"]


@query(f"""WITH s AS (SELECT l_orderkey AS request, l_linenumber AS step, [{", ".join(f"'{s}'" for s in _STATUS)}][(l_partkey + l_linenumber) % 7 + 1] AS status FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
b AS (SELECT *, lag(status) OVER (PARTITION BY request ORDER BY step) AS before FROM s)
SELECT request, step, before, status FROM b WHERE before IS NOT NULL AND NOT ({" OR ".join(f"(status = '{k}' AND before IN ({', '.join(repr(x) for x in v)}))" for k, v in _ALLOWED.items())})""")
def status_rules(spark, sf_dir):
    """Changes of a request's status from a state that does not allow them."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("step")).agg(F.min("l_partkey").alias("p"))
    names = F.array(*[F.lit(x) for x in _STATUS])
    s = s.select("request", "step", F.element_at(names, ((F.col("p") + F.col("step")) % 7 + 1).cast("int")).alias("status"))
    b = s.withColumn("before", F.lag("status").over(Window.partitionBy("request").orderBy("step"))).where("before is not null")
    allowed = F.create_map(*[x for k, v in _ALLOWED.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    fine = F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("status")), F.array().cast("array<string>")), F.col("before"))
    return b.where(~fine).select("request", "step", "before", "status")


@query("""SELECT o_custkey AS episode, count(*) AS attempts, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (o_orderstatus = 'F') = 0""")
def replacement_list(spark, sf_dir):
    """Episodes whose attempts are used up without one that succeeded."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode")).agg(F.count(F.lit(1)).alias("attempts"), F.max("o_orderkey").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("good"))
    return a.where("attempts >= 4 AND good = 0").drop("good")


@query("""WITH r AS (SELECT doc_id, quality, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS sha FROM labels JOIN documents USING (doc_id))
SELECT d.doc_id, d.source FROM documents d JOIN r USING (doc_id) WHERE r.quality = 1 AND r.sha = md5(d.text)""")
def ready_index(spark, sf_dir):
    """Records that are approved and whose hash is that of their content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("now"), F.md5(F.concat("text", F.lit("x"))).alias("stale"))
    r = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    recorded = F.when(F.col("doc_id") % 7 == 0, F.col("stale")).otherwise(F.col("now"))
    return d.join(r, "doc_id", "left_semi").where(recorded == F.col("now")).select("doc_id", "source")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id, n_chars AS size, lang FROM documents)
SELECT c.doc_id, CASE WHEN lang = 'fr' THEN 'held out' WHEN p.doc_id IS NULL THEN 'published' WHEN p.size = c.size THEN 'kept' ELSE 'changed' END AS outcome FROM c LEFT JOIN p USING (doc_id)""")
def incremental_release(spark, sf_dir):
    """What an append-only release does with each record: published, kept, refused as held out, or an error as it changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    p = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 12 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"))
    outcome = F.when(F.col("lang") == "fr", "held out").when(F.col("id").isNull(), "published").when(F.col("size") == F.col("n_chars"), "kept").otherwise("changed")
    return d.join(p, F.col("doc_id") == F.col("id"), "left").select("doc_id", outcome.alias("outcome"))


@query("""SELECT source, count(*) FILTER (s = 'rebuilt') AS rebuilt, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM (SELECT source, CASE WHEN n_chars = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'rebuilt' END AS s FROM documents) GROUP BY 1""")
def rebuild_summary(spark, sf_dir):
    s = F.when(F.col("n_chars") == 0, "failed").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("rebuilt")
    d = table(spark, sf_dir, "documents").select("source", s.alias("s"))
    return d.groupBy("source").agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("rebuilt", "skipped", "failed")])


@query("""WITH b AS (SELECT doc_id, source || '/' || doc_id AS id FROM documents), m AS (SELECT replace(source || '/' || doc_id, '/', '__') AS sample, n_chars FROM documents WHERE doc_id % 29 <> 0)
SELECT b.doc_id, b.id, coalesce(m.n_chars, -1) AS n_chars, CASE WHEN m.sample IS NULL THEN 'missing' ELSE 'ok' END AS state FROM b LEFT JOIN m ON replace(b.id, '/', '__') = m.sample""")
def manifest_index_join(spark, sf_dir):
    """An index joined to a manifest whose keys are written otherwise; what has no row there is said."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("id"), "n_chars")
    key = F.replace("id", F.lit("/"), F.lit("__"))
    m = d.where("doc_id % 29 <> 0").select(key.alias("sample"), "n_chars")
    return d.drop("n_chars").join(m, key == F.col("sample"), "left").select("doc_id", "id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), F.when(F.col("sample").isNull(), "missing").otherwise("ok").alias("state"))


@query("""SELECT c.conv_id, c.turn, CASE WHEN s.conv_id IS NULL THEN role WHEN role = 'user' THEN 'assistant' WHEN role = 'assistant' THEN 'user' ELSE role END AS camera FROM conversations c LEFT JOIN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 8) s USING (conv_id)""")
def swap_lookup(spark, sf_dir):
    """The other camera for the episodes that are known to be swapped."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    swapped = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 8").select("conv_id", F.lit(True).alias("swapped"))
    other = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "user").otherwise(F.col("role"))
    return c.join(swapped, "conv_id", "left").select("conv_id", "turn", F.when(F.col("swapped"), other).otherwise(F.col("role")).alias("camera"))


@query(f"""WITH {FRAMES_SQL}, o AS (SELECT user_id, frame_index, value * (1 + CASE WHEN frame_index % 50 = 7 THEN 0.001 ELSE 0.0000001 END) AS got FROM frames WHERE frame_index % 101 <> 100)
SELECT f.user_id, count(*) AS rows, count(got) AS found, count(*) FILTER (got IS NOT NULL AND abs(got - value) > 0.00001 + 0.00001 * abs(value)) AS off, count(got) = count(*) AND count(*) FILTER (abs(got - value) > 0.00001 + 0.00001 * abs(value)) = 0 AS ok FROM frames f LEFT JOIN o USING (user_id, frame_index) GROUP BY 1""")
def row_verification(spark, sf_dir):
    """Source rows against output rows by episode and frame, within a tolerance."""
    f = frames(spark, sf_dir).select("user_id", "frame_index", "value")
    o = f.where("frame_index % 101 <> 100").select("user_id", "frame_index", (F.col("value") * (1 + F.when(F.col("frame_index") % 50 == 7, 0.001).otherwise(0.0000001))).alias("got"))
    off = F.coalesce(F.abs(F.col("got") - F.col("value")) > 0.00001 + 0.00001 * F.abs("value"), F.lit(False))
    a = f.join(o, ["user_id", "frame_index"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("got").alias("found"), F.count_if(off).alias("off"))
    return a.withColumn("ok", (F.col("rows") == F.col("found")) & (F.col("off") == 0))


@query("""SELECT vec_id, round(list_min([sqrt(power(embedding[1]::DOUBLE - embedding[i]::DOUBLE, 2) + power(embedding[2]::DOUBLE - embedding[i + 1]::DOUBLE, 2)) FOR i IN range(3, 63, 2)]), 6) AS nearest FROM embeddings""")
def nearest_object(spark, sf_dir):
    """The distance from a contact to the nearest object of its own row."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    places = F.sequence(F.lit(3), F.lit(61), F.lit(2))
    distance = lambda i: F.hypot(at(1) - F.element_at("embedding", i).cast("double"), at(2) - F.element_at("embedding", i + 1).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_min(F.transform(places, distance)), 6).alias("nearest"))


@query("""WITH e AS (SELECT vec_id, avg(x) AS mean, avg((x > 0.2)::INT) AS clipped, avg((x < -0.2)::INT) AS dark FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1)
SELECT vec_id, concat_ws(',', CASE WHEN mean < -0.02 THEN 'underexposed' END, CASE WHEN mean > 0.02 THEN 'overexposed' END, CASE WHEN clipped > 0.05 THEN 'clipped' END, CASE WHEN dark > 0.05 THEN 'dark' END) AS exposure FROM e""")
def exposure_class(spark, sf_dir):
    """Mean, clipped and dark shares of an image against a policy."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    share = lambda a, test: F.size(F.filter(a, test)) / F.size(a)
    e = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    e = e.select("vec_id", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("mean"), share(F.col("x"), lambda v: v > 0.2).alias("clipped"), share(F.col("x"), lambda v: v < -0.2).alias("dark"))
    flags = F.array(F.when(F.col("mean") < -0.02, "underexposed"), F.when(F.col("mean") > 0.02, "overexposed"), F.when(F.col("clipped") > 0.05, "clipped"), F.when(F.col("dark") > 0.05, "dark"))
    return e.select("vec_id", F.array_join(F.array_compact(flags), ",").alias("exposure"))


@query("""WITH b AS (SELECT l_orderkey AS scene, l_quantity * 20 * (l_tax * 100 + 1) AS area, l_discount * 5 AS overlap FROM lineitem) SELECT scene, count(*) AS boxes, count(*) FILTER (area BETWEEN 100 AND 4000) AS sized, count(*) FILTER (area BETWEEN 100 AND 4000 AND overlap > 0.2001) AS qualifying FROM b GROUP BY 1""")
def qualifying_entities(spark, sf_dir):
    """Boxes of a fitting size that a mask covers enough."""
    area, overlap = F.col("l_quantity") * 20 * (F.col("l_tax") * 100 + 1), F.col("l_discount") * 5
    sized = area.between(100, 4000)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count(F.lit(1)).alias("boxes"), F.count_if(sized).alias("sized"), F.count_if(sized & (overlap > 0.2001)).alias("qualifying"))


_TREE = "'{\"a\": {\"exists\": ' || (doc_id % 3 <> 0)::VARCHAR || ', \"path\": \"x\"}, \"b\": [{\"c\": {\"exists\": ' || (doc_id % 5 <> 0)::VARCHAR || '}}]}'"


@query(f"""SELECT doc_id, len(regexp_extract_all(j, '"exists":\\s*(\\w+)', 1)) AS artifacts, len(regexp_extract_all(j, '"exists":\\s*(\\w+)', 1)) > 0 AND NOT regexp_matches(j, '"exists":\\s*false') AS complete,
       CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 7 = 1 THEN 'verified' WHEN doc_id % 7 < 4 THEN 'partial' ELSE 'claimed' END AS evidence FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{{"a": 1}}' ELSE {_TREE} END AS j FROM documents)""")
def artifact_completeness(spark, sf_dir):
    """Whether every nested record that says if it exists does, at any depth; and how good a checkpoint's evidence is."""
    flag = lambda k: (F.col("doc_id") % k != 0).cast("string")
    tree = F.concat(F.lit('{"a": {"exists": '), flag(3), F.lit(', "path": "x"}, "b": [{"c": {"exists": '), flag(5), F.lit("}}]}"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, '{"a": 1}').otherwise(tree).alias("j"))
    found = F.regexp_extract_all("j", F.lit(r'"exists":\s*(\w+)'), F.lit(1))
    seven = F.col("doc_id") % 7
    record = F.when(seven == 0, F.lit(None)).when(seven == 1, '{"sha": "a", "verified": true}').when(seven < 4, '{"sha": "a"}').otherwise('{"claim": 1}')
    get = lambda path: F.get_json_object(record, path)
    evidence = F.when(record.isNull(), "none").when(get("$.verified") == "true", "verified").when(get("$.sha").isNotNull(), "partial").otherwise("claimed")
    return d.select("doc_id", F.size(found).cast("long").alias("artifacts"), ((F.size(found) > 0) & F.forall(found, lambda x: x == "true")).alias("complete"), evidence.alias("evidence"))


@query("""SELECT l_orderkey AS clip, count(*) FILTER (l_quantity >= 45 AND l_discount >= 0.03 AND l_returnflag = 'N' AND l_linestatus = 'O' AND l_tax < 0.07) AS accepted, count(*) FILTER (abs(l_discount - 0.05) < 0.025 AND abs(l_tax - 0.04) < 0.025 AND abs(l_quantity / 1000 - 0.02) < 0.012 AND l_returnflag <> 'R') AS stacked FROM lineitem GROUP BY 1""")
def clip_acceptance(spark, sf_dir):
    """Clips with the scores and statuses that acceptance asks for; stacks within tolerance on every axis with open grippers."""
    ok = (F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.03) & (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.07)
    delta, tolerance = F.array(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, F.col("l_quantity") / 1000 - 0.02), F.array(F.lit(0.025), F.lit(0.025), F.lit(0.012))
    near = F.forall(F.zip_with(delta, tolerance, lambda d, t: F.abs(d) < t), lambda x: x)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(F.count_if(ok).alias("accepted"), F.count_if(near & (F.col("l_returnflag") != "R")).alias("stacked"))


@query("""SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN x WHEN 1 THEN 1 - x WHEN 2 THEN x * 100 WHEN 3 THEN (x > 0.5)::INT ELSE least(greatest(x * 2 - 0.5, 0), 1) END, 9) AS grip FROM (SELECT o_orderkey, o_totalprice / 400000 AS x FROM orders)""")
def gripper_modes(spark, sf_dir):
    """Five ways to read a gripper's value."""
    x = F.col("o_totalprice") / 400000
    modes = {"same": x, "inverse": 1 - x, "percent": x * 100, "binary": (x > 0.5).cast("double"), "stretched": geometry.clip(x * 2 - 0.5, F.lit(0.0), F.lit(1.0))}
    mode = F.element_at(F.array(*[F.lit(m) for m in modes]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(control.by_mode(mode, modes), 9).alias("grip"))


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, CASE WHEN n < 4 THEN 'short' ELSE 'ok' END AS state FROM r WHERE k <= 4""")
def capped_groups(spark, sf_dir):
    """Exactly four of each group, groups that lack them said; the cap is the feature."""
    n = F.count(F.lit(1)).over(Window.partitionBy("p_brand"))
    r = sel.top_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", n.alias("n")), ["p_brand"], [F.col("p_partkey")], 4)
    return r.select("p_brand", "p_partkey", F.when(F.col("n") < 4, "short").otherwise("ok").alias("state"))


@query("""WITH l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents), s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('read|' || doc_id), doc_id) AS j FROM l WHERE k <= 20) SELECT source, doc_id FROM s WHERE j <= 3""")
def readback_sample(spark, sf_dir):
    """Three of the last twenty of each group by hash order, for reading back; both numbers are the feature."""
    last = sel.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.desc("doc_id")], 20)
    return sel.top_per_group(last, ["source"], [F.sha2(F.concat(F.lit("read|"), F.col("doc_id").cast("string")), 256), F.col("doc_id")], 3)


@query("""SELECT 'orders' AS part, o_orderkey AS id, o_custkey AS owner, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'parts', p_partkey, p_size, p_retailprice FROM part""")
def aggregated_dataset(spark, sf_dir):
    """Parts of one layout united by name; a column that lacks or is one too many fails."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.lit("orders").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("amount"))
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("amount"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("owner"), F.lit("parts").alias("part"))
    return o.unionByName(p, allowMissingColumns=False)


@query("""SELECT user_id % 8 AS gpu, count(*) AS samples, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1""")
def gpu_rollup(spark, sf_dir):
    """Utilisation of each device: mean, median, 95th percentile and greatest."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("gpu"), "value")
    q = seq.quantiles(e, ["gpu"], "value", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("gpu", "g")
    plain = e.groupBy("gpu").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))
    return plain.join(q, F.col("gpu") == F.col("g")).select("gpu", "samples", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max")


@query("""SELECT l_returnflag AS setting, round(avg(l_discount), 6) AS mean, round(median(l_discount), 6) AS median, round(avg((l_discount > 0.055)::INT), 6) AS over_limit FROM lineitem GROUP BY 1""")
def error_rollup(spark, sf_dir):
    """Mean and median error of each setting, and the share beyond a limit."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("setting"), "l_discount")
    q = seq.quantiles(e, ["setting"], "l_discount", {"median": 0.5}).select(F.col("setting").alias("s"), F.round("median", 6).alias("median"))
    plain = e.groupBy("setting").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.avg((F.col("l_discount") > 0.055).cast("int")), 6).alias("over_limit"))
    return plain.join(q, F.col("setting") == F.col("s")).select("setting", "mean", "median", "over_limit")


@query("""SELECT count(DISTINCT source) AS datasets, round(sum(n_chars) / 1800.0, 6) AS minutes, count(*) FILTER (lang = 'en') AS wrist, string_agg(DISTINCT lang, ',' ORDER BY lang) AS families FROM documents""")
def viewer_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count_distinct("source").alias("datasets"), F.round(F.sum("n_chars") / 1800.0, 6).alias("minutes"), F.count_if(F.col("lang") == "en").alias("wrist"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("families"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS issues, count(*) AS parts FROM conversations WHERE role <> 'system' AND length(text) > 150 GROUP BY 1""")
def flattened_issues(spark, sf_dir):
    """The issues of the parts that are not correct, with the part they are of."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))
    bad = F.filter("parts", lambda p: (p["role"] != "system") & (F.length(p["text"]) > 150))
    issues = F.transform(bad, lambda p: F.concat(p["role"], F.lit(": "), p["text"]))
    return c.where(F.size(bad) > 0).select("conv_id", F.array_join(issues, " | ").alias("issues"), F.size(bad).cast("long").alias("parts"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS batch, count(*) AS rounds, CASE WHEN max(o_totalprice) > 400000 THEN 'fail' WHEN min(o_totalprice) < 20000 THEN 'minor' ELSE 'pass' END AS verdict FROM orders GROUP BY 1, 2)
SELECT batch, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'minor') AS minor, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (rounds > 1) AS second_round FROM v GROUP BY 1""")
def batch_verdicts(spark, sf_dir):
    verdict = F.when(F.max("o_totalprice") > 400000, "fail").when(F.min("o_totalprice") < 20000, "minor").otherwise("pass")
    v = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("batch")).agg(F.count(F.lit(1)).alias("rounds"), verdict.alias("verdict"))
    count = lambda k: F.count_if(F.col("verdict") == k)
    return v.groupBy("batch").agg(count("pass").alias("passed"), count("minor").alias("minor"), count("fail").alias("failed"), F.count_if(F.col("rounds") > 1).alias("second_round"))


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT *, (value - lag(value) OVER w) / 0.02 AS vx, (value * 0.5 - lag(value * 0.5) OVER w) / 0.02 AS vy, (frame_index % 7 - lag(frame_index % 7) OVER w) / 0.02 AS vz FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
a AS (SELECT *, (vx - lag(vx) OVER w) / 0.02 AS ax, (vy - lag(vy) OVER w) / 0.02 AS ay, (vz - lag(vz) OVER w) / 0.02 AS az FROM v WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))
SELECT user_id, round(max(sqrt(ax * ax + ay * ay + az * az)), 3) AS top, count(*) FILTER (sqrt(ax * ax + ay * ay + az * az) > 500000) AS beyond FROM a GROUP BY 1""")
def acceleration_norms(spark, sf_dir):
    """The length of the acceleration over three axes by finite differences."""
    w = seq.by(["user_id"])
    axes = {"x": F.col("value"), "y": F.col("value") * 0.5, "z": (F.col("frame_index") % 7).cast("double")}
    f = frames(spark, sf_dir).withColumns({f"v{k}": (c - F.lag(c).over(w)) / 0.02 for k, c in axes.items()})
    f = f.withColumns({f"a{k}": (F.col(f"v{k}") - F.lag(f"v{k}").over(w)) / 0.02 for k in axes})
    length = geometry.norm([F.col(f"a{k}") for k in axes])
    return f.groupBy("user_id").agg(F.round(F.max(length), 3).alias("top"), F.count_if(length > 500000).alias("beyond"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT user_id, frame_index // 10 AS step, min(frame_index) / 30.0 AS a, (max(frame_index) + 1) / 30.0 AS z FROM frames GROUP BY 1, 2), p AS (SELECT user_id, max(z) AS span, greatest(2.0, max(z) / 12.5) AS speed FROM s GROUP BY 1)
SELECT s.user_id, s.step, round(CASE WHEN step = 0 THEN 0.5 ELSE least(greatest(a / speed, 0.5), 14.5) END, 4) AS start, round(least(greatest(z / speed, 1.0), 15.0), 4) AS stop FROM s JOIN p USING (user_id)""")
def step_timing(spark, sf_dir):
    """Steps of an episode on the clock of a shorter clip: a common speed, held within the clip, the first start fixed."""
    s = frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame_index") / 10).alias("step")).agg((F.min("frame_index") / 30.0).alias("a"), ((F.max("frame_index") + 1) / 30.0).alias("z"))
    speed = F.greatest(F.lit(2.0), F.max("z").over(Window.partitionBy("user_id")) / 12.5)
    s = s.withColumn("speed", speed)
    start = F.when(F.col("step") == 0, 0.5).otherwise(geometry.clip(F.col("a") / F.col("speed"), F.lit(0.5), F.lit(14.5)))
    return s.select("user_id", "step", F.round(start, 4).alias("start"), F.round(geometry.clip(F.col("z") / F.col("speed"), F.lit(1.0), F.lit(15.0)), 4).alias("stop"))


@query("""WITH g AS (SELECT l_orderkey AS k, arg_min(l_partkey, l_linenumber * 100000000.0 + l_partkey) FILTER (l_returnflag = 'R') AS grasped FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS k, l_partkey AS id, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT k, max(score) AS best FROM s GROUP BY 1), t AS (SELECT s.k, count(*) AS n, min(id) AS id FROM s JOIN b ON s.k = b.k AND s.score = b.best GROUP BY 1)
SELECT k, coalesce(grasped, CASE WHEN n = 1 THEN id END, -1) AS object FROM g JOIN t USING (k)""")
def grasped_or_best(spark, sf_dir):
    """The object grasped first, else the one of the best score; -1 where two share it."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), "l_linenumber", "l_quantity", "l_returnflag")
    per = line.groupBy("k", "id").agg(F.sum("l_quantity").alias("score"), F.min(F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "id"))).alias("first"))
    top = per.groupBy("k").agg(F.min("first")["id"].alias("grasped"), F.max("score").alias("best"), F.max_by("id", "score").alias("id"), F.collect_list("score").alias("scores"))
    alone = F.size(F.filter("scores", lambda s: s == F.col("best"))) == 1
    return top.select("k", F.coalesce("grasped", F.when(alone, F.col("id")), F.lit(-1)).alias("object"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT user_id, event_type, stddev_pop(value) AS d FROM frames WHERE event_type IN ('view', 'click') GROUP BY 1, 2), m AS (SELECT user_id, max(d) FILTER (event_type = 'view') AS front, max(d) FILTER (event_type = 'click') AS wrist FROM s GROUP BY 1)
SELECT user_id, round(front, 6) AS front, round(wrist, 6) AS wrist, front > wrist AS swapped FROM m""")
def camera_swap(spark, sf_dir):
    """Cameras are swapped where the fixed one sees more motion than the moving one."""
    motion = lambda kind: F.stddev_pop(F.when(F.col("event_type") == kind, F.col("value")))
    m = frames(spark, sf_dir).where(F.col("event_type").isin("view", "click")).groupBy("user_id").agg(motion("view").alias("front"), motion("click").alias("wrist"))
    return m.select("user_id", F.round("front", 6).alias("front"), F.round("wrist", 6).alias("wrist"), (F.col("front") > F.col("wrist")).alias("swapped"))


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT event_type, value - first_value(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS x FROM frames)
SELECT event_type, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM r GROUP BY 1""")
def relative_quantiles(spark, sf_dir):
    """Quantiles of values relative to their episode's first frame."""
    r = frames(spark, sf_dir).select("event_type", (F.col("value") - F.first("value").over(seq.by(["user_id"]))).alias("x"))
    return seq.quantiles(r, ["event_type"], "x", {"q01": 0.01, "q99": 0.99}).select("event_type", F.round("q01", 6).alias("q01"), F.round("q99", 6).alias("q99"))


@query("""SELECT l_orderkey, l_linenumber, round(l_discount * 100, 3) AS action, round(l_tax * 100 + 1, 3) AS state, l_partkey, l_suppkey, l_extendedprice FROM lineitem""")
def column_rewrite(spark, sf_dir):
    """Columns rewritten and, by the first part of their name, dropped or renamed; the rest stays."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_discount").alias("old.action"), F.col("l_tax").alias("old.state"), F.lit(1).alias("stats/min"), F.lit(2).alias("stats/max"))
    kept = line.drop(*[c for c in line.columns if c.startswith("stats/")]).withColumnsRenamed({c: c[4:] for c in line.columns if c.startswith("old.")})
    return kept.withColumns({"action": F.round(F.col("action") * 100, 3), "state": F.round(F.col("state") * 100 + 1, 3)})
