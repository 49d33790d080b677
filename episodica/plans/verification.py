"""Rule families over records, and checks of data sets against what they should hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions import control
from episodica.operators import rules, trees
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.tables import frames, table


def _messages(*checks):
    """The messages of the checks that fail, joined in order; a check is (fails, message)."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks])), "; ")


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'on' ELSE 'near' END AS relation, (o_custkey * 3 + o_orderkey) % 20000 AS subject, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN (o_custkey * 3 + o_orderkey) % 20000 ELSE (o_orderkey * 7) % 20000 END AS object FROM orders),
j AS (SELECT c.*, s.c_custkey AS s, o.c_custkey AS o FROM c LEFT JOIN customer s ON s.c_custkey = c.subject LEFT JOIN customer o ON o.c_custkey = c.object)
SELECT o_orderkey AS record, 'unknown subject' AS message FROM j WHERE s IS NULL UNION ALL
SELECT o_orderkey, CASE WHEN relation = 'open' THEN 'object must be null' WHEN object IS NULL THEN 'needs an object' WHEN o IS NULL THEN 'unknown object' ELSE 'same subject and object' END FROM j
WHERE CASE WHEN relation = 'open' THEN object IS NOT NULL WHEN object IS NULL THEN TRUE WHEN o IS NULL THEN TRUE ELSE object = subject END""")
def condition_rules(spark, sf_dir):
    """References and arity of conditions: names are looked up once for each side, and the first rule that fails speaks."""
    subject = (F.col("o_custkey") * 3 + F.col("o_orderkey")) % 20000
    object_ = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, subject).otherwise((F.col("o_orderkey") * 7) % 20000)
    relation = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "on").otherwise("near")
    c = table(spark, sf_dir, "orders").select("o_orderkey", relation.alias("relation"), subject.alias("subject"), object_.alias("object"))
    names = table(spark, sf_dir, "customer")
    j = c.join(names.select(F.col("c_custkey").alias("s")), F.col("subject") == F.col("s"), "left").join(names.select(F.col("c_custkey").alias("o")), F.col("object") == F.col("o"), "left")
    unary = F.when(F.col("relation") == "open", F.when(F.col("object").isNotNull(), "object must be null").otherwise(""))
    ladder = F.coalesce(unary, F.when(F.col("object").isNull(), "needs an object").when(F.col("o").isNull(), "unknown object").when(F.col("object") == F.col("subject"), "same subject and object").otherwise(""))
    found = F.array(F.when(F.col("s").isNull(), "unknown subject").otherwise(""), ladder)
    return j.select(F.col("o_orderkey").alias("record"), F.explode(found).alias("message")).where("message <> ''")


@query("""WITH e AS (SELECT l_orderkey AS scene, l_partkey AS id, l_quantity AS y0, 60 - l_quantity AS y1, l_discount AS x0, l_tax + 0.03 AS x1, l_returnflag = 'N' AND l_linestatus = 'F' AS occluded, l_linenumber % 5 <> 0 AS boxed, p_type AS material, l_suppkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT scene, 'duplicate id' AS rule, count(*) AS n FROM (SELECT scene, id FROM e GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT scene, 'box order', count(*) FROM e WHERE boxed AND NOT (y0 < y1 AND x0 < x1) GROUP BY 1
UNION ALL SELECT scene, 'placeholder', count(*) FROM e WHERE lower(trim(material)) IN ('standard', 'unknown', 'n/a') GROUP BY 1
UNION ALL SELECT scene, 'occluded with box', count(*) FROM e WHERE occluded AND boxed GROUP BY 1
UNION ALL SELECT scene, 'holder is no actor', count(*) FROM e WHERE l_linenumber = 2 AND l_suppkey % 3 = 0 GROUP BY 1""")
def scene_rules(spark, sf_dir):
    """Rules over the entities of a scene: ids, boxes, attributes, visibility, holders."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    boxed = F.col("l_linenumber") % 5 != 0
    ordered = (F.col("l_quantity") < 60 - F.col("l_quantity")) & (F.col("l_discount") < F.col("l_tax") + 0.03)
    flags = {
        "box order": boxed & ~ordered, "placeholder": F.lower(F.trim("p_type")).isin("standard", "unknown", "n/a"),
        "occluded with box": (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F") & boxed, "holder is no actor": (F.col("l_linenumber") == 2) & (F.col("l_suppkey") % 3 == 0),
    }
    per_id = line.groupBy(F.col("l_orderkey").alias("scene"), "l_partkey").agg(F.count(F.lit(1)).alias("times"), *[F.count_if(v).alias(k) for k, v in flags.items()])
    sums = per_id.groupBy("scene").agg(F.count_if(F.col("times") > 1).alias("duplicate id"), *[F.sum(F.col(f"`{k}`")).alias(k) for k in flags])
    names = ["duplicate id", *flags]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").cast("long").alias("n")) for k in names]))
    return sums.select("scene", rows.alias("r")).select("scene", "r.rule", "r.n").where("n > 0")


@query("""WITH s AS (SELECT l_orderkey AS task, l_linenumber AS step, l_suppkey AS object, l_returnflag <> 'N' AS needs, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (l_suppkey * 3 + 1) % 1100 END AS destination FROM lineitem),
r AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0),
j AS (SELECT s.*, a.s_suppkey AS known, b.s_suppkey AS there FROM s LEFT JOIN r a ON a.s_suppkey = object LEFT JOIN r b ON b.s_suppkey = destination),
d AS (SELECT task, count(*) AS again FROM (SELECT task, step FROM s GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT j.task, count(*) FILTER (known IS NULL) AS unknown_object, count(*) FILTER (needs AND destination IS NULL) AS needs_destination, count(*) FILTER (needs AND destination IS NOT NULL AND there IS NULL) AS unknown_destination,
       count(*) FILTER (NOT needs AND destination IS NOT NULL) AS takes_none, coalesce(max(again), 0) AS duplicate_steps FROM j LEFT JOIN d USING (task) GROUP BY 1""")
def task_rules(spark, sf_dir):
    """Rules over the steps of a task: known roles, destinations where the action asks for one, no step twice."""
    line = table(spark, sf_dir, "lineitem")
    destination = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise((F.col("l_suppkey") * 3 + 1) % 1100)
    s = line.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("object"), (F.col("l_returnflag") != "N").alias("needs"), destination.alias("destination"))
    r = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    j = s.join(r.select(F.col("s_suppkey").alias("known")), F.col("known") == F.col("object"), "left").join(r.select(F.col("s_suppkey").alias("there")), F.col("there") == F.col("destination"), "left")
    lacks = F.col("destination").isNull()
    per_step = j.groupBy("task", "step").agg(
        F.count(F.lit(1)).alias("times"), F.count_if(F.col("known").isNull()).alias("a"), F.count_if(F.col("needs") & lacks).alias("b"),
        F.count_if(F.col("needs") & ~lacks & F.col("there").isNull()).alias("c"), F.count_if(~F.col("needs") & ~lacks).alias("d"),
    )
    return per_step.groupBy("task").agg(
        F.sum("a").alias("unknown_object"), F.sum("b").alias("needs_destination"), F.sum("c").alias("unknown_destination"), F.sum("d").alias("takes_none"), F.count_if(F.col("times") > 1).alias("duplicate_steps")
    )


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS step, min(l_quantity)::INT AS a, min(l_quantity)::INT + max(round(l_discount * 100))::INT AS z, max(round(l_tax * 100))::INT AS d, count(*) AS times FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, a + d AS grasp, z - d AS release, lag(z) OVER (PARTITION BY k ORDER BY step) AS before FROM g)
SELECT k AS record, step, concat_ws('; ', CASE WHEN NOT (1 <= a AND a < z AND z <= 55) THEN 'outside or empty' END, CASE WHEN a < before THEN 'overlaps' END, CASE WHEN NOT (a <= grasp AND grasp < z) THEN 'grasp outside' END,
  CASE WHEN NOT (a <= release AND release < z) THEN 'release outside' END, CASE WHEN release <= grasp THEN 'release before grasp' END, CASE WHEN times > 1 THEN 'several segments' END) AS problems FROM s""")
def segment_rules(spark, sf_dir):
    """Segments of a pair: in their frames, in order, apart from each other, grasp and release within, one for each step."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("step")).agg(
        F.min("l_quantity").cast("int").alias("a"), F.max(cents("l_discount")).alias("w"), F.max(cents("l_tax")).alias("d"), F.count(F.lit(1)).alias("times")
    )
    a, z = F.col("a"), F.col("a") + F.col("w")
    s = g.withColumn("before", F.lag(z).over(Window.partitionBy("record").orderBy("step")))
    grasp, release = a + F.col("d"), z - F.col("d")
    within = lambda x: (a <= x) & (x < z)
    problems = _messages(
        (~((a >= 1) & (a < z) & (z <= 55)), "outside or empty"), (a < F.col("before"), "overlaps"), (~within(grasp), "grasp outside"),
        (~within(release), "release outside"), (release <= grasp, "release before grasp"), (F.col("times") > 1, "several segments"),
    )
    return s.select("record", "step", problems.alias("problems"))


@query("""WITH b AS (SELECT l_orderkey AS record, l_linenumber AS role, l_partkey AS entity FROM lineitem), e AS (SELECT p_partkey, p_size % 2 AS kind FROM part WHERE p_size > 1),
r AS (SELECT record, role FROM b GROUP BY 1, 2 HAVING count(*) > 1), t AS (SELECT record, entity FROM b GROUP BY 1, 2 HAVING count(DISTINCT role) > 1),
k AS (SELECT record, role, CASE WHEN p_partkey IS NULL THEN 'unknown entity' WHEN kind <> role % 2 THEN 'kind differs' END AS message FROM b LEFT JOIN e ON p_partkey = entity)
SELECT record, 'duplicate role' AS message, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT record, 'bound twice', count(*) FROM t GROUP BY 1 UNION ALL SELECT record, message, count(*) FROM k WHERE message IS NOT NULL GROUP BY 1, 2""")
def binding_rules(spark, sf_dir):
    """Bindings of roles to entities: each role and entity once, known, and of one kind."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("role"), F.col("l_partkey").alias("entity"))
    e = table(spark, sf_dir, "part").where("p_size > 1").select("p_partkey", (F.col("p_size") % 2).alias("kind"))
    count = lambda df, message: df.groupBy("record").agg(F.count(F.lit(1)).alias("n")).select("record", F.lit(message).alias("message"), "n")
    twice = b.groupBy("record", "role").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = b.groupBy("record", "entity").agg(F.min("role").alias("a"), F.max("role").alias("z")).where("a <> z")
    kinds = b.join(e, F.col("p_partkey") == F.col("entity"), "left")
    message = F.when(F.col("p_partkey").isNull(), "unknown entity").when(F.col("kind") != F.col("role") % 2, "kind differs")
    found = kinds.withColumn("message", message).where("message is not null").groupBy("record", "message").agg(F.count(F.lit(1)).alias("n"))
    return count(twice, "duplicate role").unionByName(count(shared, "bound twice")).unionByName(found)


@query("""WITH p AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars, d.n_chars % 3 AS evidence, d.doc_id % 4 <> 0 AS has_human, d.doc_id % 5 AS score, CASE WHEN d.doc_id % 2 = 0 THEN l.quality = 1 END AS accepted FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status FROM p),
a AS (SELECT *, CASE WHEN status = 'fail' OR score < 3 THEN FALSE WHEN status = 'unknown' THEN NULL ELSE TRUE END AS want FROM s)
SELECT doc_id, concat_ws('; ', CASE WHEN status <> 'unknown' AND evidence = 0 THEN 'needs evidence' END, CASE WHEN status <> 'unknown' AND NOT has_human THEN 'reviewed without a reference' END, CASE WHEN score = 4 AND toxic = 1 THEN 'top score with a failed goal' END,
  CASE WHEN accepted IS DISTINCT FROM want THEN 'accepted differs' END) AS problems FROM a""")
def check_rules(spark, sf_dir):
    """Checks of a pair: evidence, a reference to review, the top score, and acceptance that follows from them (of three values)."""
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "pass").otherwise("fail")
    score, accepted = F.col("doc_id") % 5, F.when(F.col("doc_id") % 2 == 0, F.col("quality") == 1)
    want = rules.tri_state((status == "fail") | (score < 3), status == "unknown")
    problems = _messages(
        ((status != "unknown") & (F.col("n_chars") % 3 == 0), "needs evidence"), ((status != "unknown") & (F.col("doc_id") % 4 == 0), "reviewed without a reference"),
        ((score == 4) & (F.col("toxic") == 1), "top score with a failed goal"), (~accepted.eqNullSafe(want), "accepted differs"),
    )
    return j.select("doc_id", problems.alias("problems"))


_TELEMETRY = ("time_increases", "index_in_sequence", "even_steps", "value_finite", "known_kind", "offsets_monotone", "payload_present", "enough_frames", "unique_ids")


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT f.*, e.props, epoch_us(f.ts) - lag(epoch_us(f.ts)) OVER w AS dt, f.event_id - lag(f.event_id) OVER w AS di, row_number() OVER w - 1 AS i FROM frames f JOIN events e USING (event_id) WINDOW w AS (PARTITION BY f.user_id ORDER BY f.frame_index)),
a AS (SELECT user_id, coalesce(bool_and(dt > 0), TRUE) AS c1, bool_and(frame_index = i) AS c2, coalesce(max(dt) <= 40 * avg(dt), TRUE) AS c3, bool_and(isfinite(value)) AS c4, bool_and(event_type IN ('view', 'click', 'purchase', 'error')) AS c5,
  coalesce(bool_and(di > 0), TRUE) AS c6, bool_and(props IS NOT NULL) AS c7, count(*) >= 30 AS c8, count(DISTINCT event_id) = count(*) AS c9 FROM t GROUP BY 1)
SELECT user_id, unnest([{", ".join(f"'{n}'" for n in _TELEMETRY)}]) AS "check", unnest([c1, c2, c3, c4, c5, c6, c7, c8, c9]) AS ok FROM a""")
def telemetry_integrity(spark, sf_dir):
    """Named checks of an episode's record: time, indices, even steps, finite values, kinds, offsets, payload, length, ids."""
    props = table(spark, sf_dir, "events").select("event_id", "props")
    w = seq.by(["user_id"])
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = frames(spark, sf_dir).join(props, "event_id").select("*", (micros - F.lag(micros).over(w)).alias("dt"), (F.col("event_id") - F.lag("event_id").over(w)).alias("di"), (F.row_number().over(w) - 1).alias("i"))
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    checks = [
        every(F.col("dt") > 0), F.bool_and(F.col("frame_index") == F.col("i")), F.coalesce(F.max("dt") <= 40 * F.avg("dt"), F.lit(True)),
        F.bool_and(~F.isnan("value") & (F.abs("value") != float("inf"))), F.bool_and(F.col("event_type").isin("view", "click", "purchase", "error")),
        every(F.col("di") > 0), F.bool_and(F.col("props").isNotNull()), F.count(F.lit(1)) >= 30, F.count_distinct("event_id") == F.count(F.lit(1)),
    ]
    a = t.groupBy("user_id").agg(*[c.alias(n) for n, c in zip(_TELEMETRY, checks, strict=True)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in _TELEMETRY]))
    return a.select("user_id", rows.alias("r")).select("user_id", "r.*")


@query("""WITH j AS (SELECT d.source, d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
a AS (SELECT source, count(*) AS episodes, sum(n_chars)::BIGINT AS frames, avg((n_chars > 5000)::INT) AS out, count(*) FILTER (quality IS NULL) AS unlabelled, quantile_cont(n_chars, 0.01) AS low, count(DISTINCT lang) AS langs, max(toxic) AS toxic FROM j GROUP BY 1)
SELECT source, episodes, frames, concat_ws('; ', CASE WHEN langs > 4 THEN 'languages' END, CASE WHEN out > 0.01 THEN printf('%.1f%% outside limits', out * 100) END, CASE WHEN low < 20 AND source < 'src2' THEN 'low end' END) AS problems,
       concat_ws('; ', CASE WHEN low < 20 AND source >= 'src2' THEN 'low end' END, CASE WHEN unlabelled * 2 > episodes THEN 'few labels' END, CASE WHEN toxic = 1 THEN 'toxic rows' END) AS warnings FROM a""")
def dataset_verification(spark, sf_dir):
    """Problems and warnings of each data set; one finding is a problem or a warning by the family of the set."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    low = seq.quantiles(d, ["source"], "n_chars", {"low": 0.01}).select(F.col("source").alias("s"), "low")
    a = d.groupBy("source").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("n_chars").alias("frames"), F.avg((F.col("n_chars") > 5000).cast("int")).alias("out"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_distinct("lang").alias("langs"), F.max("toxic").alias("toxic"),
    )
    a = a.join(low, F.col("source").eqNullSafe(F.col("s")))
    strict = F.col("source") < "src2"
    problems = _messages((F.col("langs") > 4, "languages"), (F.col("out") > 0.01, F.format_string("%.1f%% outside limits", F.col("out") * 100)), ((F.col("low") < 20) & strict, "low end"))
    warnings = _messages(((F.col("low") < 20) & ~strict, "low end"), (F.col("unlabelled") * 2 > F.col("episodes"), "few labels"), (F.col("toxic") == 1, "toxic rows"))
    return a.select("source", "episodes", "frames", problems.alias("problems"), warnings.alias("warnings"))


@query("""WITH c AS (SELECT doc_id, source, CASE WHEN doc_id % 97 = 0 THEN n_chars + 1 ELSE n_chars END AS n, CASE WHEN doc_id % 89 = 0 THEN md5('') ELSE md5(text) END AS sha FROM documents WHERE doc_id % 83 <> 0),
j AS (SELECT d.source, d.doc_id, c.doc_id AS got, d.n_chars, c.n, md5(d.text) = c.sha AS same FROM documents d LEFT JOIN c USING (doc_id))
SELECT source, count(*) AS expected, count(got) AS found, count(*) FILTER (got IS NOT NULL AND n_chars <> n) AS lengths_off, count(*) FILTER (NOT same) AS content_off, count(got) = count(*) AND bool_and(coalesce(n_chars = n AND same, FALSE)) AS ok FROM j GROUP BY 1""")
def conversion_report(spark, sf_dir):
    """A converted copy against its source: rows, lengths and content of each data set."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("sha"))
    k = F.col("doc_id")
    c = d.where(k % 83 != 0).select(k.alias("got"), F.when(k % 97 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n"), F.when(k % 89 == 0, F.md5(F.lit(""))).otherwise(F.col("sha")).alias("copied"))
    j = d.join(c, F.col("doc_id") == F.col("got"), "left")
    there, length_off, same = F.col("got").isNotNull(), F.col("n_chars") != F.col("n"), F.col("sha") == F.col("copied")
    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("expected"), F.count("got").alias("found"), F.count_if(there & length_off).alias("lengths_off"), F.count_if(~same).alias("content_off"),
        ((F.count("got") == F.count(F.lit(1))) & F.bool_and(F.coalesce(~length_off & same, F.lit(False)))).alias("ok"),
    )


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 13 = 0 THEN 'moved' ELSE source END AS source, CASE WHEN doc_id % 17 = 0 THEN n_chars - 1 ELSE n_chars END AS n_chars FROM documents)
SELECT d.doc_id, concat_ws('; ', CASE WHEN d.lang IS DISTINCT FROM m.lang THEN 'lang: ' || coalesce(d.lang, 'none') || ' is ' || coalesce(m.lang, 'none') END, CASE WHEN d.source IS DISTINCT FROM m.source THEN 'source: ' || coalesce(d.source, 'none') || ' is ' || coalesce(m.source, 'none') END,
  CASE WHEN d.n_chars IS DISTINCT FROM m.n_chars THEN 'n_chars: ' || d.n_chars || ' is ' || m.n_chars END) AS errors, CASE WHEN d.n_chars < 100 THEN 'short' ELSE '' END AS warnings FROM documents d JOIN m USING (doc_id)""")
def manifest_audit(spark, sf_dir):
    """Manifest and record compared column by column, null-safe: errors with both values, and warnings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id")
    m = d.select(
        k.alias("id"), F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("lang")).alias("m_lang"), F.when(k % 13 == 0, "moved").otherwise(F.col("source")).alias("m_source"),
        F.when(k % 17 == 0, F.col("n_chars") - 1).otherwise(F.col("n_chars")).alias("m_n_chars"),
    )
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    errors = _messages(*[(~F.col(c).eqNullSafe(F.col(f"m_{c}")), F.concat(F.lit(f"{c}: "), said(c), F.lit(" is "), said(f"m_{c}"))) for c in ("lang", "source", "n_chars")])
    return d.join(m, F.col("doc_id") == F.col("id")).select("doc_id", errors.alias("errors"), F.when(F.col("n_chars") < 100, "short").otherwise("").alias("warnings"))


@query("""SELECT doc_id, n_chars - n AS off FROM (SELECT doc_id, n_chars, length(text) + CASE WHEN doc_id % 19 = 0 THEN 5 WHEN doc_id % 23 = 0 THEN 2 ELSE 0 END AS n FROM documents) WHERE abs(n_chars - n) > 2""")
def length_mismatch(spark, sf_dir):
    """Records whose two lengths differ by more than two."""
    k = F.col("doc_id")
    n = F.length("text") + F.when(k % 19 == 0, 5).when(k % 23 == 0, 2).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") - n).alias("off")).where(F.abs("off") > 2)


@query("""WITH a AS (SELECT l_orderkey AS layout, l_partkey AS body, min(l_quantity) AS x, min(l_discount) AS y FROM lineitem GROUP BY 1, 2), b AS (SELECT layout, body, x + CASE WHEN layout % 40 = 0 THEN 0.5 ELSE 0 END AS x, y FROM a WHERE body % 31 <> 0 UNION ALL SELECT layout, -1, 0.0, 0.0 FROM a WHERE layout % 60 = 0 GROUP BY 1),
j AS (SELECT coalesce(a.layout, b.layout) AS layout, a.body AS a, b.body AS b, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS e FROM a FULL JOIN b ON a.layout = b.layout AND a.body = b.body)
SELECT layout, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, round(max(e), 9) AS worst, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND coalesce(max(e), 0) <= 1e-9 AS same FROM j GROUP BY 1""")
def layout_comparison(spark, sf_dir):
    """Bodies of two layouts: those missing and extra, and the greatest error of the others."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("layout"), F.col("l_partkey").alias("body")).agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"))
    moved = a.where("body % 31 <> 0").select("layout", "body", (F.col("x") + F.when(F.col("layout") % 40 == 0, 0.5).otherwise(0.0)).alias("x2"), F.col("y").alias("y2"))
    added = a.where("layout % 60 = 0").select("layout").distinct().select("layout", F.lit(-1).cast("long").alias("body"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("y2"))
    j = a.join(moved.unionByName(added), ["layout", "body"], "full")
    e = F.greatest(F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2")))
    no_b, no_a = F.col("x2").isNull(), F.col("x").isNull()
    both = F.when(~no_a & ~no_b, e)
    return j.groupBy("layout").agg(F.count_if(no_b).alias("missing"), F.count_if(no_a).alias("extra"), F.round(F.max(both), 9).alias("worst"), ((F.count_if(no_a | no_b) == 0) & (F.coalesce(F.max(both), F.lit(0.0)) <= 1e-9)).alias("same"))


@query("""WITH e AS (SELECT conv_id, turn, role FROM conversations), r AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'robot' ELSE role END AS role FROM conversations WHERE turn % 11 <> 5)
SELECT e.conv_id, count(*) AS expected, count(r.role) AS recorded, count(*) FILTER (r.role IS NULL) AS lacking, count(*) FILTER (r.role <> e.role) AS differing,
       coalesce(string_agg(e.turn, ',' ORDER BY e.turn) FILTER (r.role IS DISTINCT FROM e.role), '') AS wrong FROM e LEFT JOIN r USING (conv_id, turn) GROUP BY 1""")
def overlay_verification(spark, sf_dir):
    """Recorded outputs against the expected ones as maps, key by key."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "role"))).alias("want"))
    kept = F.map_filter("want", lambda k, v: k % 11 != 5)
    c = c.withColumn("got", F.transform_values(kept, lambda k, v: F.when(k % 7 == 3, "robot").otherwise(v)))
    keys = F.array_sort(F.map_keys("want"))
    got = lambda k: F.try_element_at("got", k)
    want = lambda k: F.element_at("want", k)
    size = lambda a: F.size(a).cast("long")
    wrong = F.filter(keys, lambda k: ~got(k).eqNullSafe(want(k)))
    return c.select(
        "conv_id", size("want").alias("expected"), size("got").alias("recorded"), size(F.filter(keys, lambda k: got(k).isNull())).alias("lacking"),
        size(F.filter(keys, lambda k: got(k) != want(k))).alias("differing"), F.array_join(F.transform(wrong, lambda k: k.cast("string")), ",").alias("wrong"),
    )


#: Depth of the hash trees below; a leaf holds files / 16 ** depth.
_DEPTH = 3


def _tree_sql(name: str, files: str) -> str:
    """The hash tree of (source, name, sha) rows as tables ``{name}3`` down to ``{name}0``."""
    levels = [f"""{name}{_DEPTH} AS (SELECT source, left(md5(name), {_DEPTH}) AS node, sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name || ':' || sha)) AS sha FROM ({files}) GROUP BY 1, 2)"""]
    levels += [f"""{name}{up} AS (SELECT source, left(node, {up}) AS node, sha256(string_agg(node || ':' || sha, chr(10) ORDER BY node || ':' || sha)) AS sha FROM {name}{up + 1} GROUP BY 1, 2)""" for up in range(_DEPTH - 1, -1, -1)]
    return ", ".join(levels)


_FILES = "SELECT source, printf('%06d', doc_id) AS name, sha256(text) AS sha FROM documents"
_BEFORE = "SELECT source, printf('%06d', doc_id) AS name, CASE WHEN doc_id % 97 = 0 THEN sha256('older') ELSE sha256(text) END AS sha FROM documents WHERE NOT (source = 'src1' AND doc_id % 5 = 0) AND source <> 'src3'"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("source", "doc_id", F.format_string("%06d", "doc_id").alias("name"), F.sha2("text", 256).alias("sha"))


def _before(files):
    """An earlier state of the files: a source that was not there, one that lacked some, and some of other contents."""
    old = files.where(~((F.col("source") == "src1") & (F.col("doc_id") % 5 == 0)) & (F.col("source") != "src3"))
    return old.withColumn("sha", F.when(F.col("doc_id") % 97 == 0, F.sha2(F.lit("older"), 256)).otherwise(F.col("sha")))


@query(f"""WITH {_tree_sql("n", _FILES)}, {_tree_sql("o", _BEFORE)}
SELECT n0.source, CASE WHEN o0.sha IS NULL THEN 'written' WHEN o0.sha = n0.sha THEN 'same' ELSE 'refused' END AS outcome FROM n0 LEFT JOIN o0 ON o0.source = n0.source""")
def fail_closed_freeze(spark, sf_dir):
    """A manifest, by the root of its hash tree, is written where none is, left where it is the same, and else refused."""
    files = _files(spark, sf_dir)
    now, old = (trees.roots(trees.nodes(f, ["source"], "name", "sha", _DEPTH), ["source"]).select("source", F.col("tree").alias(c)) for f, c in ((files, "now"), (_before(files), "old")))
    return now.join(old, "source", "left").select("source", F.when(F.col("old").isNull(), "written").when(F.col("old") == F.col("now"), "same").otherwise("refused").alias("outcome"))


@query(f"""SELECT source, name AS path, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' ELSE 'altered' END AS change
FROM ({_BEFORE}) o FULL JOIN ({_FILES}) n USING (source, name) WHERE o.sha IS DISTINCT FROM n.sha""")
def tree_diff(spark, sf_dir):
    """The files that differ between two trees, found from their roots down."""
    files = _files(spark, sf_dir)
    return trees.changed(_before(files), files, ["source"], "name", "sha", _DEPTH)


@query("""WITH e AS (SELECT source, count(*) AS expected, count(*) FILTER (quality IS NOT NULL) AS checked, count(*) FILTER (quality = 1) AS ok, sum(n_chars)::BIGINT AS bytes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, expected, checked, ok, CASE WHEN checked = ok AND ok = expected THEN 'released' ELSE 'refused' END AS state, CASE WHEN checked = ok AND ok = expected THEN bytes END AS bytes FROM e""")
def release_gate(spark, sf_dir):
    """A release only where all that is expected is checked and right."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    e = j.groupBy("source").agg(F.count(F.lit(1)).alias("expected"), F.count("quality").alias("checked"), F.count_if(F.col("quality") == 1).alias("ok"), F.sum("n_chars").alias("all_bytes"))
    whole = (F.col("checked") == F.col("ok")) & (F.col("ok") == F.col("expected"))
    return e.select("source", "expected", "checked", "ok", F.when(whole, "released").otherwise("refused").alias("state"), F.when(whole, F.col("all_bytes")).alias("bytes"))


@query(f"""WITH {_tree_sql("t", _FILES + " WHERE doc_id % 10 <> 0")} SELECT source, sha AS tree FROM t0""")
def tree_hash(spark, sf_dir):
    """The root of each source's hash tree over its files by path, control files left out."""
    kept = _files(spark, sf_dir).where("doc_id % 10 <> 0")
    return trees.roots(trees.nodes(kept, ["source"], "name", "sha", _DEPTH), ["source"]).select("source", "tree")


_LIMITS = {"joint_speed": 9000.0, "linear_speed": 9500.0, "angular_speed": 150.0, "joint_acceleration": 700000.0, "linear_acceleration": 750000.0, "angular_acceleration": 12000.0}
_AUDIT = (
    "telemetry_integrity", "finite", "joint_ranges", *_LIMITS, "simulator_warnings", "penetration", "distractor_displacement", "distractor_rotation",
    "allowed_contacts", "grasp_contact", "settled_success", "support", "release", "settled_speed", "goal",
)


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT *, (value - lag(value) OVER w) / 0.02 AS v, lag(event_type) OVER w AS before, value - first_value(value) OVER w AS moved, max(frame_index) OVER (PARTITION BY user_id) AS last FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
a AS (SELECT *, (v - lag(v) OVER (PARTITION BY user_id ORDER BY frame_index)) / 0.02 AS a, 2 * acos(least(1.0, abs(cos(moved / 200)))) AS turned, event_type = 'click' AS held, frame_index > last - 5 AS ending FROM v),
g AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame_index) AS island FROM a),
r AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, island, count(*) FILTER (held) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT user_id, count(*) AS n, bool_and(isfinite(value)) AS fin, max(greatest(0 - value, value - 250)) AS excess, max(abs(v)) AS speed, max(abs(a)) AS acc, count(*) FILTER (event_type = 'error') AS warn, max(greatest(0, 5 - value)) AS deep,
    max(abs(moved)) AS moved, max(turned) AS turned, count(*) FILTER (event_type = 'purchase' AND before = 'error') AS bad_contacts, max(frame_index) - coalesce(max(frame_index) FILTER (NOT (value > 5 AND event_type <> 'error')), -1) AS suffix,
    count(*) FILTER (ending AND event_type = 'error') AS unsupported, count(*) FILTER (ending AND held) AS unreleased, count(*) FILTER (ending AND abs(v) > 4000) AS moving, count(*) FILTER (ending AND NOT value BETWEEN 0 AND 150) AS off_goal FROM g GROUP BY 1),
c AS (SELECT user_id, [(s.n >= 30)::INT, fin::INT, (excess <= 0)::INT, {", ".join(f"({m} <= {x})::INT" for m, x in zip(("coalesce(speed, 0)", "coalesce(speed, 0) * 1.118", "coalesce(speed, 0) / 57.3", "coalesce(acc, 0)", "coalesce(acc, 0) * 1.118", "coalesce(acc, 0) / 57.3"), _LIMITS.values(), strict=True))}, (warn = 0)::INT, (deep <= 3)::INT, (moved <= 200)::INT, (turned <= 1.2)::INT, (bad_contacts = 0)::INT, (r.n <= 4)::INT, (suffix >= 3)::INT, (unsupported = 0)::INT, (unreleased = 0)::INT, (moving = 0)::INT, (off_goal = 0)::INT] AS ok,
    [s.n, 0, greatest(excess, 0), coalesce(speed, 0), coalesce(speed, 0) * 1.118, coalesce(speed, 0) / 57.3, coalesce(acc, 0), coalesce(acc, 0) * 1.118, coalesce(acc, 0) / 57.3, warn, deep, moved, turned, bad_contacts, r.n, suffix, unsupported, unreleased, moving, off_goal] AS measured FROM s JOIN r USING (user_id))
SELECT user_id, unnest([{", ".join(f"'{n}'" for n in _AUDIT)}]) AS "check", unnest(ok) = 1 AS ok, round(unnest(measured)::DOUBLE, 3) AS measured FROM c""")
def physics_audit_full(spark, sf_dir):
    """All twenty named checks of an episode with what was measured, from one pass over its frames and one over its runs."""
    w = seq.by(["user_id"])
    f = frames(spark, sf_dir).withColumns({"v": seq.difference("value", ["user_id"]) / 0.02, "before": F.lag("event_type").over(w), "moved": F.col("value") - F.first("value").over(w), "last": F.max("frame_index").over(Window.partitionBy("user_id"))})
    f = f.withColumns({"a": (F.col("v") - F.lag("v").over(w)) / 0.02, "turned": 2 * F.acos(F.least(F.lit(1.0), F.abs(F.cos(F.col("moved") / 200)))), "held": F.col("event_type") == "click", "ending": F.col("frame_index") > F.col("last") - 5})
    f = f.withColumn("run", F.sum(F.when(F.col("held"), 0).otherwise(1)).over(w)).withColumn("length", F.count_if(F.col("held")).over(Window.partitionBy("user_id", "run")))
    value, error = F.col("value"), F.col("event_type") == "error"
    last_bad = F.max(F.when(~((value > 5) & ~error), F.col("frame_index")))
    ending = lambda c: F.count_if(F.col("ending") & c)
    s = f.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(~F.isnan("value") & (F.abs("value") != float("inf"))).alias("fin"), F.max(F.greatest(-value, value - 250)).alias("excess"),
        F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("speed"), F.coalesce(F.max(F.abs("a")), F.lit(0.0)).alias("acc"), F.count_if(error).alias("warn"), F.max(F.greatest(F.lit(0.0), 5 - value)).alias("deep"),
        F.max(F.abs("moved")).alias("far"), F.max("turned").alias("turn"), F.count_if((F.col("event_type") == "purchase") & (F.col("before") == "error")).alias("contacts"), F.max("length").alias("grip"),
        (F.max("frame_index") - F.coalesce(last_bad, F.lit(-1))).alias("suffix"), ending(error).alias("unsupported"), ending(F.col("held")).alias("unreleased"), ending(F.abs("v") > 4000).alias("moving"), ending(~value.between(0, 150)).alias("off"),
    )
    speed, acc = F.col("speed"), F.col("acc")
    measured = dict(zip(_LIMITS, (speed, speed * 1.118, speed / 57.3, acc, acc * 1.118, acc / 57.3), strict=True))
    none = lambda c: (F.col(c) == 0, F.col(c))
    found = {
        "telemetry_integrity": (F.col("n") >= 30, F.col("n")), "finite": (F.col("fin"), F.lit(0)), "joint_ranges": (F.col("excess") <= 0, F.greatest("excess", F.lit(0.0))),
        **{k: (m <= _LIMITS[k], m) for k, m in measured.items()}, "simulator_warnings": none("warn"), "penetration": (F.col("deep") <= 3, F.col("deep")),
        "distractor_displacement": (F.col("far") <= 200, F.col("far")), "distractor_rotation": (F.col("turn") <= 1.2, F.col("turn")), "allowed_contacts": none("contacts"), "grasp_contact": (F.col("grip") <= 4, F.col("grip")),
        "settled_success": (F.col("suffix") >= 3, F.col("suffix")), "support": none("unsupported"), "release": none("unreleased"), "settled_speed": none("moving"), "goal": none("off"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), ok.alias("ok"), F.round(m.cast("double"), 3).alias("measured")) for k, (ok, m) in found.items()]))
    return s.select("user_id", rows.alias("r")).select("user_id", "r.*")


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT *, value - lag(value) OVER w AS step, lag(event_type) OVER w AS before FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
e AS (SELECT user_id, count(*) / 30.0 AS seconds, max(value) - min(value) AS span FROM t GROUP BY 1),
a AS (SELECT count(*) AS frames, avg(isnan(value)::INT) AS nan, quantile_cont(abs(step), 0.9999) AS jump, median(step) FILTER (abs(step) < 20) AS offset_, avg((value < 0 OR value > 250)::INT) AS out, quantile_cont(value, 0.01) AS p1, quantile_cont(abs(value - 100), 0.99) AS reach,
  count(*) FILTER (event_type = 'click' AND before IS DISTINCT FROM 'click') AS grasps, quantile_cont(value, 0.1) FILTER (event_type = 'click' AND before IS DISTINCT FROM 'click') AS g1, quantile_cont(value, 0.5) FILTER (event_type = 'click' AND before IS DISTINCT FROM 'click') AS g5, quantile_cont(value, 0.9) FILTER (event_type = 'click' AND before IS DISTINCT FROM 'click') AS g9 FROM t),
b AS (SELECT count(*) AS episodes, min(seconds) AS shortest, median(seconds) AS middle, max(seconds) AS longest, count(*) FILTER (span < 50) AS still FROM e)
SELECT frames, episodes, round(shortest, 3) AS shortest, round(middle, 3) AS middle, round(longest, 3) AS longest, still, round(nan, 6) AS nan, round(jump, 4) AS jump, round(offset_, 4) AS leader_offset, round(out, 6) AS out_of_range, round(p1, 4) AS low, round(reach, 4) AS reach, grasps, round(g1, 4) AS grasp_10, round(g5, 4) AS grasp_50, round(g9, 4) AS grasp_90 FROM a, b""")
def screening_report(spark, sf_dir):
    """The whole screening row of a data set: lengths, stillness, gaps, jumps, offset, range, reach and grasps, with exact tail quantiles."""
    w = seq.by(["user_id"])
    t = frames(spark, sf_dir).withColumns({"step": seq.difference("value", ["user_id"]), "onset": (F.col("event_type") == "click") & ~F.lag("event_type").over(w).eqNullSafe(F.lit("click"))})
    e = t.groupBy("user_id").agg((F.count(F.lit(1)) / 30.0).alias("seconds"), (F.max("value") - F.min("value")).alias("span"))
    a = t.agg(F.count(F.lit(1)).alias("frames"), F.avg(F.isnan("value").cast("int")).alias("nan"), F.avg(((F.col("value") < 0) | (F.col("value") > 250)).cast("int")).alias("out"), F.count_if("onset").alias("grasps")).first()
    b = e.agg(F.count(F.lit(1)).alias("episodes"), F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"), F.count_if(F.col("span") < 50).alias("still")).first()
    q = lambda df, value, **wanted: seq.quantiles(df.select(value.alias("x")), [], "x", wanted).first()  # noqa: E731  one row each
    value, step = F.col("value"), F.col("step")
    jump, offset = q(t, F.abs(step), jump=0.9999), q(t.where(F.abs(step) < 20), step, middle=0.5)
    low, reach = q(t, value, low=0.01), q(t, F.abs(value - 100), reach=0.99)
    grasp, middle = q(t.where("onset"), value, g1=0.1, g5=0.5, g9=0.9), q(e, F.col("seconds"), middle=0.5)
    number = lambda row, name, digits=4: F.round(F.lit(row[name] if row else None).cast("double"), digits)
    return spark.range(1).select(
        F.lit(a["frames"]).alias("frames"), F.lit(b["episodes"]).alias("episodes"), number(b, "shortest", 3).alias("shortest"), number(middle, "middle", 3).alias("middle"), number(b, "longest", 3).alias("longest"), F.lit(b["still"]).alias("still"),
        number(a, "nan", 6).alias("nan"), number(jump, "jump").alias("jump"), number(offset, "middle").alias("leader_offset"), number(a, "out", 6).alias("out_of_range"), number(low, "low").alias("low"), number(reach, "reach").alias("reach"),
        F.lit(a["grasps"]).alias("grasps"), number(grasp, "g1").alias("grasp_10"), number(grasp, "g5").alias("grasp_50"), number(grasp, "g9").alias("grasp_90"),
    )


@query("""SELECT vec_id, fx AS edge FROM (SELECT vec_id, ['bottom', 'top', 'right', 'left'][list_position([-x, x, y, -y], greatest(-x, x, y, -y))] AS fx FROM (SELECT vec_id, embedding[1]::DOUBLE / sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE) AS x, embedding[2]::DOUBLE / sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE) AS y FROM embeddings))""")
def camera_edge(spark, sf_dir):
    """The edge of the image on the person's side, from the way the camera looks."""
    x, y = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", control.facing_edge(x, y).alias("edge"))
