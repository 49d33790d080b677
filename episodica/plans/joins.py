"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import geometry, text
from episodica.operators import joins
from episodica.operators import sequence as seq
from episodica.plans.registry import FRAMES_SQL, query
from episodica.sources.shared import written
from episodica.sources.tables import frames, table


@query("""SELECT d.doc_id, d.source, coalesce(l.quality, -1)::INT AS quality, coalesce(l.toxic, 0)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def equi_join_default(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""WITH a AS (SELECT doc_id, quality AS v FROM labels), b AS (SELECT doc_id, 9 AS v FROM documents WHERE n_chars > 5000)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v)::INT AS v FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def full_outer_precedence(spark, sf_dir):
    """Judged and audited values; an audit overrides."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    b = table(spark, sf_dir, "documents").where("n_chars > 5000").select("doc_id", F.lit(9).alias("v"))
    return joins.with_precedence(a, b, ["doc_id"], "v")


@query("""WITH l AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'missing' AS status FROM (SELECT DISTINCT k FROM l) WHERE k NOT IN (SELECT k FROM r) UNION ALL
SELECT k, 'extra' FROM (SELECT DISTINCT k FROM r) WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, 'duplicate' FROM r GROUP BY 1 HAVING count(*) > 1""")
def reconcile_missing_extra(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return joins.reconcile(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["k"])


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_anti_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    big = o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").join(urgent, "c_custkey", "left_anti")


@query("""WITH need AS (SELECT DISTINCT user_id, t AS event_type FROM events, (VALUES ('view'), ('click'), ('purchase')) v(t)),
have AS (SELECT DISTINCT user_id, event_type, TRUE AS met FROM events WHERE value > 50)
SELECT user_id, bool_and(coalesce(met, FALSE)) AS all_met FROM need LEFT JOIN have USING (user_id, event_type) GROUP BY 1""")
def relational_division(spark, sf_dir):
    """Users whose every goal was met."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    need = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))))
    return joins.divides(e.where("value > 50"), need, "user_id", "event_type")


_SEGMENTS = """segs AS (SELECT user_id, unnest(range(0, max(frame_index) + 1, 16)) AS s FROM frames GROUP BY user_id)"""


@query(f"""WITH {FRAMES_SQL}, {_SEGMENTS},
m AS (SELECT *, value > 60 AS flag FROM frames), st AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, FALSE) THEN 1 ELSE 0 END AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
isl AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY frame_index) AS i FROM st), runs AS (SELECT user_id, i, min(frame_index) AS start, max(frame_index) + 1 AS e FROM isl WHERE flag GROUP BY 1, 2)
SELECT g.user_id, g.s::BIGINT AS segment_start, min(r.start)::BIGINT AS first_grasp, least(max(r.e), g.s + 15)::BIGINT AS last_release, count(*) AS grasps
FROM segs g JOIN runs r ON r.user_id = g.user_id AND r.start >= g.s AND r.start < g.s + 16 GROUP BY g.user_id, g.s""")
def interval_join_first_last(spark, sf_dir):
    """Runs that begin in a segment: the first grasp, and the last release within it."""
    f = frames(spark, sf_dir)
    segs = f.groupBy("user_id").agg(F.max("frame_index").alias("m")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(16).cast("long"))).alias("segment_start"))
    segs = segs.withColumn("segment_end", F.col("segment_start") + 16)
    hit = joins.within(seq.runs(f, F.col("value") > 60, ["user_id"]), segs, ["user_id"], "start", "segment_start", "segment_end")
    return hit.groupBy("user_id", "segment_start").agg(F.min("start").alias("first_grasp"), F.least(F.max("end"), F.col("segment_start") + 15).alias("last_release"), F.count(F.lit(1)).alias("grasps"))


@query(f"""WITH {FRAMES_SQL}, fc AS (SELECT user_id, frame_index AS start, value AS v FROM frames WHERE frame_index % 8 = 0),
j AS (SELECT f.user_id, f.frame_index, fc.v, power(3, -floor((f.frame_index - fc.start) / 8)) AS w FROM frames f JOIN fc ON fc.user_id = f.user_id AND fc.start <= f.frame_index AND fc.start + 24 > f.frame_index)
SELECT user_id, frame_index, round(sum(w * v) / sum(w), 6) AS blended FROM j GROUP BY 1, 2""")
def coverage_join_blend(spark, sf_dir):
    """Forecasts that cover a frame, blended with weights that fall by age.

    A forecast is dealt to the blocks of 8 frames that it covers, so the join is an equality on (episode, block).
    """
    f = frames(spark, sf_dir).select("user_id", "frame_index", "value").withColumn("block", F.floor(F.col("frame_index") / 8))
    fc = f.where("frame_index % 8 = 0").select("user_id", F.col("frame_index").alias("start"), F.col("value").alias("v"), F.explode(F.sequence(F.col("block"), F.col("block") + 2)).alias("block"))
    w = F.pow(F.lit(3.0), -F.floor((F.col("frame_index") - F.col("start")) / 8))
    return f.join(fc, ["user_id", "block"]).groupBy("user_id", "frame_index").agg(F.round(F.sum(w * F.col("v")) / F.sum(w), 6).alias("blended"))


@query("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
j AS (SELECT v.*, p.pid, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(p.pts) - epoch_us(v.ts)), p.pts, p.pid) AS k FROM v JOIN p USING (user_id))
SELECT event_id, user_id, pid AS nearest_purchase FROM j WHERE k = 1""")
def asof_nearest(spark, sf_dir):
    """To each view the purchase of the same user nearest in time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    v = e.where("event_type = 'view'").drop("event_type")
    p = e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("nearest_purchase"))
    p = p.groupBy("user_id", "at").agg(F.min("nearest_purchase").alias("nearest_purchase"))
    return joins.nearest(v, p, ["user_id"], "at", "nearest_purchase").where("nearest_purchase is not null").select("event_id", "user_id", "nearest_purchase")


@query("""WITH b AS (SELECT l_orderkey AS k, l_partkey AS id, l_quantity AS y0, l_discount * 100 AS x0, l_quantity + 10 AS y1, l_discount * 100 + 5 + l_tax * 100 AS x1 FROM lineitem),
u AS (SELECT k, id, min(y0) AS y0, min(x0) AS x0, min(y1) AS y1, min(x1) AS x1 FROM b GROUP BY 1, 2),
p AS (SELECT a.k, a.id AS a, c.id AS b, greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) * greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) AS i, (a.y1 - a.y0) * (a.x1 - a.x0) + (c.y1 - c.y0) * (c.x1 - c.x0) AS s FROM u a JOIN u c ON a.k = c.k AND a.id < c.id)
SELECT k, round(min(i / (s - i)), 6) AS agreement, count(*) AS pairs FROM p GROUP BY 1""")
def pair_iou(spark, sf_dir):
    """The least overlap of any two boxes of an episode; episodes have few boxes."""
    x = F.col("l_discount") * 100
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("y0"), x.alias("x0"), (F.col("l_quantity") + 10).alias("y1"), (x + 5 + F.col("l_tax") * 100).alias("x1"))
    u = line.groupBy("k", "id").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.min("y1").alias("y1"), F.min("x1").alias("x1")).select("k", "id", F.array("y0", "x0", "y1", "x1").alias("box"))
    pairs = u.alias("a").join(u.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")))
    return pairs.groupBy("a.k").agg(F.round(F.min(geometry.iou(F.col("a.box"), F.col("b.box"))), 6).alias("agreement"), F.count(F.lit(1)).alias("pairs"))


@query("""WITH allowed AS (SELECT least(s, t) AS a, greatest(s, t) AS b FROM (VALUES ('view', 'click'), ('purchase', 'click')) v(s, t)),
p AS (SELECT user_id, event_type AS x, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p JOIN allowed ON least(x, y) = a AND greatest(x, y) = b GROUP BY 1, 2""")
def unordered_pair_semi(spark, sf_dir):
    """Neighbouring events whose pair, in either order, is allowed."""
    f = frames(spark, sf_dir).withColumn("y", F.lead("event_type").over(seq.by(["user_id"])))
    p = f.select(F.least("event_type", "y").alias("a"), F.greatest("event_type", "y").alias("b")).where("a is not null and b is not null")
    p = p.where(F.col("a").isNotNull())
    allowed = spark.sql("SELECT least(s, t) AS a, greatest(s, t) AS b FROM VALUES ('view', 'click'), ('purchase', 'click') AS v(s, t)")
    return p.join(F.broadcast(allowed), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, round(f - o, 4) AS f_minus_o, round(p - o, 4) AS p_minus_o FROM p WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL""")
def pivot_paired_conditions(spark, sf_dir):
    """Customers with all three conditions, compared to one of them."""
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice")).dropna()
    return p.select("o_custkey", F.round(F.col("F") - F.col("O"), 4).alias("f_minus_o"), F.round(F.col("P") - F.col("O"), 4).alias("p_minus_o"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS t FROM benchmark),
x AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, greatest(len(w) - 6, 1))]) AS s FROM (SELECT doc_id, string_split(t, ' ') AS w FROM d)),
y AS (SELECT DISTINCT unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, greatest(len(w) - 6, 1))]) AS s FROM (SELECT string_split(t, ' ') AS w FROM b))
SELECT 'text' AS kind, count(*) AS n FROM (SELECT DISTINCT doc_id FROM d JOIN b USING (t)) UNION ALL SELECT 'run', count(*) FROM (SELECT DISTINCT doc_id FROM x JOIN y USING (s)) UNION ALL
SELECT 'id', count(*) FROM (SELECT DISTINCT doc_id FROM d JOIN b ON doc_id = item_id)""")
def overlap_report(spark, sf_dir):
    """Training rows that a held-out set also has, by kind of match."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "))
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    normed = lambda df: df.select("doc_id", norm(F.col("text")).alias("t"))
    d = normed(raw)
    b = table(spark, sf_dir, "benchmark").select("item_id", norm(F.col("text")).alias("t"))
    words = F.col("words")  # a column of its own, split once a row
    split = lambda df: df.withColumn("words", F.split("t", " "))
    each = lambda f: F.when(F.size(words) >= 8, F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: f(F.slice(words, i, 8))))
    # hashes of runs and of the text find the few rows that may match; only these have their runs spelled out
    hashes = F.array_append(F.coalesce(each(F.xxhash64), F.array().cast("array<bigint>")), F.xxhash64("t"))
    hashed = lambda df, *more: split(df).select(*more, F.explode_outer(hashes).alias("h"))
    runs = lambda df, *more: split(df).select(*more, F.explode(each(lambda w: F.array_join(w, " "))).alias("s"))
    hit = hashed(d, "doc_id").join(written(hashed(b).distinct(), "hashes"), "h", "left_semi").select(F.col("doc_id").alias("hit")).distinct()
    # written, since a filter on the text would else go below the join, to all texts
    maybe = written(normed(raw.join(written(hit, "hits"), F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi")), "maybe")
    shared = runs(maybe, "doc_id").join(runs(b).distinct(), "s", "left_semi").select("doc_id").distinct()
    count = lambda kind, hits: hits.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    ids = d.join(b.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return count("text", maybe.join(b, "t", "left_semi")).union(count("run", shared)).union(count("id", ids))


@query("""SELECT k, min(src) AS first_seen FROM (SELECT c_nationkey AS k, 'customer' AS src FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    """Distinct keys with the source they came from first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"))
    return c.unionByName(s).groupBy("k").agg(F.min("src").alias("first_seen"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_ops_union_diff_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("difference", a.subtract(b))).union(named("intersection", a.intersect(b)))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_detection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


@query("""WITH a AS (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS m FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, string_agg(l_linestatus, ',' ORDER BY l_linestatus) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, replace(a.m, 'R', 'O') = replace(b.m, 'A', 'O') AS same FROM a JOIN b USING (l_orderkey)""")
def multiset_equality(spark, sf_dir):
    """Whether two multisets are equal, by their sorted lists."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("a"), F.array_join(F.array_sort(F.collect_list("l_linestatus")), ",").alias("b")).select("l_orderkey", (F.replace("a", F.lit("R"), F.lit("O")) == F.replace("b", F.lit("A"), F.lit("O"))).alias("same"))


@query("""WITH g AS (SELECT o.o_orderpriority, s.o_orderstatus, y FROM (SELECT DISTINCT o_orderpriority FROM orders) o, (SELECT DISTINCT o_orderstatus FROM orders) s, (VALUES (1993), (1999), (2010)) v(y)),
c AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT g.o_orderpriority, g.o_orderstatus, g.y::INT AS year, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN 'pending' ELSE 'done' END AS status FROM g LEFT JOIN c USING (o_orderpriority, o_orderstatus, y)""")
def grid_densification(spark, sf_dir):
    """Every cell of a grid of literals, pending where nothing was found; the grid is a handful of rows."""
    o = table(spark, sf_dir, "orders")
    kinds = o.agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))  # a few literals each
    grid = kinds.select(F.explode("p").alias("o_orderpriority"), "s").select("o_orderpriority", F.explode("s").alias("o_orderstatus"))
    grid = grid.withColumn("year", F.explode(F.array(F.lit(1993), F.lit(1999), F.lit(2010))))
    c = o.groupBy("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("c"))
    return grid.join(c, ["o_orderpriority", "o_orderstatus", "year"], "left").select("o_orderpriority", "o_orderstatus", "year", F.coalesce("c", F.lit(0)).alias("n"), F.when(F.col("c").isNull(), "pending").otherwise("done").alias("status"))


@query("""SELECT l.l_orderkey, l.l_linenumber, p.p_brand, n.n_name, r.r_name, count(*) AS n FROM lineitem l JOIN part p ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey JOIN nation n ON n_nationkey = s_nationkey JOIN region r ON r_regionkey = n_regionkey GROUP BY ALL""")
def multi_hop_reference(spark, sf_dir):
    """A reference followed over four tables."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    out = out.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = out.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return out.groupBy("l_orderkey", "l_linenumber", "p_brand", "n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 48) AS slug FROM documents""")
def text_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS norm FROM documents""")
def text_normalise(spark, sf_dir):
    """Compatibility form, case folded, words joined by one space; the SQL has no such form, but these texts need none of it but ß."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalised(F.col("text")).alias("norm"))


@query("""WITH a AS (SELECT page_id, CASE WHEN strpos(html, '<title>') > 0 THEN html[strpos(html, '<title>') + 7:] END AS rest FROM pages)
SELECT page_id, CASE WHEN strpos(rest, '</title>') > 0 THEN nullif(trim(rest[:strpos(rest, '</title>') - 1]), '') END AS title FROM a""")
def text_marker_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.between_markers(F.col("html"), "<title>", "</title>").alias("title"))


@query("""SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS sha FROM orders""")
def canonical_hash(spark, sf_dir):
    """A hash over canonical JSON; the hex check holds for all of it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.canonical_hash(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("sha"))
    return o.where(text.is_hex64(F.col("sha")))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)/([a-z]+)/(\\d+)', 1) AS task, TRY_CAST(regexp_extract(url, '^https?://([^/?#]+)/([a-z]+)/(\\d+)', 3) AS BIGINT) AS episode FROM pages""")
def key_parse(spark, sf_dir):
    pattern = r"^https?://([^/?#]+)/([a-z]+)/(\d+)"
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", pattern, 1).alias("task"), F.nullif(F.regexp_extract("url", pattern, 3), F.lit("")).cast("long").alias("episode"))


@query("""SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT AS seed, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 1000000 * 50 + 1000000)::BIGINT AS block FROM documents""")
def seed_from_sha(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", text.seed_of(key).alias("seed"), text.seed_block(key).alias("block"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN 'ok' ELSE 'bad' END AS state FROM events""")
def json_props(spark, sf_dir):
    """A field of a JSON column, and whether it is an object."""
    p = F.from_json("props", "k bigint")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.when(ok, "ok").otherwise("bad").alias("state"))
