"""Nested documents, batches of requests, and reports as text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from episodica.operators import aggregates, documents, reporting
from episodica.plans.registry import query
from episodica.sources import files
from episodica.sources.shared import shared_dir
from episodica.sources.tables import table


def _json(spark, sf_dir):
    """name, id and body of documents that refer to each other: orders, customers, nations and regions."""
    text = lambda c: F.to_json(F.struct(F.col(c).alias("const")))
    ref = lambda kind, c, fragment="": F.format_string('{"$ref":"' + kind + "/%s" + fragment + '"}', F.col(c).cast("string"))

    def made(df, kind, key, **members):
        body = F.concat(F.format_string('{"$schema":"s","$id":"' + kind + '/%s"', F.col(key).cast("string")), *[F.concat(F.lit(f',"{k}":'), v) for k, v in members.items()], F.lit("}"))
        return df.select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("name"), F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("id"), body.alias("body"))

    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region").join(nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first")), F.col("r_regionkey") == F.col("n_regionkey"))
    notes = F.concat(F.lit("["), text("o_orderpriority"), F.lit(',{"$id":"inner","of":'), ref("orders", "o_orderkey", "#/status"), F.lit("}]"))
    orders = made(table(spark, sf_dir, "orders"), "orders", "o_orderkey", status=text("o_orderstatus"), customer=ref("customers", "o_custkey", "#/segment"), notes=notes)
    customers = made(table(spark, sf_dir, "customer"), "customers", "c_custkey", segment=text("c_mktsegment"), nation=ref("nations", "c_nationkey"))
    nations = made(nations, "nations", "n_nationkey", label=text("n_name"), region=ref("regions", "n_regionkey"))
    regions = made(regions, "regions", "r_regionkey", label=text("r_name"), first=ref("nations", "first"))
    return orders.unionByName(customers).unionByName(nations).unionByName(regions)


@query("""WITH RECURSIVE one AS (SELECT n_regionkey AS k, min(n_nationkey) AS n FROM nation GROUP BY 1),
edges AS (SELECT 'o' || o_orderkey AS name, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'o' || o_orderkey, 'c' || c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'c' || c_custkey, 'n' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'r' || k, 'n' || n FROM one),
members AS (
  SELECT 'o' || o_orderkey AS name, unnest([['customer', '{"$ref":"' || CASE WHEN c_custkey IS NULL THEN 'customers/' || o_custkey || '#' ELSE '#/$defs/c' || c_custkey END || '/segment"}'],
      ['notes', '[{"enum":[' || to_json(o_orderpriority)::VARCHAR || ']},{"of":{"$ref":"#/$defs/o' || o_orderkey || '/status"}}]'], ['status', '{"enum":[' || to_json(o_orderstatus)::VARCHAR || ']}']]) AS m
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'c' || c_custkey, unnest([['nation', '{"$ref":"' || CASE WHEN n_nationkey IS NULL THEN 'nations/' || c_nationkey ELSE '#/$defs/n' || n_nationkey END || '"}'], ['segment', '{"enum":[' || to_json(c_mktsegment)::VARCHAR || ']}']])
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, unnest([['label', '{"enum":[' || to_json(n_name)::VARCHAR || ']}'], ['region', '{"$ref":"#/$defs/r' || n_regionkey || '"}']]) FROM nation
  UNION ALL SELECT 'r' || r_regionkey, unnest([['first', '{"$ref":"#/$defs/n' || n || '"}'], ['label', '{"enum":[' || to_json(r_name)::VARCHAR || ']}']]) FROM region JOIN one ON r_regionkey = k),
inner_text AS (SELECT name, string_agg('"' || m[1] || '":' || m[2], ',' ORDER BY m[1]) AS t FROM members GROUP BY 1),
reach AS (SELECT name, target FROM edges UNION SELECT reach.name, edges.target FROM reach JOIN edges ON reach.target = edges.name),
defs AS (SELECT reach.name, string_agg('"' || target || '":{' || t || '}', ',' ORDER BY target) AS d FROM reach JOIN inner_text i ON i.name = target GROUP BY 1)
SELECT name, '{' || coalesce('"$defs":{' || d || '},', '') || t || '}' AS body FROM inner_text LEFT JOIN defs USING (name)""")
def document_rewrite(spark, sf_dir):
    """Documents without their ids, constants as choices of one, each with all definitions it leads to; regions and nations lead to each other."""
    return documents.bundle(_json(spark, sf_dir))


@query("""SELECT 'resume' AS run, doc_id, lang AS frame, n_chars / 100.0 AS duration FROM documents WHERE doc_id % 3 <> 0 AND lang IS NOT NULL
UNION ALL SELECT 'force', doc_id, lang, n_chars / 100.0 FROM documents WHERE lang IS NOT NULL""")
def batch_loader(spark, sf_dir):
    """Requests of a batch folder whose output is not there, and all of them; each needs a frame of the folder beside."""
    base = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("frame"), (F.col("n_chars") / 100.0).alias("duration"))
    d.write.json(f"{base}/clips")
    d.where("doc_id % 3 = 0").select("doc_id").write.parquet(f"{base}/outputs")
    d.select("frame", F.col("frame").alias("of")).distinct().write.partitionBy("of").json(f"{base}/frames")
    requests = spark.read.schema("doc_id long, frame string, duration double").json(f"{base}/clips")
    frames = files.names_below(spark, f"{base}/frames", r"/of=([^/]+)/[^/]+$", "frame")
    run = lambda force: files.pending(requests, spark.read.parquet(f"{base}/outputs"), frames, ["doc_id"], "frame", force)
    rows = run(False).select(F.lit("resume").alias("run"), "doc_id", "frame", "duration")
    return rows.unionByName(run(True).select(F.lit("force").alias("run"), "doc_id", "frame", "duration"))


@query("""WITH d AS (SELECT *, CASE WHEN n_chars < 200 THEN ['short'] ELSE [] END || CASE WHEN lang = 'en' THEN ['crop_en'] ELSE [] END AS f FROM documents),
g AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 200) AS flagged, list_sort(list(n_chars))[count(*) // 2 + 1] AS middle FROM d GROUP BY 1)
SELECT source, '<tr><td>' || doc_id || '</td><td>' || coalesce(lang, '') || '</td><td>' || array_to_string(f, ', ') || '</td><td>' ||
  regexp_replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\r\n|\r|\n', '<br>', 'g') || '</td></tr>' AS line FROM d
UNION ALL SELECT source, unnest(['<h1>' || coalesce(source, '') || '</h1>', '<p>' || n || ' documents; flagged (non-crop): ' || flagged || '; median size ' || middle || '</p>', '<table><tr><td>document</td><td>language</td><td>flags</td><td>text</td></tr>', '</table>']) FROM g""")
def report_lines(spark, sf_dir):
    """A report of each source as text: heading, counts and median, and a row for each document; written and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").withColumn("flags", F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") == "en", "crop_en"))))
    real = F.size(F.filter("flags", lambda f: ~f.startswith("crop_"))) > 0
    middle = aggregates.upper_median(d, ["source"], "n_chars", "middle").withColumnRenamed("source", "_source")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(real).alias("flagged")).join(middle, F.col("source").eqNullSafe(F.col("_source")))
    facts = counts.select("source", F.format_string("%d documents; flagged (non-crop): %d; median size %d", "n", "flagged", "middle").alias("facts"))
    cells = {"document": F.col("doc_id"), "language": F.col("lang"), "flags": F.array_join("flags", ", "), "text": F.col("text")}
    reporting.save(reporting.lines(d, "source", "doc_id", cells, facts), path, "source")
    return spark.read.schema("value string, source string").text(path).select("source", F.col("value").alias("line"))
