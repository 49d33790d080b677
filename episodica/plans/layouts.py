"""Readers and writers of the file layouts, held to the tables they were written from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from episodica.plans.registry import query
from episodica.sources import archives, files
from episodica.sources.shared import shared_dir
from episodica.sources.tables import table


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT event_id, event_type, value FROM events""")
def json_lines(spark, sf_dir):
    """Line-delimited JSON, written and read with its schema; blank lines are skipped."""
    path = _folder(spark, "lines")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    line = F.explode(F.array(F.to_json(F.struct("event_id", "event_type", "value")), F.lit("")))
    e.select(line.alias("value")).write.text(path)
    return files.lines(spark, path, "event_id long, event_type string, value double")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'second' ELSE 'first' END AS run, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents""")
def last_file_wins(spark, sf_dir):
    """Keyed records of several files: of equal keys the one of the last file by name stays."""
    base = _folder(spark, "keyed")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    first = d.select("doc_id", F.lit("first").alias("run"), F.col("n_chars").alias("size"))
    second = d.where("doc_id % 4 = 0").select("doc_id", F.lit("second").alias("run"), (F.col("n_chars") + 1).alias("size"))
    first.write.json(f"{base}/1")
    second.write.json(f"{base}/2")
    return files.last_file_wins(spark, f"{base}/*", "doc_id long, run string, size long", "doc_id", by_path=True)


@query("""SELECT source, count(*) AS rows, true AS from_own_folder FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def provenance_scan(spark, sf_dir):
    """Results of a tree with the path each came from; its folder names the key."""
    base = _folder(spark, "tree")
    table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", F.col("source").alias("task")).write.partitionBy("task").json(base)
    rows = files.with_path(spark, base, "doc_id long, source string", "*.json", lines=True)
    own = F.regexp_extract("_result_path", r"task=([^/]+)/[^/]+$", 1) == F.col("source")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(own).alias("from_own_folder"))


@query("""WITH f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events) SELECT frame_index, event_id, value FROM f WHERE user_id = (SELECT min(user_id) FROM events)""")
def episode_point_read(spark, sf_dir):
    """One episode of a tree of chunks: the table of episodes names its chunk, and only that folder is listed and read."""
    from episodica.sources.tables import frames

    base = _folder(spark, "episodes")
    f = frames(spark, sf_dir).select("user_id", "frame_index", "event_id", "value")
    files.episodes(f, base, "user_id", "frame_index")
    wanted = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return files.one_episode(spark, base, "user_id", wanted).select("frame_index", "event_id", "value")


@query("""SELECT (user_id % 8)::INT AS gpu, value AS utilisation, event_id::DOUBLE AS memory_mib FROM events WHERE event_id % 10 <> 3""")
def gpu_sample_lines(spark, sf_dir):
    """Samples of seven comma-separated fields with units; malformed lines are left out."""
    path = _folder(spark, "gpu")
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(", ", F.lit("2026/01/01 00:00:00.000"), (F.col("user_id") % 8).cast("string"), F.concat(F.col("value").cast("string"), F.lit(" %")), F.concat(F.col("event_id").cast("string"), F.lit(" MiB")), F.lit("1 W"), F.lit("40 C"), F.lit("P0"))
    e.select(F.when(F.col("event_id") % 10 == 3, F.lit("N/A, broken")).otherwise(line).alias("value")).write.text(path)
    return files.gpu_samples(spark, path)


@query("""SELECT count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS top FROM events WHERE event_type <> 'error'""")
def log_scan(spark, sf_dir):
    """Numbers found by a pattern in the lines of a log."""
    path = _folder(spark, "log")
    e = table(spark, sf_dir, "events").where("value is not null")
    line = F.when(F.col("event_type") == "error", F.lit("[batch] failed")).otherwise(F.concat(F.lit("[batch] group=0 controls=[8, 8] infer_s="), F.col("value").cast("string")))
    e.select(line.alias("value")).write.text(path)
    return files.log_numbers(spark, path, r"\[batch\].*?infer_s=([0-9.]+)").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"), F.round(F.max("x"), 6).alias("top"))


@query("""WITH e AS (SELECT printf('%06d', doc_id) || CASE WHEN doc_id % 31 = 0 THEN '.partial' ELSE '' END AS path, doc_id FROM documents),
f AS (SELECT path, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE 1 END AS size FROM e WHERE doc_id % 29 <> 0 UNION ALL SELECT 'extra' || doc_id, 1 FROM documents WHERE doc_id % 61 = 0), w AS (SELECT printf('%06d', doc_id) AS path FROM documents)
SELECT path, CASE WHEN path LIKE '%.partial' THEN 'stale' WHEN w IS NULL THEN 'unexpected' WHEN f IS NULL THEN 'missing' ELSE 'empty' END AS state
FROM (SELECT coalesce(w.path, f.path) AS path, w.path AS w, f.path AS f, f.size FROM w FULL JOIN f ON w.path = f.path) WHERE path LIKE '%.partial' OR w IS NULL OR f IS NULL OR size = 0""")
def artifact_inventory(spark, sf_dir):
    """Expected artifacts against those found: missing, stale, empty and unexpected ones."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k, name = F.col("doc_id"), F.format_string("%06d", "doc_id")
    there = d.where(k % 29 != 0).select(F.concat(name, F.when(k % 31 == 0, ".partial").otherwise("")).alias("path"), F.when(k % 37 == 0, 0).otherwise(1).alias("size"))
    extra = d.where(k % 61 == 0).select(F.concat(F.lit("extra"), k.cast("string")).alias("path"), F.lit(1).alias("size"))
    return files.missing_artifacts(d.select(name.alias("path")), there.unionByName(extra))


@query("""SELECT doc_id, (octet_length(encode(text)) + 1023) // 1024 AS chunks, sha256(text) AS whole FROM documents""")
def chunked_content(spark, sf_dir):
    """Contents in chunks of one size, each with its place, put together again by place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_binary("text", F.lit("utf-8")).alias("content"))
    parts = files.chunks(d, "doc_id", "content", 1024)
    joined = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk", F.hex("part").alias("h")))).alias("p"))
    whole = F.sha2(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), 256)
    return d.join(joined, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce(whole, F.sha2(F.lit(""), 256)).alias("whole"))


@query("""SELECT unnest(['first write', 'second write', 'same rows again', 'changed rows', 'rows there']) AS step, unnest(['written', 'refused', 'left', 'written', (SELECT count(*)::VARCHAR FROM documents)]) AS outcome""")
def guarded_writes(spark, sf_dir):
    """A writer that never replaces, and one that writes only what has changed; a write is whole or not there."""
    once, kept = _folder(spark, "once"), _folder(spark, "kept")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    outcome = []
    for step in ("first write", "second write"):
        try:
            files.write_once(d, once)
            outcome.append((step, "written"))
        except Exception as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            outcome.append((step, "refused"))
    said = {True: "written", False: "left"}
    files.write_if_changed(d.withColumn("n_chars", F.col("n_chars") + 1), kept)
    outcome.append(("same rows again", said[files.write_if_changed(d.withColumn("n_chars", F.col("n_chars") + 1), kept)]))
    outcome.append(("changed rows", said[files.write_if_changed(d, kept)]))
    outcome.append(("rows there", str(spark.read.parquet(kept).count())))
    return spark.createDataFrame(outcome, "step string, outcome string")


@query("""SELECT 'R' || r_regionkey AS row, 'N' || c AS "column", CASE WHEN r_regionkey = c THEN 'X' ELSE (r_regionkey * 5 + c)::VARCHAR END AS value FROM region, (SELECT unnest(range(5)) AS c)""")
def matrix_cells(spark, sf_dir):
    """A white-space matrix with colour codes as rows of (row, column, value)."""
    path = _folder(spark, "matrix")
    cell = lambda c: F.when(F.col("r_regionkey") == c, "X").otherwise((F.col("r_regionkey") * 5 + c).cast("string"))
    lines = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.concat_ws("  ", F.concat(F.lit("\x1b[4mR"), F.col("r_regionkey").cast("string"), F.lit("\x1b[0m")), *[cell(c) for c in range(5)]).alias("value"))
    head = spark.range(1).select(F.lit(-1).alias("k"), F.lit("\t" + "\t".join(f"N{c}" for c in range(5))).alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return files.matrix(spark, path)


def _archived(spark, df, name):
    spark.dataSource.register(archives.Telemetry)
    path = _folder(spark, name)
    df.write.format("telemetry").mode("append").save(path)
    return path


@query("""SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding)::INT AS width FROM embeddings""")
def telemetry_vectors(spark, sf_dir):
    """Vectors as numeric archives, published by the writer's commit and read back."""
    path = _archived(spark, table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "vectors")
    rows = spark.read.format("telemetry").load(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("vec_id", "label", F.round(total, 6).alias("total"), F.size("embedding").alias("width"))


@query("""SELECT user_id, count(*) AS samples, round(max(value), 6) AS most FROM events GROUP BY 1""")
def telemetry_samples(spark, sf_dir):
    """Samples as numeric archives; of these only the arrays asked for are read back."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    path = _archived(spark, e, "samples")
    rows = spark.read.format("telemetry").schema("user_id long, value double").load(path)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("value"), 6).alias("most"))
