"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import aggregates as agg
from episodica.operators import sequence as seq
from episodica.plans.registry import query
from episodica.sources.tables import table


@query("""WITH x AS (SELECT unnest(range(64))::INT AS dim, unnest([v::DOUBLE FOR v IN embedding]) AS x FROM embeddings)
SELECT dim, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
       round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.1), 6) AS q10, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.9), 6) AS q90, round(quantile_cont(x, 0.99), 6) AS q99 FROM x GROUP BY 1""")
def vector_feature_stats(spark, sf_dir):
    return agg.feature_stats(table(spark, sf_dir, "embeddings"), "embedding")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS q05, round(median(value), 6) AS median,
       round(quantile_cont(value, 0.95), 6) AS q95, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1""")
def distribution_summary(spark, sf_dir):
    return agg.distribution(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


@query("""WITH t AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1)
SELECT round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, count(*) AS tasks FROM t""")
def micro_macro_mean(spark, sf_dir):
    """The overall mean, and the mean of the tasks' means."""
    t = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("s"))
    return t.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg("m"), 6).alias("macro"), F.count(F.lit(1)).alias("tasks"))


@query("""WITH e AS (SELECT l_linenumber AS "offset", unnest(['quantity', 'discount', 'tax']) AS channel, unnest([l_quantity / 50, l_discount * 10, l_tax * 10]) AS target, unnest([l_discount * 10, l_tax * 10, l_quantity / 50]) AS prediction FROM lineitem)
SELECT coalesce("offset"::VARCHAR, 'all') AS "offset", coalesce(channel, 'all') AS channel, round(avg(abs(prediction - target)), 6) AS mae, round(sqrt(avg((prediction - target) * (prediction - target))), 6) AS rmse, round(avg(abs(1 - target)), 6) AS persistence_mae
FROM e GROUP BY GROUPING SETS ((), (e.channel), (e."offset"))""")
def error_grouping_sets(spark, sf_dir):
    """Errors of a model and a baseline overall, by channel and by offset in one pass."""
    line = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10
    parts = F.array(*[F.struct(F.lit(n).alias("channel"), a.alias("target"), b.alias("prediction")) for n, a, b in (("quantity", q, d), ("discount", d, t), ("tax", t, q))])
    e = line.select(F.col("l_linenumber").alias("offset"), F.explode(parts).alias("x")).select("offset", "x.*")
    off = F.col("prediction") - F.col("target")
    out = e.groupingSets([[], ["channel"], ["offset"]], "offset", "channel").agg(
        F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.sqrt(F.avg(off * off)), 6).alias("rmse"), F.round(F.avg(F.abs(1 - F.col("target"))), 6).alias("persistence_mae")
    )
    return out.withColumns({"offset": F.coalesce(F.col("offset").cast("string"), F.lit("all")), "channel": F.coalesce("channel", F.lit("all"))})


@query("""SELECT o_orderpriority AS task, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) AS episodes, round(count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1), 6) AS rate
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def rollup_success(spark, sf_dir):
    """Success by task and overall."""
    won = F.count_if(F.col("o_orderstatus") == "F")
    out = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "task").rollup("task")
    return out.agg(won.alias("success"), F.count(F.lit(1)).alias("episodes"), F.round(won / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("rate"))


_CHARGE = "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN o_totalprice ELSE o_totalprice * 1.1 END"


@query(f"""WITH r AS (SELECT *, ({_CHARGE})::DECIMAL(18, 6) AS charge FROM orders)
SELECT o_orderpriority AS run, round(sum(charge)::DOUBLE, 4) AS committed, coalesce(round(sum(charge) FILTER (o_orderstatus = 'O')::DOUBLE, 4), 0) AS unresolved,
       count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS released FROM r GROUP BY 1""")
def ledger_totals(spark, sf_dir):
    """Committed and unresolved spending and statuses of each run; money as exact decimals."""
    status = F.col("o_orderstatus")
    charge = F.when(status == "P", F.lit(0.0)).when(status == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 1.1).cast("decimal(18,6)")
    r = table(spark, sf_dir, "orders").withColumn("charge", charge)
    return r.groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.round(F.sum("charge").cast("double"), 4).alias("committed"), F.coalesce(F.round(F.sum(F.when(status == "O", F.col("charge"))).cast("double"), 4), F.lit(0.0)).alias("unresolved"),
        F.count_if(status == "F").alias("completed"), F.count_if(status == "O").alias("open"), F.count_if(status == "P").alias("released"),
    )


@query("""SELECT event_type AS "check", arg_max(event_id, value * 1e9 - event_id) AS event_id, round(max(value), 6) AS worst, count(*) AS violations FROM events WHERE value > 50 GROUP BY 1""")
def worst_per_check(spark, sf_dir):
    """The first of the worst violations of each check."""
    bad = table(spark, sf_dir, "events").where("value > 50")
    return bad.groupBy(F.col("event_type").alias("check")).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.round(F.max("value"), 6).alias("worst"), F.count(F.lit(1)).alias("violations"))


@query("""WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS a, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 8),
k AS (SELECT *, greatest(1, least((n + 1) // 4, n - 1)) AS k1, greatest(1, least((3 * (n + 1)) // 4, n - 1)) AS k3 FROM g),
q AS (SELECT p_brand, (a[k1] * (4 - ((n + 1) - 4 * k1)) + a[k1 + 1] * ((n + 1) - 4 * k1)) / 4 AS q1, (a[k3] * (4 - (3 * (n + 1) - 4 * k3)) + a[k3 + 1] * (3 * (n + 1) - 4 * k3)) / 4 AS q3 FROM k),
f AS (SELECT *, greatest(0, q1 - 1.5 * (q3 - q1) - 0.01) AS low, q3 + 1.5 * (q3 - q1) + 0.02 AS high FROM q)
SELECT p.p_brand, round(f.low, 6) AS low, round(f.high, 6) AS high, count(*) FILTER (p_retailprice < low OR p_retailprice > high) AS outliers FROM part p JOIN f USING (p_brand) GROUP BY 1, 2, 3""")
def tukey_fences_exclusive(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    f = part.join(agg.tukey_fences(part, ["p_brand"], "p_retailprice"), "p_brand")
    out = (F.col("p_retailprice") < F.col("low")) | (F.col("p_retailprice") > F.col("high"))
    return f.groupBy("p_brand", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")).agg(F.count_if(out).alias("outliers"))


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), o AS (SELECT e.*, m.m, abs(value - m) AS d FROM events e JOIN m USING (event_type)),
s AS (SELECT event_type, median(d) AS mad FROM o GROUP BY 1)
SELECT event_id, event_type, round((value - m) / (1.4826 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END), 6) AS z FROM o JOIN s USING (event_type) WHERE abs((value - m) / (1.4826 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END)) > 4""")
def mad_outliers(spark, sf_dir):
    z = agg.robust_z(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return z.where(F.abs("z") > 4).select("event_id", "event_type", F.round("z", 6).alias("z"))


@query("""SELECT e.event_type AS key, string_agg(r, ',' ORDER BY k) AS flags, count(*) AS n FROM (
  SELECT event_type, 0 AS k, 'large' AS r FROM events GROUP BY 1 HAVING max(value) > 200
  UNION ALL SELECT event_type, 1, 'spread' FROM events GROUP BY 1 HAVING stddev_samp(value) > 40
  UNION ALL SELECT event_type, 2, 'many' FROM events GROUP BY 1 HAVING count(*) > 1000) e GROUP BY 1""")
def flag_arrays(spark, sf_dir):
    """Flags of each key in the order of their rules; keys without one are clean and left out."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max("value").alias("top"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("c"))
    flags = F.array_compact(F.array(F.when(F.col("top") > 200, "large"), F.when(F.col("std") > 40, "spread"), F.when(F.col("c") > 1000, "many")))
    return e.select("key", flags.alias("f")).where(F.size("f") > 0).select("key", F.array_join("f", ",").alias("flags"), F.size("f").cast("long").alias("n"))


@query("""SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1] AS upper_median FROM part GROUP BY 1""")
def upper_median(spark, sf_dir):
    return agg.upper_median(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "upper_median")


@query("""SELECT p_brand AS task, count(*) AS episodes, count(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS instructions, arg_min(p_name, p_partkey) AS family FROM part GROUP BY 1""")
def index_build(spark, sf_dir):
    """Counts, sorted distinct instructions and the first family of each task."""
    types = F.array_sort(F.collect_set("p_type"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.count(F.lit(1)).alias("episodes"), F.size(types).cast("long").alias("types"), F.array_join(types, "|").alias("instructions"), F.min_by("p_name", "p_partkey").alias("family"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT sum(n)::BIGINT AS total, count(*) AS episodes, count(*) FILTER (n > 0) AS unique_seen, count(*) FILTER (n = 0) AS unseen, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean,
       round(median(n), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM c""")
def exposure_summary(spark, sf_dir):
    """How often episodes were drawn, those never drawn included."""
    drawn = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(drawn, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return c.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("n") > 0).alias("unique_seen"), F.count_if(F.col("n") == 0).alias("unseen"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"),
    )


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM v)
SELECT user_id, event_type, votes FROM r WHERE k = 1""")
def mode_vote(spark, sf_dir):
    return agg.mode_vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""SELECT l_returnflag AS channel, round(CASE WHEN quantile_cont(l_discount, 0.99) - quantile_cont(l_discount, 0.01) < 0.001 THEN quantile_cont(l_discount, 0.01) - 0.5 ELSE quantile_cont(l_discount, 0.01) END, 6) AS q01,
       round(CASE WHEN quantile_cont(l_discount, 0.99) - quantile_cont(l_discount, 0.01) < 0.001 THEN quantile_cont(l_discount, 0.99) + 0.5 ELSE quantile_cont(l_discount, 0.99) END, 6) AS q99 FROM lineitem GROUP BY 1 HAVING count(*) >= 20""")
def quantile_calibration(spark, sf_dir):
    """Ranges by quantiles; a range that is too narrow is widened on both sides."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), "l_discount")
    q = seq.quantiles(line, ["channel"], "l_discount", {"a": 0.01, "b": 0.99}).where("n >= 20")
    narrow = F.when(F.col("b") - F.col("a") < 0.001, 0.5).otherwise(0.0)
    return q.select("channel", F.round(F.col("a") - narrow, 6).alias("q01"), F.round(F.col("b") + narrow, 6).alias("q99"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC, o_totalprice DESC, o_orderkey DESC) AS j FROM n WHERE k = 1)
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM b WHERE j = 1""")
def latest_then_best(spark, sf_dir):
    """The newest record of each file, then the best record of each episode."""
    orders = table(spark, sf_dir, "orders")
    rank = F.struct((F.col("o_orderstatus") == "F").alias("usable"), F.col("o_totalprice").alias("rank"), F.col("o_orderkey").alias("order"))
    best = agg.latest_then_best(orders, ["o_orderpriority"], F.struct("o_orderdate", "o_orderkey"), ["o_custkey"], rank, ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


@query("""SELECT o_orderpriority AS phase, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS completed, count(*) AS total, coalesce(round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 2), 0) AS percent FROM orders GROUP BY 1""")
def progress_totals(spark, sf_dir):
    done = F.coalesce(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(done.alias("completed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.round(100.0 * done / F.count(F.lit(1)), 2), F.lit(0.0)).alias("percent"))


@query("""SELECT least(n_name, r_name) AS a, greatest(n_name, r_name) AS b, count(*) AS contacts FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def contact_pair_histogram(spark, sf_dir):
    """Counts of unordered pairs."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy(F.least("n_name", "r_name").alias("a"), F.greatest("n_name", "r_name").alias("b")).agg(F.count(F.lit(1)).alias("contacts"))


@query("""SELECT l_shipmode, wins, n FROM (SELECT l_returnflag AS l_shipmode, count(*) FILTER (l_discount < l_tax) AS wins, count(*) AS n FROM lineitem GROUP BY 1)""")
def win_count(spark, sf_dir):
    """How often the model beats the baseline."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count_if(F.col("l_discount") < F.col("l_tax")).alias("wins"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS draws, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM d GROUP BY 1""")
def rank_merge(spark, sf_dir):
    """Partial counts of ranks added up by key, then by task."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("draws"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""WITH s AS (SELECT unnest(range(200)) AS b), u AS (SELECT event_id, value FROM events WHERE event_type = 'purchase'),
d AS (SELECT b, u.value, ('0x' || substr(md5(b || '|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS r FROM s, u),
m AS (SELECT b, sum(value * (CASE WHEN r < 0.36787944 THEN 0 WHEN r < 0.73575888 THEN 1 WHEN r < 0.91969860 THEN 2 WHEN r < 0.98101184 THEN 3 ELSE 4 END)) / nullif(sum(CASE WHEN r < 0.36787944 THEN 0 WHEN r < 0.73575888 THEN 1 WHEN r < 0.91969860 THEN 2 WHEN r < 0.98101184 THEN 3 ELSE 4 END), 0) AS mean FROM d GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 4) AS low, round(avg(mean), 4) AS mid, round(quantile_cont(mean, 0.975), 4) AS high FROM m""")
def bootstrap_interval(spark, sf_dir):
    """An interval of the mean by a hash-seeded Poisson bootstrap: each row weighs a Poisson draw in each of 200 resamples.

    A resample is a key of a partial aggregation, so nothing but 200 sums leaves a task.
    """
    u = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "value").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(199))))
    r = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "event_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    w = F.when(r < 0.36787944, 0).when(r < 0.73575888, 1).when(r < 0.91969860, 2).when(r < 0.98101184, 3).otherwise(4)
    m = u.withColumn("w", w).groupBy("b").agg((F.sum(F.col("value") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    return m.agg(F.round(F.percentile("mean", F.lit(0.025)), 4).alias("low"), F.round(F.avg("mean"), 4).alias("mid"), F.round(F.percentile("mean", F.lit(0.975)), 4).alias("high"))


@query("""WITH m AS (SELECT vec_id, label, [v > 0 FOR v IN embedding] AS mask FROM embeddings),
n AS (SELECT label, count(*) AS n FROM m GROUP BY 1),
c AS (SELECT label, i, count(*) FILTER (mask[i]) AS held FROM m, range(1, 65) r(i) GROUP BY 1, 2),
p AS (SELECT label, list(held * 2 > n ORDER BY i) AS prior FROM c JOIN n USING (label) GROUP BY 1),
j AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: mask[i] AND prior[i]) AS a, list_transform(range(1, 65), lambda i: mask[i] OR prior[i]) AS o FROM m JOIN p USING (label)
  WHERE len(list_filter(prior, lambda x: x)) / 64.0 > 0.003)
SELECT vec_id, label, round(len(list_filter(a, lambda x: x)) / len(list_filter(o, lambda x: x)), 9) AS iou FROM j""")
def mask_prior_iou(spark, sf_dir):
    """Masks of 64 cells against the mask that most of their label agree on; labels that agree on hardly any cell are left out."""
    m = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v > 0).alias("mask"))
    return agg.prior_iou(m, ["label"], "mask", 64).select("vec_id", "label", F.round("iou", 9).alias("iou"))
