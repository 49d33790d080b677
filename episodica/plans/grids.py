"""Queries over images in array columns, and over paired conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import grids
from episodica.operators import resample
from episodica.plans.registry import query
from episodica.sources.tables import table

_MASKS = "m AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v, [x > 0.1::DOUBLE FOR x IN embedding::DOUBLE[]] AS m FROM embeddings)"
_GROWN = """list_transform(range(64), lambda k: {0}[k + 1] OR (k % 8 > 0 AND {0}[k]) OR (k % 8 < 7 AND {0}[k + 2]) OR (k >= 8 AND {0}[k - 7]) OR (k < 56 AND {0}[k + 9]))"""


@query(f"""WITH RECURSIVE {_MASKS},
l AS (SELECT r, 0 AS i, list_transform(range(64), lambda k: CASE WHEN m[k + 1] THEN k END) AS l FROM m
  UNION ALL SELECT r, i + 1, list_transform(range(64), lambda k: CASE WHEN l[k + 1] IS NOT NULL THEN least(l[k + 1], CASE WHEN k % 8 > 0 THEN l[k] END,
    CASE WHEN k % 8 < 7 THEN l[k + 2] END, CASE WHEN k >= 8 THEN l[k - 7] END, CASE WHEN k < 56 THEN l[k + 9] END) END) FROM l WHERE i < 64),
e AS (SELECT r, unnest(l) AS label, unnest(range(64)) AS k FROM l WHERE i = 64),
n AS (SELECT r, label, count(*) AS n, min(k % 8) AS x0, min(k // 8) AS y0, max(k % 8) + 1 AS x1, max(k // 8) + 1 AS y1, bool_or(k % 8 IN (0, 7) OR k < 8 OR k > 55) AS edge FROM e WHERE label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT r, sum(n) AS cells, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS components, max(n) AS largest, bool_or(edge) AS at_edge FROM n GROUP BY 1)
SELECT vec_id, coalesce(cells, 0)::INT AS cells, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, coalesce(components, 0)::INT AS components, coalesce(largest, 0)::INT AS largest, coalesce(at_edge, false) AS at_edge
FROM m LEFT JOIN s USING (r)""")
def mask_statistics(spark, sf_dir):
    """Cells, box, components and edges of a mask of 8 x 8 cells for every vector."""
    mask = F.transform("embedding", lambda v: v.cast("double") > 0.1)
    return table(spark, sf_dir, "embeddings").select("vec_id", grids.mask_statistics(mask, 8, 8).alias("s")).select("vec_id", "s.*")


@query(f"""WITH {_MASKS}, g1 AS (SELECT *, {_GROWN.format("m")} AS g1 FROM m), g2 AS (SELECT *, {_GROWN.format("g1")} AS g2 FROM g1), g3 AS (SELECT *, {_GROWN.format("g2")} AS g3 FROM g2),
t AS (SELECT *, list_transform(range(64), lambda k: g3[k + 1] AND NOT g1[k + 1]) AS ring, list_transform(range(64), lambda k:
  abs(CASE WHEN k < 8 THEN v[k + 9] - v[k + 1] WHEN k > 55 THEN v[k + 1] - v[k - 7] ELSE (v[k + 9] - v[k - 7]) / 2 END)
  + abs(CASE WHEN k % 8 = 0 THEN v[k + 2] - v[k + 1] WHEN k % 8 = 7 THEN v[k + 1] - v[k] ELSE (v[k + 2] - v[k]) / 2 END)) AS steep FROM g3),
w AS (SELECT *, [k + 1 FOR k IN range(64) IF m[k + 1]] AS a, [k + 1 FOR k IN range(64) IF ring[k + 1]] AS b FROM t)
SELECT vec_id, CASE WHEN len(a) = 0 THEN 0 WHEN len(b) > 0 THEN round(abs(list_avg([v[k] FOR k IN a]) - list_avg([v[k] FOR k IN b])), 6) END::DOUBLE AS lum_step,
  CASE WHEN len(a) = 0 THEN 1 WHEN len(b) > 0 THEN round(list_avg([steep[k] FOR k IN a]) / greatest(list_avg([steep[k] FOR k IN b]), 1e-6), 6) END::DOUBLE AS texture_ratio FROM w""")
def fill_naturalness(spark, sf_dir):
    """Vectors as images of 8 x 8: how what a mask covers differs from the ring between one and three cells around it."""
    mask = F.transform("embedding", lambda v: v.cast("double") > 0.1)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", grids.fill_naturalness(F.col("embedding"), mask, 8, 8, 1, 3).alias("f"))
    return rows.select("vec_id", F.round("f.lum_step", 6).alias("lum_step"), F.round("f.texture_ratio", 6).alias("texture_ratio"))


_FACTOR = "('0x' || substr(md5({}), 1, 8))::BIGINT % 2147483646 + 1"


@query(f"""WITH d AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS d FROM orders GROUP BY 1),
e AS (SELECT {_FACTOR.format("o_custkey::VARCHAR")} AS a, d FROM d WHERE d IS NOT NULL), r AS (SELECT i AS b, {_FACTOR.format("'b|' || i")} AS c FROM range(100000) t(i)),
w AS (SELECT b, d, a * c % 2147483647 AS p FROM e, r),
m AS (SELECT b, d, (p >= {resample.STEPS[0]})::INT + (p >= {resample.STEPS[1]})::INT + (p >= {resample.STEPS[2]})::INT + (p >= {resample.STEPS[3]})::INT AS w FROM w),
s AS (SELECT sum(d * w) / nullif(sum(w), 0) AS m FROM m GROUP BY b HAVING sum(w) > 0)
SELECT round(quantile_cont(m, 0.025), 3) AS low, round(avg(m), 3) AS mid, round(quantile_cont(m, 0.975), 3) AS high, round(avg((m > 0)::INT), 6) AS above FROM s""")
def paired_bootstrap(spark, sf_dir):
    """The mean difference of a customer's prices under two states, with an interval from 100,000 resamples of customers."""
    d = resample.paired_differences(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "o_totalprice")
    out = resample.paired_bootstrap(d, "o_custkey", "difference")
    return out.select(*[F.round(c, 3).alias(c) for c in ("low", "mid", "high")], F.round("above", 6).alias("above"))
